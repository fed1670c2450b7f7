"""Removal of repeated byte strings by prefix-free parsing.

Triggers of a rolling hash cut every text into phrases. A position is a trigger if its k-byte hash is the smallest, the
leftmost of equal ones, among the k-grams of some string of ``length`` bytes; each such string thus has exactly one
trigger, wherever it stands, and phrases stay shorter than ``length``. The dictionary is the table of distinct phrase
contexts (trigger, and the bytes of all strings that belong to it); the parse is the table of their places in the
corpus. Suffix order is only needed to the depth of ``length`` bytes, and inside the suffixes of one trigger:

1. whole texts that repeat are found by their digests;
2. places with a context that an earlier place has are repeated with all their strings (no bytes are compared again);
3. the distinct contexts of a trigger, where there are several, have their suffixes sorted by content and place, which
   shows the strings that an earlier place has. Triggers with more than ``HOT`` contexts are not sorted in one task:
   their strings are aggregated by content, with partial sums before the shuffle.

Places are ordered by (doc_id, start). Cases: null or empty texts and texts under ``length`` bytes lose nothing; a null doc_id
comes first; repeated rows (same doc_id and text) are one place and give the same result each; rows that share a doc_id
with other texts count as one document whose starts are compared, and each loses what the id loses, up to its length; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_prefix, forget, lean, materialise, mix, span_hash, steps, string_buffer, text_of

#: Bytes of the rolling hash.
GRAM = 24
#: Contexts of a trigger that one task sorts (some 2 million strings, about 150 MB while they are sorted).
HOT = 50_000
#: Rows that may be broadcast, by their counted number.
BROADCAST_ROWS = 500_000
#: Places that a task sums up at a time.
PLACES = 1 << 20
#: Bytes of contexts that are sorted at a time, whole triggers at least.
SORT_BYTES = 8 << 20
_PLACE = np.uint64((1 << 31) - 1)
#: Stands for a null doc_id in order.
NO_ID = -(1 << 63)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def triggers(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, position, first start, last start, gram hash, context hash) of each trigger; the starts are those of its strings."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    pre = byte_prefix(raw)
    at = np.arange(len(raw) - GRAM + 1)
    h = span_hash(pre, at, at + GRAM)
    low = sliding_min(h & ~_PLACE | at.astype(np.uint64), length - GRAM + 1)
    starts = np.arange(len(low))
    row = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + length <= offsets[row + 1]
    starts, row, pos = starts[inside], row[inside], (low[inside] & _PLACE).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(starts), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
    f = np.flatnonzero(new)
    first, last, pos, row = starts[f], starts[np.append(f[1:], len(starts)) - 1], pos[f], row[f]
    context = mix(span_hash(pre, first, last + length) + (pos - first).astype(np.uint64))
    return row, pos, first, last, h[pos], context


def parse(docs: DataFrame, length: int) -> DataFrame:
    """(gram, context, doc, at, again): the places of all phrase contexts; at packs position and reach to both sides.

    Of the places of a context in a batch only the first goes on to be compared, so that a frequent passage is summed up
    before the shuffle. The others are known to repeat (again) and are dealt by chance.
    """

    def run(batches):
        held = []
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in steps(offsets):
                row, pos, first, last, gram, context = triggers(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                packed = (pos - (offsets[a + row] - offsets[a])) << 14 | (pos - first) << 7 | (pos - last)
                held.append((gram.view(np.int64), context.view(np.int64), ids[a + row], packed))
                if sum(len(x[0]) for x in held) >= PLACES:
                    yield summed(held)
                    held = []
        if held:
            yield summed(held)

    def summed(held):
        gram, context, doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, doc, context))
        gram, context, doc, at = gram[order], context[order], doc[order], at[order]
        new = np.ones(len(gram), bool)
        new[1:] = context[1:] != context[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
        again = (doc != doc[head]) | (at != at[head])
        chance = mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.where(again, chance, gram)), pa.array(context), pa.array(doc), pa.array(at), pa.array(again)], names=["gram", "context", "doc", "at", "again"])

    return docs.select("doc", "text").mapInArrow(lean(run), "gram bigint, context bigint, doc bigint, at bigint, again boolean")


def starts_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = at >> 14
    return pos - (at >> 7 & 127), pos - (at & 127)


def compare_contexts(places: DataFrame) -> DataFrame:
    """(doc, at, gram, again): places of repeated contexts (again), and the first places of the contexts of a trigger with several.

    Reads each trigger's places in order and keeps one row between batches.
    """

    def run(batches):
        last = None  # gram, context, doc, at of the last context's first place, and whether it has been given out
        for batch in batches:
            gram, context, doc, at = (c.to_numpy() for c in batch.columns[:4])
            known = batch.column(4).to_numpy(zero_copy_only=False)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[known], at[known], gram[known], known[known])], names=["doc", "at", "gram", "again"])
                gram, context, doc, at = gram[~known], context[~known], doc[~known], at[~known]
            if not len(gram):
                continue
            new_gram, new_context = np.ones(len(gram), bool), np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_context[1:] = new_gram[1:] | (context[1:] != context[:-1])
            if last is not None:
                new_gram[0] = gram[0] != last[0]
                new_context[0] = new_gram[0] or context[0] != last[1]
            head = np.maximum.accumulate(np.where(new_context, np.arange(len(gram)), -1))
            first_doc, first_at = np.where(head < 0, 0 if last is None else last[2], doc[head]), np.where(head < 0, 0 if last is None else last[3], at[head])
            again = ~new_context & ((doc != first_doc) | (at != first_at))
            several = new_context & ~new_gram  # a further context of the same trigger
            heads = np.flatnonzero(new_context)
            fine = several.copy()
            later = heads[1:][several[heads[1:]]]
            fine[heads[np.searchsorted(heads, later) - 1]] = True
            out = [np.concatenate([x[again], x[fine]]) for x in (doc, at, gram)] + [np.repeat([True, False], [again.sum(), fine.sum()])]
            if last is not None and len(heads) and several[heads[0]] and not last[4]:
                out = [np.append(x, v) for x, v in zip(out, (last[2], last[3], last[0], False))]
            if len(heads):
                k = heads[-1]
                last = (gram[k], context[k], doc[k], at[k], bool(fine[k]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc", "at", "gram", "again"])

    rows = places.repartition("gram").sortWithinPartitions("gram", "context", "doc", "at")
    return rows.select("gram", "context", "doc", "at", "again").mapInArrow(lean(run), "doc bigint, at bigint, gram bigint, again boolean")


def fetch_contexts(docs: DataFrame, fine: DataFrame, length: int) -> DataFrame:
    """(gram, hot, doc, at, data): the bytes of the contexts that are to be compared."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            lists = batch.column(2)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            gram, at, hot = flat.field("gram"), flat.field("at").to_numpy(), flat.field("hot")
            first, last = starts_of(at)
            text_at = offsets[row]
            data = memoryview(raw.tobytes())
            parts = [bytes(data[o + a : o + b + length]) for o, a, b in zip(text_at.tolist(), first.tolist(), last.tolist())]
            for a in range(0, len(parts), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([gram[s], hot[s], batch.column(0).take(pa.array(row[s])), pa.array(at[s]), pa.array(parts[s], pa.binary())], names=["gram", "hot", "doc", "at", "data"])

    wanted = fine.groupBy("doc").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("places"))
    rows = docs.join(wanted, "doc").select("doc", "text", "places")
    return rows.mapInArrow(lean(run), "gram bigint, hot boolean, doc bigint, at bigint, data binary")


def _strings(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int):
    """Row, start in the document and content hash of every string of the contexts."""
    first, last = starts_of(at)
    n = last - first + 1
    row = np.repeat(np.arange(len(at)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    where = offsets[row] + inner
    return row, first[row] + inner, span_hash(byte_prefix(data), where, where + length)


def _ranges(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc)) - 1 if len(f) else f
    return pa.RecordBatch.from_arrays([pa.array(doc[f]), pa.array(start[f]), pa.array(start[last])], names=["doc", "low", "high"])


def sort_suffixes(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, low, high): runs of starts whose string an earlier place has, for triggers that one task can sort."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            data, offsets = string_buffer(rows.column(3))
            doc, at = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            row, start, h = _strings(data, offsets, at, length)
            order = np.lexsort((start, doc[row], h))
            row, start, h = row[order], start[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = (doc[row] != doc[row[head]]) | (start != start[head])
            return _ranges(doc[row[later]], start[later])

        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) < SORT_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            gram = rows.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield done(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    rows = contexts.where("not hot").select("gram", "doc", "at", "data").repartition("gram").sortWithinPartitions("gram")
    return rows.mapInArrow(lean(run), "doc bigint, low bigint, high bigint")


def aggregate_strings(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot triggers: the first place of each string by a partial aggregate, and all others by a join."""

    def run(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(2))
            doc, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in steps(offsets):
                row, start, h = _strings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], at[a:b], length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[a + row]), pa.array(start)], names=["string", "doc", "start"])

    strings = contexts.where("hot").select("doc", "at", "data").mapInArrow(lean(run), "string bigint, doc bigint, start bigint")
    first = strings.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = strings.join(first, "string").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.select("doc", F.col("start").alias("low"), F.col("start").alias("high"))


def cut_out(rows: DataFrame, length: int) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, from (doc_id, text, runs of starts)."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            data = memoryview(raw.tobytes())
            out = []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                removed, spans, kept, end = 0, 0, hashlib.sha256(), 0
                for low, high in sorted((x["low"], x["high"]) for x in runs or ()):
                    high = min(high + length, len(text))
                    if low >= len(text):
                        break
                    if low > end or not spans:
                        kept.update(text[end:low])
                        spans += 1
                        end = low
                    removed += max(0, high - end)
                    end = max(end, high)
                kept.update(text[end:])
                out.append((len(text), removed, spans, kept.hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_runs(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc, low, high): runs of starts of strings that also start earlier; docs has (doc, text)."""
    digests = docs.select("doc", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("h")).where(F.col("n") >= length)
    digests = materialise(digests, "digests")
    firsts = digests.groupBy("h", "n").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = materialise(digests.join(firsts, ["h", "n"]).where("doc <> first").select("doc", (F.col("n") - length).alias("high")).distinct(), "copies")
    gone = copies.select("doc")
    gone = F.broadcast(gone) if copies.count() <= BROADCAST_ROWS else gone
    unique = docs.where(F.octet_length("text") >= length).join(gone, "doc", "left_anti")
    compared = materialise(compare_contexts(parse(unique, length)), "contexts")
    again = compared.where("again").select("doc", ((F.shiftright("at", 14)) - F.shiftright("at", 7).bitwiseAND(127)).alias("low"), (F.shiftright("at", 14) - F.col("at").bitwiseAND(127)).alias("high"))
    fine = compared.where("not again")
    many = materialise(fine.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("is_hot")), "hot")
    small = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    fine = fine.join(small, "gram", "left").select("doc", "at", "gram", F.coalesce("is_hot", F.lit(False)).alias("hot"))
    contexts = materialise(fetch_contexts(unique, fine, length), "bytes", compression="zstd")
    sorted_runs = sort_suffixes(contexts, length).unionByName(aggregate_strings(contexts, length))
    whole = copies.select("doc", F.lit(0).cast("bigint").alias("low"), "high")
    return again.unionByName(sorted_runs).unionByName(whole)


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    if not GRAM < length <= GRAM + 126:
        raise ValueError("the length must exceed the rolling hash by 126 bytes at most")
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_of("text").alias("text"))
    runs = repeated_runs(texts.select("doc", "text"), length, hot)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    return cut_out(texts.join(runs, "doc", "left").select("doc_id", "text", "runs"), length)
