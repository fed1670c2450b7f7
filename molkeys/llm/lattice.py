"""SentencePiece encoding and decoding over a relational lattice.

Texts are escaped as the model does (a space is U+2581, one is put in front) and cut into units where no piece can cross: the
piece table decides which neighbouring kinds of characters ever share a piece. Units are exploded into substrings of bounded
length and joined to the piece table; the edges are grouped by unit and folded with a higher-order
aggregate.

The ``COMMON`` most frequent units are encoded first and broadcast, a table of bounded rows and bytes. All other units are
encoded where they stand: a pass over the texts writes each row, with the ids of its common units and its other units;
the broadcast join to the piece table keeps their order, so edges are grouped by unit, and ids put back into their row,
by neighbourhood. No text, unit or id is shuffled. The ids of every row are then decoded and compared with its text, by a digest of 128 bits.

Two folds are there. ``viterbi_ids`` is the best path by summed scores, for unigram models. For a BPE model the best path is
not what the library gives; there ``merged_ids`` folds over the edges, best first: an edge joins if exactly two current symbols
make it up. A merge may let an earlier edge join only if a better piece contains its piece, which the piece table marks;
units where that happens are folded once more with a search for the best edge at each step. Boundaries are the bits of a long, so
it takes units up to ``LONGEST`` characters; longer ones take the same path or merges in the Python task. A character without a
piece becomes its bytes. Common units are folded by higher-order functions; of the others a task folds those of a batch of edges together, edge by
edge (``folded_cuts``), and puts the ids into their rows in the same go.

Cases: null or empty texts have no ids; U+2581 in a text is read as a space, as by the library, so such texts come back
with spaces and are not exact; repeated rows and rows that share a doc_id are encoded and reported each; texts and units may be of any length; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, lean, materialise, steps, string_buffer, text_of

SPACE = "▁"
#: Characters of a unit that bits can hold; units whose ids are broadcast; units that a task counts at a time.
LONGEST, COMMON, COUNTED = 61, 150_000, 300_000
#: Characters by which the lengths of pieces at a place are narrowed.
HEAD = 3
#: The id part of an edge without a piece, and the mark of an edge whose piece is a part of a better one.
UNKNOWN, INNER = (1 << 24) - 1, 1 << 31
#: Bytes of text of a step.
STEP = 1 << 20
#: Kinds of bytes: spaces, ASCII letters, digits and marks, and bytes of other characters.
KINDS = np.full(256, 4, np.int8)
KINDS[:128] = 3
KINDS[[*range(65, 91), *range(97, 123)]], KINDS[48:58], KINDS[32] = 1, 2, 0


@dataclass
class Model:
    pieces: list[tuple[str, int, float]]  # piece, id, score of normal pieces; at most the vocabulary's size
    byte_base: int  # id of <0x00>; the other bytes follow
    longest: int
    kind: str  # "unigram" or "bpe"


def _model_kind(data: bytes) -> str:
    """The model type of the trainer's part of a model file (fields 2 and 3; 1 is unigram, the default, 2 is BPE)."""

    def fields(buf: bytes):
        at = 0

        def varint():
            nonlocal at
            out = shift = 0
            while True:
                b = buf[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(buf):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, buf[at : at + n]
                at += n
            else:
                size = 8 if tag & 7 == 1 else 4
                yield tag >> 3, struct.unpack("<d" if size == 8 else "<f", buf[at : at + size])[0]
                at += size

    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return "bpe" if dict(fields(trainer)).get(3, 1) == 2 else "unigram"


def load_model(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(len(sp))]
    normal = [x for x in every if not (sp.is_byte(x[1]) or sp.is_control(x[1]) or sp.is_unknown(x[1]) or sp.is_unused(x[1]))]
    base = next(i for p, i, _ in every if p == "<0x00>")
    if any(every[base + b][0] != f"<0x{b:02X}>" for b in range(256)):
        raise ValueError("the byte pieces do not follow each other")
    with open(path, "rb") as f:
        kind = _model_kind(f.read())
    return Model(normal, base, max(len(p) for p, _, _ in normal), kind)


def escaped(text: Column) -> Column:
    """The text with a space in front and U+2581 as spaces; empty texts stay empty."""
    return F.when(text != "", F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" ")))).otherwise(F.lit(""))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, unit): the units of every whole text in order."""
    parts = F.split(F.translate(escaped(text_of("text")), " ", SPACE), f"(?<=[^{SPACE}])(?={SPACE})")
    return docs.where(text_of("text") != "").select("doc_id", F.posexplode(parts).alias("pos", "unit"))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(key, its, packed): the hashes and pieces of the vocabulary; packed holds the place of the score among all scores, best first, the id, and ``INNER``."""
    places = {x: i for i, x in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    place = {p: places[s] for p, _, s in model.pieces}
    inner = {q for p in place for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) in place and place[q] > place[p]}
    table = spark.createDataFrame([(p, places[s] << 40 | i | (INNER if p in inner else 0)) for p, i, s in model.pieces], "its string, packed bigint")
    table = table.withColumn("key", F.xxhash64("its"))
    if table.select("key").distinct().count() < len(model.pieces):
        raise ValueError("two pieces of the vocabulary have the same hash")
    return table


def lengths_by_head(spark: SparkSession, model: Model) -> DataFrame:
    """(head_key, head, lengths): for each beginning of ``HEAD`` characters of a piece, the lengths that pieces at a place with it can have, and 1."""
    known, lengths = {p for p, _, _ in model.pieces}, {}
    for p in known:
        if len(p) >= HEAD:
            lengths.setdefault(p[:HEAD], set()).add(len(p))
    rows = [(h, sorted(x | {1} | {k for k in range(2, HEAD) if h[:k] in known})) for h, x in lengths.items()]
    return spark.createDataFrame(rows, "head string, lengths array<int>").withColumn("head_key", F.xxhash64("head"))


def substrings(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with an edge for each piece in their unit, and for each single character without one; rows without a unit get the edge -1.

    An edge is a long: place of its score, start (bits 32 on), length (bits 24 on) and id, so that edges sort by score and start.
    """
    n = F.char_length("unit")
    some = rows.select("*", F.explode_outer(F.sequence(F.lit(0), n - 1)).alias("start"))
    # only lengths that some piece with the first characters here has: both tables are of the vocabulary's size
    some = some.withColumn("own_head", F.substr("unit", F.col("start") + 1, F.lit(HEAD))).withColumn("head_key", F.xxhash64("own_head"))
    some = some.join(F.broadcast(lengths_by_head(rows.sparkSession, model)), "head_key", "left")
    shorter = F.array(*[F.lit(k) for k in range(1, HEAD)])
    some = some.select(*rows.columns, "start", F.explode_outer(F.when(n.isNotNull(), F.when(F.col("own_head") == F.col("head"), F.col("lengths")).otherwise(shorter))).alias("len"))
    some = some.where(n.isNull() | (F.col("len") <= n - F.col("start")))
    some = some.withColumn("piece", F.substr("unit", F.col("start") + 1, F.col("len"))).withColumn("key", F.xxhash64("piece"))
    # the vocabulary is a fixed table of some ten thousand rows; a join on longs takes half the time of one on strings, and the pieces are compared after it
    joined = some.join(F.broadcast(piece_table(rows.sparkSession, model)), "key", "left").withColumn("packed", F.when(F.col("piece") == F.col("its"), F.col("packed")))
    joined = joined.where("packed is not null or len = 1 or unit is null")
    where = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("len").cast("bigint"), 24))
    edge = F.when(F.col("unit").isNull(), F.lit(-1).cast("bigint")).otherwise(F.coalesce("packed", F.lit(UNKNOWN)).bitwiseOR(where))
    return joined.select(*rows.columns, "start", "len", edge.alias("edge"))


def edges(distinct: DataFrame, model: Model) -> DataFrame:
    """(unit, n, edges): the edges of each unit, best first."""
    return substrings(distinct.select("unit", "n"), model).groupBy("unit").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))


def _start(e: Column) -> Column:
    return F.shiftright(e, 32).bitwiseAND(255).cast("int")


def _len(e: Column) -> Column:
    return F.shiftright(e, 24).bitwiseAND(63).cast("int")


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def _ids(e: Column, model: Model) -> Column:
    """The id of an edge, or those of its character's bytes."""
    hexes = F.hex(F.encode(F.substr("unit", _start(e) + 1, F.lit(1)), "UTF-8"))
    in_bytes = F.transform(F.sequence(F.lit(1), F.length(hexes), F.lit(2)), lambda i: (F.conv(F.substr(hexes, i, F.lit(2)), 16, 10).cast("int") + model.byte_base))
    known = e.bitwiseAND(UNKNOWN).cast("int")
    return F.when(known != UNKNOWN, F.array(known)).otherwise(in_bytes)


def with_joins(rows: DataFrame) -> DataFrame:
    """Rows with the bits of each edge of two characters or more: its ends, and the places inside it."""
    ends = lambda e: F.call_function("shiftleft", _bit(_len(e)) + 1, _start(e))
    inner = lambda e: F.call_function("shiftleft", _bit(_len(e) - 1) - 1, _start(e) + 1)
    return rows.withColumn("joins", F.transform(F.filter("edges", lambda e: _len(e) > 1), lambda e: F.struct(e.alias("e"), ends(e).alias("ends"), inner(e).alias("inner"))))


def merged_cuts() -> Column:
    """The merges of ``joins``, which are sorted by score and start, over ``unit``; the places between symbols are bits."""
    every = _bit(F.char_length("unit") + 1) - 1
    can = lambda cuts, j: (cuts.bitwiseAND(j["ends"]) == j["ends"]) & (F.bit_count(cuts.bitwiseAND(j["inner"])) == 1)

    def once(cuts, j):
        after = cuts.bitwiseAND(F.bitwise_not(j["inner"]))
        earlier = j["e"].bitwiseAND(F.lit(INNER)).cast("boolean") & F.exists("joins", lambda g: (g["e"] < j["e"]) & can(after, g))
        return F.when((cuts > 0) & can(cuts, j), F.when(earlier, F.lit(-1).cast("bigint")).otherwise(after)).otherwise(cuts)

    def again(cuts, _):
        best = F.get(F.filter("joins", lambda j: can(cuts, j)), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(best["inner"])), cuts)

    searched = F.aggregate("joins", every, again)  # a unit has no more merges than edges
    return F.aggregate("joins", every, once, lambda cuts: F.when(cuts > 0, cuts).otherwise(searched))


def merged_ids(model: Model) -> Column:
    """Ids of ``unit`` by the merges of ``joins``, from ``edges``."""

    def tokens(cuts):
        span = lambda e: F.call_function("shiftleft", _bit(_len(e) + 1) - 1, _start(e))
        held = lambda e: cuts.bitwiseAND(span(e)) == F.call_function("shiftleft", _bit(_len(e)) + 1, _start(e))
        return F.sort_array(F.transform(F.filter("edges", held), lambda e: F.shiftleft(e.bitwiseAND((1 << 40) - 1), 16)))

    # the cuts are folded once and then used for each edge
    found = F.aggregate(F.array(merged_cuts()), F.array().cast("array<bigint>"), lambda _, c: tokens(c))
    return F.flatten(F.transform(found, lambda t: _ids(F.shiftright(t, 16), model)))


def viterbi_ids(model: Model) -> Column:
    """Ids of ``unit`` on the path of ``edges`` with the largest summed score; an unknown character costs more than any piece."""
    n = F.char_length("unit")
    worst = min(s for _, _, s in model.pieces) - 10.0
    by_id = {i: s for _, i, s in model.pieces}
    scores = F.from_json(F.lit(str([by_id.get(i, 0.0) for i in range(max(by_id) + 1)])), "array<double>")
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.array().cast("array<int>").alias("ids")))
    ordered = F.array_sort(F.transform("edges", lambda e: F.struct(_start(e).alias("start"), _len(e).alias("len"), F.coalesce(F.get(scores, e.bitwiseAND(UNKNOWN).cast("int")), F.lit(worst)).alias("score"), _ids(e, model).alias("ids"))))

    def step(best, e):
        origin = F.get(best, e["start"])
        score = origin["score"] + e["score"]
        better = lambda x, i: F.when((i == e["start"] + e["len"]) & (score > x["score"]), F.struct(score.alias("score"), F.concat(origin["ids"], e["ids"]).alias("ids"))).otherwise(x)
        return F.transform(best, better)

    return F.aggregate(ordered, start, step, lambda best: F.get(best, n)["ids"])


def heap_merges(unit: str, ranks: dict[str, tuple[int, float]], longest: int, byte_base: int) -> list[int]:
    """The same merges for one long unit: a heap of pairs, stale entries skipped."""
    symbols, left, right = list(unit), list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := right[i]) >= 0:
            both = symbols[i] + symbols[j]
            if len(both) <= longest and both in ranks:
                heapq.heappush(heap, (-ranks[both][1], i, j, both))

    for k in range(len(unit) - 1):
        offer(k)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out: list[int] = []
    for s in filter(None, symbols):
        out += [ranks[s][0]] if s in ranks else [byte_base + b for b in s.encode()]
    return out


def best_path(unit: str, ranks: dict[str, tuple[int, float]], longest: int, byte_base: int) -> list[int]:
    """The path of one long unit with the largest summed score."""
    worst = min(s for _, s in ranks.values()) - 10.0
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for end in range(1, len(unit) + 1):
        options = [(best[at][0] + ranks[p][1], at, [ranks[p][0]]) for at in range(max(0, end - longest), end) if (p := unit[at:end]) in ranks]
        if unit[end - 1] not in ranks:
            options.append((best[end - 1][0] + worst, end - 1, [byte_base + b for b in unit[end - 1].encode()]))
        best.append(max(options, key=lambda x: x[0]))
    out: list[list[int]] = []
    at = len(unit)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


def fold(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with the ids of their unit from its edges, instead of these."""
    if model.kind != "bpe":
        return rows.withColumn("ids", F.when(F.col("unit").isNotNull(), viterbi_ids(model))).drop("edges")
    return with_joins(rows).withColumn("ids", F.when(F.col("unit").isNotNull(), merged_ids(model))).drop("edges", "joins")


def long_ids(model: Model):
    """A function of a unit of any length that gives its ids."""
    ranks = {p: (i, s) for p, i, s in model.pieces}
    path = heap_merges if model.kind == "bpe" else best_path
    return lambda unit: path(unit, ranks, model.longest, model.byte_base)


def encode_units(distinct: DataFrame, model: Model) -> DataFrame:
    """(unit, n, ids) of distinct units with their frequency n."""
    short = fold(edges(distinct.where(F.char_length("unit") <= LONGEST), model), model).select("unit", "n", "ids")

    def run(batches):
        ids_of = long_ids(model)
        for batch in batches:
            ids = [ids_of(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["unit", "n", "ids"])

    return short.unionByName(distinct.where(F.char_length("unit") > LONGEST).select("unit", "n").mapInArrow(lean(run), "unit string, n bigint, ids array<int>"))


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, pos, unit, ids): the long form of the encoding; ids of a text are those of its units in order."""
    rows = units(docs)
    known = encode_units(rows.groupBy("unit").agg(F.count("*").alias("n")), model).select("unit", "ids")
    return rows.join(known, "unit").select("doc_id", "pos", "unit", "ids")


def token_arrays(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids) from the long form."""
    rows = encoded.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return rows.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def cuts_of(model: Model) -> np.ndarray:
    """Between which kinds of bytes no piece reaches over, by the neighbours that the pieces have."""
    out = np.ones((5, 5), bool)
    for p, _, _ in model.pieces:
        kinds = KINDS[np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)]
        out[kinds[:-1], kinds[1:]] = False
    out[0, 0] = out[4, 4] = False
    return out


def _cut(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where units begin in escaped texts, and the units, with spaces as such."""
    kinds = KINDS[raw]
    new = np.zeros(len(raw) + 1, bool)
    new[1:-1] = cuts[kinds[:-1], kinds[1:]]
    new[offsets] = True
    starts = np.flatnonzero(new[: len(raw)])
    where = np.append(starts, len(raw)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(np.ascontiguousarray(raw))])
    return starts, array.dictionary_encode()


def frequent_units(docs: DataFrame, model: Model) -> DataFrame:
    """(unit, n): at most ``COMMON`` units that tasks have counted more than once. It only decides where a unit is encoded."""
    cuts = cuts_of(model)

    def run(batches):
        held, rows = [], 0

        def summed():
            table = pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])
            return table.filter(pc.greater(table["n"], 1))

        for batch in batches:
            raw, offsets = string_buffer(batch.column(0))
            for a, b in steps(offsets, 2 * STEP):
                _, found = _cut(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], cuts)
                n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                held.append(pa.table({"unit": found.dictionary, "n": pa.array(n.astype(np.int64))}))
                rows += len(n)
                if rows > COUNTED:
                    yield from summed().to_batches()
                    held, rows = [], 0
            del batch, raw, offsets
            pa.default_memory_pool().release_unused()
        if held:
            yield from summed().to_batches()

    counted = docs.select(escaped(text_of("text")).alias("text")).mapInArrow(lean(run), "unit string, n bigint")
    counted = counted.groupBy("unit").agg(F.sum("n").alias("n")).where(F.char_length("unit") <= LONGEST)
    return counted.orderBy(F.desc("n"), "unit").limit(COMMON).withColumn("unit", F.translate("unit", " ", SPACE))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values behind each other and lengths of lists; null lists are empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.cumsum(n)
    return flat[np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(n) else 0)]


def _lists(flat: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat, kind))


#: A row on its way: no doc_id, free of U+2581, doc_id, units, known ids, open units, digest of the escaped text; the ids and places follow.
HEADER = "<??qqqq16s"


def id_type(model: Model) -> np.dtype:
    """The type of ids in packed rows."""
    last = max([model.byte_base + 255, *(i for _, i, _ in model.pieces)])
    return np.dtype("<u2" if last < 1 << 16 else "<i4")


def digest(text) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def open_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(row, units): each row packed with its known ids and the places of its open units; a null, then these units.

    One column holds what only goes along, since each column costs time for each edge that leaves for a Python task.
    """
    table = encode_units(frequent_units(docs, model).repartition("unit"), model).toArrow()  # at most COMMON units of LONGEST characters
    flat, n = _flat(table["ids"])
    common = docs.sparkSession.sparkContext.broadcast((pc.replace_substring(table["unit"].cast(pa.large_string()).combine_chunks(), SPACE, " "), flat.astype(np.int32), n))

    cuts, kind = cuts_of(model), id_type(model)

    def run(batches):
        words, flat, n = common.value
        ids_of = long_ids(model)
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            data = packed = None
            for a, b in steps(offsets, STEP):
                off = offsets[a : b + 1] - offsets[a]
                starts, parts = _cut(raw[offsets[a] : offsets[b]], off, cuts)
                slots, first = parts.indices.to_numpy(), np.searchsorted(starts, off)
                known = pc.fill_null(pc.index_in(parts.dictionary, value_set=words), -1).to_numpy().astype(np.int64)
                every, count = flat, n
                long = np.flatnonzero((known < 0) & (pc.utf8_length(parts.dictionary).to_numpy() > LONGEST))
                if len(long):
                    more = [ids_of(x.replace(" ", SPACE)) for x in parts.dictionary.take(pa.array(long)).to_pylist()]
                    known[long] = len(n) + np.arange(len(long))
                    every, count = np.append(flat, np.concatenate(more).astype(np.int32)), np.append(n, [len(x) for x in more])
                slot, count = known[slots], np.append(count, 0)  # the last one stands for open units
                size = count[slot]
                before = np.append(0, np.cumsum(size))
                own = _gather(every, (np.cumsum(count) - count)[slot], size)
                gaps = np.flatnonzero(slot < 0)
                row = np.searchsorted(first, gaps, side="right") - 1
                order = np.argsort(np.append(np.arange(b - a), row), kind="stable")  # each row, then its gaps
                gap = order - (b - a)
                heads = np.append(np.flatnonzero(gap < 0), len(gap)).astype(np.int32)
                of_gap = pa.array(np.where(gap >= 0, gap, 0), mask=gap < 0)
                unit = pc.replace_substring(parts.dictionary.take(pa.array(slots[gaps])), " ", SPACE)
                data, own = memoryview(raw[offsets[a] : offsets[b]].tobytes()), own.astype(kind)
                at, at_id = (before[gaps] - before[first[row]]).astype("<i4"), before[first].tolist()
                at_gap = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                fields = zip(batch.column(0)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), np.diff(first).tolist(), at_id, at_id[1:], at_gap, at_gap[1:], off.tolist(), off[1:].tolist())
                packed = [struct.pack(HEADER, d is None, p, d or 0, u, j - i, h - g, digest(data[x:y])) + own[i:j].tobytes() + at[g:h].tobytes() for d, p, u, i, j, g, h, x, y in fields]
                opened = pa.ListArray.from_arrays(pa.array(heads), unit.take(of_gap).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), opened], names=["row", "units"])
            del batch, raw, offsets, data, packed  # before the next batch comes
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("bigint"), escaped(text_of("text")).alias("text"), (~F.contains(text_of("text"), F.lit(SPACE))).alias("plain"))
    return rows.mapInArrow(lean(run), "row binary, units array<string>")


def open_units(rows: DataFrame) -> DataFrame:
    """(row, unit): a row for each of the units of ``open_rows``; only the first, without unit, holds ``row``."""
    return rows.select("row", F.posexplode("units").alias("pos", "unit")).select(F.when(F.col("pos") == 0, F.col("row")).alias("row"), "unit")


def _bits(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and the bits of both ends of edges."""
    start, length = edge >> 32 & 255, edge >> 24 & 63
    return start, length, (1 << length) + 1 << start


def folded_cuts(n_chars: np.ndarray, count: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The fold of ``merged_cuts`` over many units at once: their places between symbols, as bits.

    ``edge`` has the edges of two characters or more, ``count`` of each unit, best first. In step k all units take their k-th edge; those where an
    earlier edge could join after that are folded once more, with the best edge of each at each step.
    """
    start, length, ends = _bits(edge)
    inner = (1 << length - 1) - 1 << start + 1
    begin = np.cumsum(count) - count
    can = lambda cuts, at: (cuts & ends[at] == ends[at]) & (np.bitwise_count(cuts & inner[at]) == 1)
    every = (1 << n_chars.astype(np.int64) + 1) - 1
    cuts, order = every.copy(), np.argsort(-count, kind="stable")
    for k in range(count[order[0]] if len(order) else 0):
        order = order[: np.searchsorted(-count[order], -k)]  # those with an edge k
        some = order[cuts[order] > 0]
        at, before = begin[some] + k, cuts[some]
        good = can(before, at)
        some, at = some[good], at[good]
        after = before[good] & ~inner[at]
        check = np.flatnonzero(edge[at] & INNER) if k else ()
        if len(check):
            earlier = can(after[check, None], begin[some[check], None] + np.arange(k)).any(1)
            after[check[earlier]] = -1
        cuts[some] = after
    again = np.flatnonzero(cuts < 0)
    slab = max(1, (1 << 20) // max(1, count.max(initial=0)))
    for i in range(0, len(again), slab):
        some = again[i : i + slab]
        now, k = every[some], np.arange(count[some].max())
        there = k < count[some, None]
        at = np.where(there, begin[some, None] + k, 0)
        while True:
            joins = there & can(now[:, None], at)
            best, left = joins.argmax(1), joins.any(1)
            if not left.any():
                break
            now = np.where(left, now & ~inner[at[np.arange(len(some)), best]], now)
        cuts[some] = now
    return cuts


def grouped_edges(batches, merges: bool):
    """Batches (row, edges) of the rows of ``open_units`` again, with the edges of their units; with ``merges`` also the ``cuts`` of these.

    An edge of start 0 and length 1, or -1, begins a row.
    """
    held = None

    def done(table, heads):
        rows, edge, n = table["row"].take(pa.array(heads[:-1])).combine_chunks(), table["edge"].to_numpy(), np.diff(heads)
        out = [rows, _lists(edge, n, pa.int64())]
        if merges:
            own = np.flatnonzero(edge[heads[:-1]] >= 0)
            of = np.repeat(np.arange(len(n)), n)
            join = np.flatnonzero((edge >= 0) & ((edge >> 24 & 63) > 1))
            join = join[np.lexsort((edge[join], of[join]))]
            count = np.bincount(of[join], minlength=len(n))[own]
            cuts, mask = np.zeros(len(n), np.int64), np.ones(len(n), bool)
            cuts[own] = folded_cuts(pc.utf8_length(rows.take(pa.array(own)).cast(pa.string())).to_numpy(), count, edge[join])
            mask[own] = False
            out.append(pa.array(cuts, mask=mask))
        return pa.RecordBatch.from_arrays(out, names=["row", "edges", "cuts"][: len(out)])

    for batch in gathered(batches, STEP):
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        edge = table["edge"].to_numpy()
        heads = np.flatnonzero((edge < 0) | ((edge >> 24 & 0xFF3F) == 1))
        if not len(heads):
            continue  # without rows, since a task's first one begins a row
        held = table.slice(heads[-1])
        if len(heads) > 1:
            yield done(table.slice(0, heads[-1]), heads)
    if held is not None:
        yield done(held, np.array([0, len(held)]))


def held_ids(rows: pa.Table, chars: pa.Array, char_ids: np.ndarray, byte_base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the symbols between two neighbouring ``cuts``, behind each other, and their numbers by row.

    A symbol of several characters is an edge; one character is looked up among ``chars``, or becomes its bytes.
    """
    edge, n = _flat(rows["edges"])
    of = np.repeat(np.arange(len(rows)), n)
    start, length, ends = _bits(edge)
    cuts = pc.fill_null(rows["cuts"], 0).to_numpy()
    held = np.flatnonzero((edge >= 0) & (length > 1) & (cuts[of] & (1 << length + 1) - 1 << start == ends))
    places, ids, units = [of[held] << 8 | start[held]], [edge[held] & UNKNOWN], rows["row"].combine_chunks()
    bare: list[tuple[int, bytes]] = []
    for i in range(LONGEST):
        single = np.flatnonzero((cuts >> i & 3) == 3)
        if len(single):
            own = pc.utf8_slice_codeunits(units.take(pa.array(single)).cast(pa.string()), i, i + 1)
            at = pc.fill_null(pc.index_in(own, value_set=chars), -1).to_numpy()
            places.append(single << 8 | i)
            ids.append(char_ids[at])  # the last one, UNKNOWN, for -1
            bare += [(places[-1][k], own[k].as_py().encode()) for k in np.flatnonzero(at < 0).tolist()]
    order = np.argsort(np.concatenate(places))
    of, ids = np.concatenate(places)[order] >> 8, np.concatenate(ids)[order]
    if bare:
        as_bytes = [c for _, c in sorted(bare)]
        count = np.ones(len(ids), np.int64)
        count[ids == UNKNOWN] = [len(c) for c in as_bytes]
        ids, of = np.repeat(ids, count), np.repeat(of, count)
        ids[ids == UNKNOWN] = byte_base + np.frombuffer(b"".join(as_bytes), np.uint8).astype(np.int64)
    return ids, np.bincount(of, minlength=len(rows)).astype(np.int64)


def encode_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_units, ids, exact) of every row: its ids in order, and whether they decode to its own text."""
    base, size = model.byte_base, 1 + max([model.byte_base + 255, *(i for _, i, _ in model.pieces)])
    names = ["doc_id", "n_units", "ids", "exact"]
    merges, kind = model.kind == "bpe", id_type(model)
    last, start = ("cuts" if merges else "ids"), struct.calcsize(HEADER)
    chars = {p: i for p, i, _ in model.pieces if len(p) == 1}
    char_ids = np.array([*chars.values(), UNKNOWN], np.int64)

    def close(batches):
        table = [b""] * size
        for p, i, _ in model.pieces:
            table[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            table[base + b] = bytes([b])
        piece, length = np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table])
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            heads = np.flatnonzero(rows[last].is_null().to_numpy())
            held = rows.slice(heads[-1])
            yield from done(rows.slice(0, heads[-1]), heads[:-1], piece, length)
        if held is not None:
            yield from done(held, np.array([0]), piece, length)

    def done(rows, heads, piece, length):
        if not len(rows):
            return
        firsts = [x.as_py() for x in rows["row"].combine_chunks().take(pa.array(heads))]
        fields = [struct.unpack_from(HEADER, x) for x in firsts]
        n = np.array([f[4] for f in fields], np.int64)
        known = np.concatenate([np.frombuffer(x, kind, k, start) for x, k in zip(firsts, n)])
        places = np.concatenate([np.frombuffer(x, "<i4", f[5], start + kind.itemsize * f[4]) for x, f in zip(firsts, fields)])
        open_ids, more = held_ids(rows, pa.array(list(chars), pa.string()), char_ids, base) if merges else _flat(rows["ids"])
        row = np.searchsorted(heads, np.arange(len(rows)), side="right") - 1
        base_of = np.cumsum(n) - n
        gap = np.setdiff1d(np.arange(len(rows)), heads, assume_unique=True)
        at = places + base_of[row[gap]]
        shift = np.cumsum(np.bincount(at, more[gap], minlength=len(known) + 1)).astype(np.int64)
        place = np.arange(len(known)) + shift[: len(known)]
        ids = np.empty(len(known) + len(open_ids), np.int32)
        inside = np.ones(len(ids), bool)
        inside[place] = False
        ids[place], ids[inside] = known, open_ids
        total = n + np.bincount(row, more, minlength=len(heads)).astype(np.int64)
        begin = np.cumsum(length) - length
        text = _gather(piece, begin[ids], length[ids]).tobytes()
        ends = np.append(0, np.cumsum(length[ids]))[np.append(0, np.cumsum(total))].tolist()
        exact = [f[1] and digest(text[a:b]) == f[6] for f, a, b in zip(fields, ends, ends[1:])]
        out = pa.table([pa.array([None if f[0] else f[2] for f in fields], pa.int64()), pa.array([f[3] for f in fields], pa.int64()), _lists(ids, total, pa.int32()), pa.array(exact, pa.bool_())], names=names)
        yield from out.combine_chunks().to_batches()

    # written, so that a task of each pass has two Python workers at most
    rows = open_units(materialise(open_rows(docs, model), "open", compression="zstd"))
    rows = substrings(rows, model)
    if merges:  # an edge of one character joins nothing; the first one of a unit stands for it on its way
        rows = rows.where("unit is null or len > 1 or start = 0")
    # ``row`` or ``unit``, of which each row has one, is sent as the one column ``row``
    head = F.col("unit").isNull() | ((F.col("start") == 0) & (F.col("len") == 1))
    rows = rows.select(F.when(head, F.coalesce("row", F.col("unit").cast("binary"))).alias("row"), "edge")
    out = "doc_id bigint, n_units bigint, ids array<int>, exact boolean"
    if merges:  # the edges of a task are grouped, folded and put into their rows in one go
        return rows.mapInArrow(lean(lambda batches: close(grouped_edges(batches, True))), out)
    rows = rows.mapInArrow(lean(lambda batches: grouped_edges(batches, False)), "row binary, edges array<bigint>")
    rows = rows.withColumn("unit", F.when(F.get("edges", F.lit(0)) >= 0, F.col("row").cast("string")))
    return fold(rows, model).select("row", "ids").mapInArrow(lean(close), out)


def encode_summary(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_units, n_tokens, ids_hash (of the ids in their order), exact (whether they decode to the text), ids."""
    rows = encode_rows(docs, model)
    ids_hash = F.when(F.size("ids") > 0, F.xxhash64("ids")).otherwise(F.lit(0).cast("bigint"))
    return rows.select("doc_id", "n_units", F.size("ids").cast("long").alias("n_tokens"), ids_hash.alias("ids_hash"), "exact", "ids")
