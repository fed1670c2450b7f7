"""Token-ID output: Parquet list columns, read selectively.

Documents are dealt by ranges of doc_id, tokenised where they land, and written as Parquet with a ``list<int>`` column.
Token ids are dictionary encoded (a page of 16-bit indexes), doc_id and lengths delta encoded (version 2 pages), row
groups and pages are kept small, and the column indexes that the writer adds let a reader skip pages by doc_id. A reader
of lengths alone does not touch the ids.

Cases: a null or empty text is the end id alone; repeated doc_ids are ordered by text and follow each other; an empty
table gives empty files; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, lean, scratch_path, steps, string_buffer, text_of

#: Bytes of text whose distinct parts are encoded together, and bytes of parts that the library gets at a time.
PART_STEP, CALL_BYTES = 16 << 20, 64 << 10
#: Parts whose ids a worker keeps for the next step, the most frequent ones that occurred more than once.
KEPT_PARTS = 300_000
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
FILE_SCHEMA = "doc_id bigint, shard int, place bigint, n_tokens bigint, ids array<int>"
_WORKERS: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The library's tokenizer, the bytes that each id stands for, and the parts that are kept with their ids and numbers of ids."""
    if path not in _WORKERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        sizes = np.zeros(t.get_vocab_size(), np.int64)
        for piece, i in t.get_vocab().items():
            sizes[i] = len(piece)  # a character of the byte-level alphabet for each byte
        _WORKERS[path] = (t, sizes, [pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)])
    return _WORKERS[path]


#: ASCII white space; bytes that may end a character which some take for white space; first bytes of such characters.
_SPACE, _MAYBE_LAST, _MAYBE_FIRST = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE_LAST[[*range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MAYBE_FIRST[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _joined(t, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray, between: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts that are encoded behind each other, and their numbers: the bytes of the ids tell where a part ends."""
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    gap = len(between)
    for a, b in steps(offsets, CALL_BYTES):
        text = data[offsets[a] : offsets[b]].tobytes()
        at = offsets[a : b + 1] - offsets[a]
        if gap:
            text = between.join(text[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist()))
        some = np.array(t.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(0, np.cumsum(sizes[some]))
        begin = at[:-1] + gap * np.arange(b - a)
        low, high = np.searchsorted(ends, begin), np.searchsorted(ends, begin + np.diff(at))
        if (ends[low] != begin).any() or (ends[high] - ends[low] != np.diff(at)).any():
            raise ValueError("an id reaches over the end of a part")
        ids.append(some if not gap else some[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())])
        counts.append(high - low)
    return np.concatenate(ids), np.concatenate(counts)


def _encode_parts(t, sizes: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct parts, and their numbers, in the parts' order.

    Parts with white space before and none behind stand behind each other as they may in a text; those without white space get
    line ends between; what may end in white space beyond ASCII, white space alone and whole texts are encoded by themselves.
    """
    data, offsets = string_buffer(parts)
    first, last = data[offsets[:-1]], data[offsets[1:] - 1]
    clean = ~_SPACE[last] & ~_MAYBE_LAST[last] & (np.diff(offsets) < CALL_BYTES)
    kinds = np.where(clean & _SPACE[first], 0, np.where(clean & ~_MAYBE_FIRST[first], 1, 2))
    order = np.argsort(kinds, kind="stable")
    ids, counts = [], []
    for kind, between in enumerate((b"", b"\n")):
        some = string_buffer(parts.take(pa.array(np.flatnonzero(kinds == kind))))
        found, n = _joined(t, sizes, *some, between)
        ids.append(found)
        counts.append(n)
    alone = [e.ids for e in t.encode_batch_fast([x.decode() for x in parts.take(pa.array(np.flatnonzero(kinds == 2))).to_pylist()], add_special_tokens=False)]
    ids.append(np.array([i for x in alone for i in x], np.uint32))
    counts.append(np.array([len(x) for x in alone], np.int64))
    flat, n = np.concatenate(ids), np.concatenate(counts)
    begin = np.cumsum(n) - n
    back = np.argsort(order)
    return _gather(flat, begin[back], n[back]), n[back]


def _gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` behind each other."""
    total = np.cumsum(n)
    return flat[np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(n) else 0)]


def _part_starts(raw: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Where parts begin: at each text, before each run of white space, and behind a line end that is a run of its own.

    The tokenizer's pattern starts a new piece there whatever stands before. Where a neighbour might be white space beyond
    ASCII there is no cut, and none in a text with the literal of a special token, which is that token, as by the library's default.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    space = _SPACE[raw]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last = raw[at - 1]
    unsure = _MAYBE_LAST[last] & ((last < 0x80) | (raw[at - 2] == 0xC2) | _MAYBE_FIRST[raw[at - 3]])
    at = at[~unsure]
    cut[at] = True
    at = at[(raw[at] == 10) & (at + 1 < n)]
    cut[at[~space[at + 1] & ~_MAYBE_FIRST[raw[at + 1]]] + 1] = True
    data = raw.tobytes() if specials else b""
    for s in specials:
        found = data.find(s)
        while found >= 0:
            row = int(np.searchsorted(offsets, found, side="right"))
            cut[offsets[row - 1] : offsets[row]] = False
            found = data.find(s, int(offsets[row]))
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


def encode_buffer(raw: np.ndarray, offsets: np.ndarray, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their number in each, by the tokenizers library without adding special tokens.

    Each distinct part of the texts is encoded once, many in a call, and its ids are put at all its places.
    """
    t, sizes, kept = _tokenizer(path)
    starts = _part_starts(raw, offsets, [a.content.encode() for a in t.get_added_tokens_decoder().values()])
    where = np.append(starts, len(raw)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    parts, slots, first = array.dictionary, array.indices.to_numpy(), np.searchsorted(starts, offsets)
    known = pc.fill_null(pc.index_in(parts, value_set=kept[0]), -1).to_numpy().astype(np.int64)
    late = np.flatnonzero(known < 0)
    new_flat, new_n = _encode_parts(t, sizes, parts.take(pa.array(late)))
    known[late] = len(kept[2]) + np.arange(len(late))
    flat, n = np.append(kept[1], new_flat), np.append(kept[2], new_n)
    begin, n = (np.cumsum(n) - n)[known], n[known]
    times = np.bincount(slots, minlength=len(parts))
    frequent = np.flatnonzero(times > 1)
    frequent = frequent[np.argsort(-times[frequent], kind="stable")[:KEPT_PARTS]]
    kept[:] = [parts.take(pa.array(frequent)), _gather(flat, begin[frequent], n[frequent]), n[frequent]]
    if end_id is not None:
        slots = np.insert(slots, first[1:], len(n))
        first = first + np.arange(len(first))
        begin, n, flat = np.append(begin, len(flat)), np.append(n, 1), np.append(flat, np.uint32(end_id))
    return _gather(flat, begin[slots], n[slots]), np.diff(np.append(0, np.cumsum(n[slots]))[first])


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    ids, n = encode_buffer(*string_buffer(pa.array(texts, pa.string())), path)
    return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write (doc_id, shard, place, n_tokens, ids) of all documents in ascending doc_id; shards follow each other, and place counts the ids before in a shard."""

    def encode(batches):
        shard, place = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, PART_STEP):
            raw, offsets = string_buffer(batch.column(1))
            for a, b in steps(offsets, PART_STEP):
                ids, n = encode_buffer(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tokenizer, end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, shard, np.int32)), pa.array(place + ends - n), pa.array(n), lists], names=["doc_id", "shard", "place", "n_tokens", "ids"])
                place += int(ends[-1])

    rows = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(encode), FILE_SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def token_digests(files: DataFrame) -> DataFrame:
    """Per document of a token file: start in the whole stream, length with the end id, crc32 of the ids as written."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            off = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:])], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off).astype(np.int64)), pa.array(crc)], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "shard", "place", "ids").mapInArrow(lean(digest), "doc_id bigint, shard int, place bigint, n_tokens bigint, ids_crc32 bigint")
    # one row a file part; the ids are not read
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return rows.join(sums, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokenise_to_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files and return the digests read back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(read_tokens(spark, path))
