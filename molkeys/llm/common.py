"""Shared pieces: scratch tables, byte-level word hashing for Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on, whatever the size of the Arrow batch.
STEP_BYTES = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a single machine where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="molkeys-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Narrow rows that one task writes, where their number is known.
ROWS_A_FILE = 250_000


def materialise(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows`` is a bound of narrow rows, where one is known: a small table is then written as few files, however many tasks made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files behind materialised frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def for_long_texts(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, unless the session has a bound of its own: texts are long, and each task holds a few batches."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", {"67108864b", "64m", "67108864", None}
    if spark.conf.get(name, None) in default:
        spark.conf.set(name, "8m")


def lean(run):
    """A function of Arrow batches after which the worker, which Spark keeps for a while, holds no freed memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def gathered(batches, least: int):
    """Arrow batches put together to so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_of(column: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values, without a copy where possible."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type):
        array = array.cast(pa.large_string())
    elif pa.types.is_binary(array.type):
        array = array.cast(pa.large_binary())
    array = pc.fill_null(array, "" if pa.types.is_large_string(array.type) else b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, budget: int = STEP_BYTES):
    """Row ranges whose bytes stay near the budget; a longer single value is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n + 1, base), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS: tuple[np.ndarray, np.ndarray] | None = None
#: Random values of the bytes, the same in every process.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) <= n:
        _POWERS = _odd_powers(max(n, STEP_BYTES + 4096))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every input bit over the 64 of the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial; ``span_hash`` takes the hash of any span from them."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes in each value, and the row of each run."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    is_in = inside[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = is_in.copy()
    starts[1:] &= ~is_in[:-1] | edge[1:n]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, k: int, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and their rows; a value of fewer words, but not none, is one run."""
    starts, ends, row = words_of(raw, offsets, inside)
    h = span_hash(byte_prefix(raw), starts, ends)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    acc = np.zeros(len(h), np.uint64)
    for j in range(k):
        acc[: len(h) - j] += h[j:] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 + 2 * j & 0xFFFFFFFFFFFFFFFF | 1)
    whole = np.arange(len(h)) + k <= first[row + 1] if len(h) else np.zeros(0, bool)
    out, rows = mix(acc[whole]), row[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            v = np.array([counts[r]], np.uint64)
            for j in range(first[r], first[r + 1]):
                v = mix(v * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
            extra[i] = v[0]
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
    return out, rows


#: Nodes of the forest that a task holds before it gives it out and begins another.
FOREST_NODES = 1 << 20


def tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the roots, with the smallest node that it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        before = up.copy()
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, before):
            break
    inner = up != np.arange(len(nodes))
    return nodes[inner], nodes[up[inner]]


def forest_of(batches):
    """Spanning forests (a, b) of the edges (a, b) in Arrow batches, in bounded memory: what connected stays so."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = tree(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        if len(a) > FOREST_NODES:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            a = b = np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Edges of thinned forests, by their counted number, that one task closes: 8 MB.
FEW_EDGES = 500_000


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is the smallest node reachable.

    Each task thins the edges that it reads to a forest, before anything is shuffled. Forests of at most ``few`` edges in all are closed by one task, for
    rounds of jobs over so few rows cost the driver more than the rows are. For more, large-star and small-star steps alternate: each is one aggregate for
    the smallest neighbour and one join, so a hub is split like any skewed join. Each round is written to the shared
    folder, and the rounds end when the edges' count and sum of hashes stay. Loops are ignored.
    """

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    thin = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(forest_of, "a bigint, b bigint")
    # forests are small beside what made them: as many files as the cluster has cores, twice
    cur = materialise(thin.repartition(2 * edges.sparkSession.sparkContext.defaultParallelism), name)
    seen = print_of(cur)
    closed = seen[0] <= few
    if closed and seen[0]:
        one = materialise(cur.coalesce(1).mapInArrow(lean(forest_of), "a bigint, b bigint"), name)  # a forest of that size is given out whole: each node with its smallest one
        forget(cur)
        cur = one
    for _ in range(0 if closed else rounds):
        few = cur.mapInArrow(forest_of, "a bigint, b bigint")
        both = few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low2, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialise(small.select("e.*").where("a <> b").distinct(), name, rows=2 * seen[0])
        forget(cur)
        cur, before = new, seen
        seen = print_of(cur)
        if seen == before:
            break
    else:
        if not closed:
            raise RuntimeError("components have not settled")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
