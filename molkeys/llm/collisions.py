"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random lines. Of a pair with the threshold's cosine, the projections differ on
each line by a normal variable of known deviation, so the number of lines on which the partner lies in the window centred on
the query is binomial; ``calibrated`` takes the largest count that such a pair still reaches with the wanted recall. Pairs
that pass the count are verified by their cosine in double precision, so no pair below the threshold is linked.

Vectors that are equal, or equal but for a power of two, are one class from the start. Classes are sorted along the first line into wide cells, and these are split into blocks of bounded size; pairs of blocks whose cells can meet are dealt to tasks, and there each line
is sorted, the windows are found by binary search, and collisions are counted. A task gives out how many links each vector has and a forest of
them, not the links. Nothing is joined all against all: a block
meets the blocks of its own label within reach on the first line only, and those whose labels are null meet none.

Cases: vectors that are null, zero, or hold null or non-finite components, and null labels, link with nothing; vectors of
other lengths are compared with their own length only; repeated vec_ids are separate vectors under one id and their
links are counted for the id; labels of any type are compared as they are, texts and fractions too; components may be as large or small as
doubles are; a pair exactly at the threshold is linked; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, materialise, tree

PROJECTIONS = 32
#: Half width of the windows, in deviations of a unit vector's projection.
WINDOW = 0.9
#: Width of a cell on the first line: a pair at the threshold is in the same or neighbouring cells but for some 6 in 100,000.
CELL = 1.5
#: Chance that a pair at the threshold passes the count.
RECALL = 0.9999
#: Vectors of a block; a task holds two.
BLOCK = 1024


def within(window: float, cosine: float) -> float:
    """Chance that the projections of two unit vectors of this cosine differ by the window at most."""
    return math.erf(window / math.sqrt(2 * max(2 - 2 * cosine, 1e-12)))


def calibrated(cosine: float, lines: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair of this cosine reaches with the recall."""
    p, miss, k = within(window, cosine), 0.0, 0
    while k < lines and (miss := miss + math.comb(lines, k) * p**k * (1 - p) ** (lines - k)) <= 1 - recall:
        k += 1
    return k


def lines_of(dim: int, lines: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, lines))


def project(vectors: DataFrame, key: str, label: str, column: str) -> DataFrame:
    """(id, label, dim, cell, vec) of the vectors that can link; vec is the vector in double precision, scaled."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                v = values[at[rows][:, None] + np.arange(d)]
                most = np.abs(v).max(1)
                good = np.isfinite(most) & (most > 0)
                # by a power of two, which changes no cosine, so that squares neither overflow nor vanish
                rows, v = rows[good], np.ldexp(v[good], -np.frexp(most[good])[1][:, None])
                first = (v / np.sqrt((v * v).sum(1))[:, None]) @ lines_of(int(d))[:, 0]
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(8 * d)), len(rows), [None, pa.py_buffer(np.ascontiguousarray(v + 0.0).tobytes())]).cast(pa.binary()) if len(rows) else pa.array([], pa.binary())
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(rows), d, np.int32)), pa.array(np.floor(first / CELL).astype(np.int32)), data], names=["id", "label", "dim", "cell", "vec"])

    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id bigint, label {kind}, dim int, cell int, vec binary")


def deal(classes: DataFrame) -> DataFrame:
    """(unit, side, id, copies, vec): pairs of blocks of one label whose cells are the same or neighbours."""
    where = ["label", "dim", "cell"]
    blocks = classes.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = classes.join(blocks, where).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    each = blocks.select(*where, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = each.select("label", "dim", F.col("cell").alias("cell2"), F.col("block").alias("block2"))
    reach = F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell2")
    pairs = each.select("*", reach).join(other, ["label", "dim", "cell2"]).where("cell2 > cell or block2 >= block")
    same = F.expr("cell = cell2 and block = block2")
    sides = F.array_distinct(F.array(F.struct("cell", "block", F.lit(0).alias("side")), F.struct(F.col("cell2").alias("cell"), F.col("block2").alias("block"), F.when(same, 0).otherwise(1).alias("side"))))
    places = pairs.select(F.xxhash64("label", "dim", "cell", "block", "cell2", "block2").alias("unit"), "label", "dim", F.explode(sides).alias("p")).select("unit", "label", "dim", "p.*")
    return rows.join(places, [*where, "block"]).select("unit", "side", "id", "copies", "vec")


def colliding(p: np.ndarray, q: np.ndarray, least: int, slab: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of p, row of q) whose projections lie within the window on at least so many lines.

    On each sorted line the window of a query is a run of ranks; a slab of queries adds up the runs that each candidate is in.
    """
    n, lines = q.shape
    order = np.argsort(q, axis=0, kind="stable")
    ranks = np.empty((lines, n), np.int32)
    for k in range(lines):
        ranks[k, order[:, k]] = np.arange(n, dtype=np.int32)
    sorted_q = np.take_along_axis(q, order, axis=0)
    out_i, out_j = [], []
    low = np.stack([np.searchsorted(sorted_q[:, k], p[:, k] - WINDOW, "left") for k in range(lines)], 1).astype(np.int32)
    size = np.stack([np.searchsorted(sorted_q[:, k], p[:, k] + WINDOW, "right") for k in range(lines)], 1).astype(np.int32) - low
    for a in range(0, len(p), slab):
        i, j = np.divmod(np.arange(min(slab, len(p) - a) * n), n)
        i += a
        count = np.zeros(len(i), np.int16)
        for k in range(lines):
            count += (ranks[k, j] - low[i, k]).astype(np.uint32) < size[i, k].astype(np.uint32)
            if (k & 3) == 3:  # pairs that too many lines have missed cannot pass any more
                live = count >= least - (lines - 1 - k)
                i, j, count = i[live], j[live], count[live]
        live = count >= least
        out_i.append(i[live])
        out_j.append(j[live])
    return np.concatenate(out_i), np.concatenate(out_j)


def count_and_verify(units: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n) of verified links between classes: in each unit how many vectors ``a`` links with (b null), and a forest of edges (a, b) that connects
    what the unit's links connect (n null). A unit gives rows in proportion to its own, however many links it finds."""
    least = calibrated(cosine)

    def run(batches):
        held, unit = ([], []), None

        def links():
            sides = []
            for rows in (x for x in held if x):
                v = np.stack([np.frombuffer(x[2]) for x in rows])
                u = v / np.sqrt((v * v).sum(1))[:, None]
                sides.append((np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), v, u @ lines_of(v.shape[1])))
            (ids, copies, v, p), (ids2, copies2, w, q) = sides[0], sides[-1]
            i, j = colliding(p, q, least)
            if len(sides) == 1:
                i, j = i[i < j], j[i < j]
            c = (v[i] * w[j]).sum(1) / np.sqrt((v[i] * v[i]).sum(1) * (w[j] * w[j]).sum(1))
            i, j = i[c >= cosine], j[c >= cosine]
            n, n2 = np.bincount(i, copies2[j], len(ids)).astype(np.int64), np.bincount(j, copies[i], len(ids2)).astype(np.int64)
            x, y = tree(ids[i], ids2[j])
            of = np.concatenate([ids[n > 0], ids2[n2 > 0]])
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.concat_arrays([pa.array(of), pa.array(x)]), pa.concat_arrays([none(len(of)), pa.array(y)]), pa.concat_arrays([pa.array(np.concatenate([n[n > 0], n2[n2 > 0]])), none(len(x))])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        for batch in batches:
            for u, side, i, n, vec in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if u != unit and unit is not None:
                    yield links()
                    held = ([], [])
                unit = u
                held[side].append((i, n, vec))
        if unit is not None:
            yield links()

    rows = units.repartition("unit").sortWithinPartitions("unit", "side", "id")
    return rows.select("unit", "side", "id", "copies", "vec").mapInArrow(lean(run), "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """Per vector: n_links, component_id, kept."""
    rows = materialise(project(vectors, key, label, column).withColumn("digest", F.sha2("vec", 256)).withColumn("h", F.xxhash64("label", "digest")), "vectors")
    same = ["label", "digest"]
    classes = rows.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = rows.join(classes.select("rep", *same, "copies"), same).where("id = rep").dropDuplicates(["id", *same]).select("id", "label", "dim", "cell", "vec", "copies")
    found = materialise(count_and_verify(deal(one), cosine), "links")
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = connected_components(found.where("b is not null").select("a", "b"), "near")
    by_class = classes.join(degree, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select(*same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.select("id", *same).join(by_class, same).groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(key).join(linked, F.col(key) == F.col("id"), "left")
    component = F.coalesce("component", key)
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col(key), F.lit(True)).alias("kept"))
