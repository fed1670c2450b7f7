"""N-gram Jaccard self-join with signature trees.

1. Texts become sets of hashed word shingles; equal sets are one class from then on, whatever its number of copies.
2. A fixed-size count sketch of all shingles gives a global order, rarest first. Two sets can only link if the heads of
   their sets in that order meet, so classes are grouped by the head shingles they share: those of a shingle are put in
   order of size and chained wherever sizes allow a link, and chains are closed by connected components. Frequent
   passages come last in the order and join nothing by themselves.
3. Each group is compared in bounded blocks, dealt to tasks as pairs of blocks whose size levels can link. Inside,
   documents are the leaves of signature trees: each node holds the OR of its documents' token bitmaps, its range of set
   sizes and the largest number of tokens that a bitmap hides. Two trees are walked together; a pair of nodes is left when
   the largest overlap it can have is below the least that a link needs.
4. Groups beyond a block, mostly long texts that meet by chance, are walked on bitmaps alone first and fall apart into
   those that the bitmaps cannot tell apart. Then whole sets are shipped, and surviving pairs are verified on them.
   Documents that are already connected are not compared again, since only components are asked for.

Cases: null or empty texts, and texts without words, have an empty set and link with nothing; fewer words than the shingle
length are one shingle; copies share a class; rows that share a doc_id are reported one by one; a class whose ids are all
null links with nothing and its component is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, forest_of, forget, lean, materialise, mix, shingle_hashes, steps, string_buffer, text_of

#: Counters of the sketch (2 bytes each in a task, 1 byte on a scale of logarithms when broadcast: 16 MB whatever the input),
#: and the pieces that it is summed in.
SKETCH, PIECES = 1 << 24, 64
MOST = np.iinfo(np.uint16).max
#: Sets of a block and bytes of their payloads; a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Least and most bits of a document's bitmap; documents of a leaf node, and leaf nodes of an upper node.
BITS, WIDEST, FAN = 1024, 1 << 20, 8
#: Classes that a task remembers, to leave out copies.
SEEN = 500_000
#: Identifiers that may be broadcast, by their counted number.
BROADCAST_ROWS = 500_000


def sets_of(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and their rows."""
    h, row = shingle_hashes(LOWER[raw], offsets, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _class_of(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(row, minlength=rows)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=total[1:])
    at = np.concatenate([[0], np.cumsum(n)])
    return n, mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, piece): a row for each document, and each task's count sketch in pieces (n = -1)."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.uint16)
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            for a, b in steps(offsets):
                h, row = sets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n, cls = _class_of(h, row, b - a)
                at, more = np.unique(h & np.uint64(SKETCH - 1), return_counts=True)
                sketch[at] = np.minimum(sketch[at] + more, MOST)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n.astype(np.int64)), pa.array(cls), pa.nulls(b - a, pa.binary())], names=["doc_id", "n", "cls", "piece"])
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(x.tobytes()) for x in sketch.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.array(np.full(PIECES, -1)), pa.array(np.zeros(PIECES, np.int64)), pa.array(parts, pa.binary())], names=["doc_id", "n", "cls", "piece"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, cls bigint, piece binary")


def sketch_of(described: DataFrame) -> np.ndarray:
    """The tasks' sketches summed, piece by piece and one at a time; always ``SKETCH`` numbers, on a scale of logarithms."""

    def add(batches):
        opener = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(opener.decompress(data.as_py()), np.uint16).astype(np.uint32)
                sums[piece] = sums[piece] + x if piece in sums else x
        if sums:
            scaled = [np.minimum(np.rint(16 * np.log2(1.0 + x)), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(scaled, pa.binary())], names=["piece", "data"])

    pieces = described.where("n = -1").select(F.col("doc_id").alias("p"), "piece").repartition(PIECES, "p")
    out = np.zeros((PIECES, SKETCH // PIECES), np.uint8)
    for r in pieces.mapInArrow(lean(add), "piece bigint, data binary").collect():
        out[r.piece] = np.frombuffer(r.data, np.uint8)
    return out.reshape(-1)


def heads(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, n, cls): the rarest shingles of each set, as many as any linked set must meet."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts, seen = shared.value, set()
        for batch in batches:
            raw, offsets = string_buffer(batch.column(0))
            for a, b in steps(offsets):
                h, row = sets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n, cls = _class_of(h, row, b - a)
                keep = np.zeros(b - a, bool)
                for i, c in enumerate(cls.tolist()):  # further copies add nothing
                    if c not in seen:
                        keep[i] = True
                        if len(seen) < SEEN:
                            seen.add(c)
                h, row = h[keep[row]], row[keep[row]]
                order = np.lexsort((h, counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)], row))
                h, row = h[order], row[order]
                first = np.searchsorted(row, np.arange(b - a))
                head = np.arange(len(h)) - first[row] <= n[row] - (percent * n[row] + 99) // 100
                yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(n[row[head]].astype(np.int32)), pa.array(cls[row[head]])], names=["token", "n", "cls"])

    return docs.select(text_of("text").alias("text")).mapInArrow(lean(run), "token bigint, n int, cls bigint")


def chains(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): neighbours in size of each head shingle's classes whose sizes allow a link, thinned to forests.

    Where neighbours are too far apart, so is every pair across the gap. One row is kept between batches.
    """

    def run(batches):
        last = None
        for batch in batches:
            token, n, cls = (batch.column(c).to_numpy() for c in range(3))
            if not len(token):
                continue
            if last is not None:
                token, n, cls = (np.append(v, x) for v, x in zip(last, (token, n, cls)))
            last = token[-1:], n[-1:], cls[-1:]
            near = (token[1:] == token[:-1]) & (cls[1:] != cls[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls[1:][near]), pa.array(cls[:-1][near])], names=["a", "b"])

    rows = tokens.repartition("token").sortWithinPartitions("token", "n", "cls")
    return rows.select("token", "n", "cls").mapInArrow(lambda batches: forest_of(run(batches)), "a bigint, b bigint")


def bitmap_of(h: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(h >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def payloads(wanted: DataFrame, k: int, whole: bool) -> DataFrame:
    """(doc_id, grp, n, data) of texts whose class is the one wanted of them: their whole sets, or bitmaps of 4 bits a shingle."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            want = batch.column(2).to_numpy()
            for a, b in steps(offsets):
                h, row = sets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n, cls = _class_of(h, row, b - a)
                at = np.concatenate([[0], np.cumsum(n)])
                good = np.flatnonzero(cls == want[a:b])
                parts = [h[at[i] : at[i + 1]] for i in good]
                if not whole:
                    parts = [bitmap_of(x, min(max(BITS, 4 << (len(x) - 1).bit_length()), WIDEST)) for x in parts]
                take = pa.array(good + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(3).take(take), pa.array(n[good].astype(np.int64)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "grp", "n", "data"])

    return wanted.select("doc_id", text_of("text").alias("text"), "cls", "grp").mapInArrow(lean(run), "doc_id bigint, grp bigint, n bigint, data binary")


class Tree:
    """Signature tree over documents in a given order: leaves of FAN, upper nodes of FAN leaves; sets where they are known."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, maps: np.ndarray, sets: list[np.ndarray] | None = None):
        self.ids, self.n, self.sets = ids, n, sets
        levels = [(maps, n, n, n - np.bitwise_count(maps).sum(1, dtype=np.int64))]
        for _ in range(2):
            m, low, high, hidden = levels[-1]
            cut = np.arange(0, len(m), FAN)
            levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)))
        self.levels = levels


def tree_of_sets(rows: list[tuple[int, int, bytes]]) -> Tree:
    """Documents by their smallest shingle, which near copies mostly share."""
    sets = [np.frombuffer(x[2], np.uint64) for x in rows]
    order = np.argsort([s[0] for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    maps = np.stack([bitmap_of(s, BITS) for s in sets]).view(np.uint64)
    return Tree(np.array([x[0] for x in rows], np.int64)[order], np.array([len(s) for s in sets], np.int64), maps, sets)


def trees_of_bitmaps(sides: list[list[tuple[int, int, bytes]]]) -> list[Tree]:
    """Documents by size; all bitmaps are folded to the narrowest of the unit."""
    width = min(len(x[2]) for side in sides for x in side) // 8

    def fold(data: bytes) -> np.ndarray:
        return np.bitwise_or.reduce(np.frombuffer(data, np.uint64).reshape(-1, width), axis=0)

    out = []
    for side in sides:
        side = sorted(side, key=lambda x: (x[1], x[0]))
        out.append(Tree(np.array([x[0] for x in side], np.int64), np.array([x[1] for x in side], np.int64), np.stack([fold(x[2]) for x in side])))
    return out


def may_link(p, q, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of node pairs: whether the largest possible overlap reaches the least that a link needs, and sizes agree."""
    (pm, pl, ph, px), (qm, ql, qh, qx) = p, q
    out = (100 * qh[j] >= percent * pl[i]) & (100 * ph[i] >= percent * ql[j])
    every = np.flatnonzero(out)
    slab = max(1, (1 << 20) // pm.shape[1])
    for at in range(0, len(every), slab):
        some = every[at : at + slab]
        x, y = i[some], j[some]
        common = np.bitwise_count(pm[x] & qm[y]).sum(1, dtype=np.int64)
        most = np.minimum(common + np.minimum(px[x], qx[y]), np.minimum(ph[x], qh[y]))
        out[some] = most * (100 + percent) >= percent * (pl[x] + ql[y])
    return out


def _children(i: np.ndarray, j: np.ndarray, ni: int, nj: int) -> tuple[np.ndarray, np.ndarray]:
    a = (i[:, None] * FAN + np.arange(FAN)).repeat(FAN, axis=1).ravel()
    b = np.tile(j[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
    good = (a < ni) & (b < nj)
    return a[good], b[good]


class Links:
    """Union-find over the documents of a unit."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((int(self.up[a]), int(self.up[b])))
        self.up[self.up == high] = low


def overlaps(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(ys)
    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
    return np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum([0] + [len(y) for y in ys[:-1]]))


def links_of_unit(left: Tree, right: Tree, percent: int) -> list[tuple[int, int]]:
    """Links that connect all documents of two trees (or of one) which links connect at all; without sets, what may be links."""
    same = left is right
    base = 0 if same else len(left.ids)
    links, found = Links(base + len(right.ids)), []
    i, j = (x.ravel() for x in np.indices((len(left.levels[2][0]), len(right.levels[2][0]))))
    for level in (2, 1):
        keep = may_link(left.levels[level], right.levels[level], i, j, percent)
        if same:
            keep &= i <= j
        i, j = i[keep], j[keep]
        if level == 2:
            i, j = _children(i, j, len(left.levels[1][0]), len(right.levels[1][0]))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for leaf in np.unique(i):
        others = j[slice(*np.searchsorted(i, [leaf, leaf + 1]))]
        docs = (others[:, None] * FAN + np.arange(FAN)).ravel()
        docs = docs[docs < len(right.ids)]
        for x in range(leaf * FAN, min((leaf + 1) * FAN, len(left.ids))):
            ys = docs[docs > x] if same else docs
            ys = ys[links.up[base + ys] != links.up[x]]
            if not len(ys):
                continue
            ys = ys[may_link(left.levels[0], right.levels[0], np.full(len(ys), x), ys, percent)]
            while len(ys):  # one of each component at a time: its link makes the others needless
                _, one = np.unique(links.up[base + ys], return_index=True)
                good = ys[one]
                if left.sets is not None:
                    common = overlaps(left.sets[x], [right.sets[y] for y in good])
                    good = good[100 * common >= percent * (left.n[x] + right.n[good] - common)]
                for y in good:
                    found.append((int(left.ids[x]), int(right.ids[y])))
                    links.join(x, base + y)
                ys = np.delete(ys, one)
                ys = ys[links.up[base + ys] != links.up[x]]
    return found


def compare_units(rows: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b) links of (unit, side, doc_id, n, data) rows, unit by unit."""

    def run(batches):
        both, unit = ({}, {}), None

        def links():
            sides = [[(d, n, x) for d, (n, x) in side.items()] for side in both if side]
            trees = [tree_of_sets(side) for side in sides] if whole else trees_of_bitmaps(sides)
            found = links_of_unit(trees[0], trees[-1], percent)
            a, b = (list(x) for x in zip(*found)) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for u, side, doc, n, data in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                if u != unit and unit is not None:
                    yield links()
                    both = ({}, {})
                unit = u
                both[side][doc] = (n, data.as_py())  # repeated rows are one document
        if unit is not None:
            yield links()

    rows = rows.select("unit", "side", "doc_id", "n", "data").repartition("unit").sortWithinPartitions("unit", "side")
    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def deal_units(sets: DataFrame, percent: int) -> DataFrame:
    """(unit, side, doc_id, n, data): a small group is one unit; of a large one, each pair of blocks that can link."""
    # sizes two or more levels apart differ by more than a link allows
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    fill = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("data").cast("bigint")) / BLOCK_BYTES)
    # large groups, their blocks and the units of these are few beside the sets, which are shuffled once, by unit
    many = _few(sets.groupBy("grp").agg(fill.alias("total")).where("total > 1").select("grp"))
    small = sets.join(many, "grp", "left_anti").select(F.xxhash64("grp").alias("unit"), F.lit(0).alias("side"), "doc_id", "n", "data")
    large = sets.join(many, "grp", "left_semi").withColumn("level", level)
    sizes = _few(large.groupBy("grp", "level").agg(F.ceil(fill).cast("int").alias("blocks")))
    large = large.join(sizes, ["grp", "level"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    blocks = sizes.select("grp", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = blocks.select("grp", F.col("level").alias("level2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "grp").where("level2 = level + 1 or (level2 = level and block2 >= block)")
    unit = F.xxhash64("grp", "level", "block", "level2", "block2")
    places = pairs.select(unit.alias("unit"), "grp", F.explode(F.array_distinct(F.array(F.struct("level", "block", F.lit(0).alias("side")), F.struct(F.col("level2").alias("level"), F.col("block2").alias("block"), F.when(F.expr("level = level2 and block = block2"), 0).otherwise(1).alias("side"))))).alias("p")).select("unit", "grp", "p.*")
    return small.unionByName(large.join(_few(places), ["grp", "level", "block"]).select("unit", "side", "doc_id", "n", "data"))


def _few(df: DataFrame) -> DataFrame:
    """A table written out, and broadcast if its counted rows are within the bound."""
    df = materialise(df, "few")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def jaccard_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest doc_id that links of at least ``percent`` reach)."""
    if not 1 <= percent < 100:
        raise ValueError("the similarity must be from 1 to 99 percent")
    docs = docs.select("doc_id", text_of("text").alias("text"))
    described = materialise(describe(docs, k), "sets")
    own = described.where("n >= 0").select("doc_id", "n", "cls")
    classes = materialise(own.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes", rows=own.count())
    tokens = heads(docs, sketch_of(described), k, percent)
    groups = connected_components(chains(tokens, percent), "groups").select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    n_active = groups.count()
    active = materialise(groups.join(classes, "cls").where("rep is not null"), "active", rows=n_active)

    def texts_of(some: DataFrame) -> DataFrame:
        some = F.broadcast(some) if n_active <= BROADCAST_ROWS else some
        return docs.join(some, docs["doc_id"] == some["rep"])

    big = active.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK).select("grp")
    crowd = materialise(active.join(big, "grp"), "crowd", rows=n_active)
    maps = materialise(payloads(texts_of(crowd), k, whole=False), "bitmaps")
    alike = connected_components(compare_units(deal_units(maps, percent), percent, whole=False), "alike")
    rest = active.join(big, "grp", "left_anti").unionByName(crowd.join(alike, F.col("rep") == F.col("node")).select(F.col("component").alias("grp"), "cls", "rep"))
    rest = materialise(rest, "rest", rows=n_active)
    sets = materialise(payloads(texts_of(rest), k, whole=True), "whole")
    found = connected_components(compare_units(deal_units(sets, percent), percent, whole=True), "links")
    forget(sets, maps, crowd, active, rest)
    by_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    out = own.where("n > 0").join(by_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
