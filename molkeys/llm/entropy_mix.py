"""Mixing sources to target weights by entropy balancing.

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating; together they take ``share`` of all words, none more than
``most`` times its own, and what one leaves goes to the others by weight.

Rates: of all rates r between 0 and ``most`` under which each source yields its target of words, those nearest to one copy of each
document in relative entropy are r = min(most, exp(lambda * size)), with one multiplier for each source. The multipliers solve the convex
dual by Newton steps, kept within a bracket, for all sources at once. Rates depend on source and size alone, so the steps run over the
counts of documents by (source, size), which say the same as the documents.

Copies: the counts times rates are rounded along each source's sizes, so that no partial sum is off by more than half a copy; what is
then left of a source's target, at most some long documents, goes to shorter and shorter ones. Within a (source, size), the documents
that get one copy more are the first by hash; groups of many are cut into buckets by another hash, which take their share in turn.

DataFrame functions only. Sums of the steps are those of whole numbers, in units of a thousandth of a word, so their order does not matter and reruns agree.
A window holds the distinct sizes of a source, bounded by the longest text, or one bucket.

Cases: null and empty texts and those without words have size 0 and are never taken; a source of such texts has target 0; rows that
share a doc_id are documents of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molkeys.operators.ranks import numbered

from .common import forget, materialise, text_of

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents of a bucket, on average; a bucket is the largest group of documents that one task orders.
BUCKET = 512
#: Newton steps, far more than any bracket needs.
STEPS = 100


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size)."""
    return docs.select("doc_id", "source", F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"))


def targets(cells: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(nth, source, source_size, least, target) of every source, from the counts (source, size, n)."""
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = numbered(sources, [(F.col("source"), Column.asc_nulls_last)], name="nth")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumns({"weight": weight, "cap": most * F.col("source_size")}), "sources")
    total = F.sum("source_size").cast("double") * share
    level, capped = 0.0, -1
    while True:
        # words for each unit of weight, given the sources that stop; a source that stops never starts again
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, rest, open_weight = sources.agg(F.count_if(full), total - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = rest / open_weight, n
    full = F.col("cap") <= F.lit(level) * F.col("weight")
    return sources.select("nth", "source", "source_size", "least", F.when(full, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def rate(multiplier: str, size: str, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col(multiplier) * F.col(size)))


def multipliers(cells: DataFrame, sources: DataFrame, most: int = 2) -> DataFrame:
    """(nth, multiplier) of every source with words, from counts (nth, size, n): Newton steps on the dual, all sources in each step."""
    ratio = F.col("target") / F.col("source_size")
    low = F.when(ratio < 1, F.log(ratio) / F.col("least")).otherwise(0.0)
    high = F.when(ratio < 1, 0.0).otherwise(F.log(F.lit(float(most))) / F.col("least"))
    # at most times its size the bracket's end is the answer
    state = sources.where("source_size > 0").select("nth", "target", low.alias("low"), high.alias("high"), F.when(ratio >= most, high).otherwise(0.0).alias("at"), (ratio >= most).alias("done"))
    state = materialise(state, "multipliers")
    units = lambda x: F.sum(F.round(x * 1000).cast("decimal(38,0)")).cast("double") / 1000
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        r = rate("at", "size", most)
        words = F.col("n") * F.col("size") * r
        sums = cells.join(state.where("not done").select("nth", "at"), "nth").groupBy("nth").agg(units(words).alias("words"), units(F.when(r < most, words * F.col("size")).otherwise(0.0)).alias("slope"))
        both = state.join(sums, "nth", "left")
        over = F.col("words") - F.col("target")
        low, high = F.when(over < 0, F.col("at")).otherwise(F.col("low")), F.when(over >= 0, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - F.try_divide(over, F.col("slope"))
        inside = F.coalesce((newton > F.col("l")) & (newton < F.col("h")), F.lit(False))
        moved = both.withColumns({"l": low, "h": high, "newton": newton}).withColumn("next", F.when(inside, F.col("newton")).otherwise((F.col("l") + F.col("h")) / 2))
        done = (F.abs(over) < 0.5) | (F.col("h") - F.col("l") <= 1e-15 * F.abs(F.col("at"))) | (F.col("next") == F.col("at"))
        stop = moved.withColumn("stop", F.col("done") | F.coalesce(done, F.lit(False)))
        new = materialise(stop.select("nth", "target", *[F.when(F.col("done"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("low", "l"), ("high", "h"))], F.when(F.col("stop"), F.col("at")).otherwise(F.col("next")).alias("at"), F.col("stop").alias("done")), "multipliers")
        forget(state)
        state = new
    return state.select("nth", F.col("at").alias("multiplier"))


def copies_by_size(cells: DataFrame, sources: DataFrame, found: DataFrame, most: int = 2) -> DataFrame:
    """(nth, size, n, copies): how many copies all documents of a source and size get together."""
    along = Window.partitionBy("nth").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rates = cells.where("size > 0").join(found, "nth").withColumn("wanted", F.col("n") * rate("multiplier", "size", most))
    upto = F.sum("wanted").over(along)
    rounded = rates.withColumn("copies", (F.round(upto) - F.round(upto - F.col("wanted"))).cast("long"))
    rounded = rounded.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), most * F.col("n"))).select("nth", "size", "n", "copies")
    rounded = materialise(rounded, "rounded")

    # what is left, and of each power of two the size with most room to give or take
    left = rounded.groupBy("nth").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).join(sources.select("nth", "target"), "nth").select("nth", F.round(F.col("target") - F.col("words")).cast("long").alias("left"))
    room = F.when(F.col("left") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    rooms = rounded.join(left.where("left <> 0"), "nth").withColumn("room", room).where("room > 0")
    best = rooms.groupBy("nth", "left", F.floor(F.log2("size")).alias("level")).agg(F.max(F.struct("room", F.col("size").alias("z"))).alias("b"))
    # at most one item for each power of two
    steps = best.groupBy("nth", "left").agg(F.sort_array(F.collect_list(F.struct(F.col("b.z").alias("size"), F.col("b.room").alias("room"))), asc=False).alias("items"))
    fold = """aggregate(items, struct(abs(left) as rest, cast(array() as array<struct<size:bigint,change:bigint>>) as made), (a, x) -> struct(
        a.rest - x.size * least(x.room, a.rest div x.size) as rest, concat(a.made, array(struct(x.size as size, least(x.room, a.rest div x.size) as change))) as made)).made"""
    changes = steps.select("nth", F.sign("left").cast("long").alias("sign"), F.explode(F.expr(fold)).alias("c")).select("nth", F.col("c.size").alias("size"), (F.col("sign") * F.col("c.change")).alias("change"))
    return rounded.join(changes, ["nth", "size"], "left").select("nth", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of every document."""
    sizes = materialise(sizes_of(docs), "sizes")
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = materialise(targets(counted, share, most, weights), "targets")
    named = counted.withColumnRenamed("source", "of").join(sources.select("nth", "source"), F.col("of").eqNullSafe(F.col("source"))).select("nth", "size", "n")
    cells = materialise(named, "cells")
    copies = copies_by_size(cells, sources, multipliers(cells, sources, most), most)
    plan = cells.join(copies.drop("n"), ["nth", "size"], "left").join(sources, "nth").withColumn("copies", F.coalesce("copies", F.lit(0)))
    plan = plan.select(F.col("source").alias("of"), F.col("size").alias("z"), "nth", "n", "source_size", "target", F.expr("copies div n").alias("each"), F.expr("copies % n").alias("more"))
    plan = materialise(plan, "plan")

    # the documents that take one copy more than the others of their source and size: the first of them by bucket and hash
    b = F.pmod(F.xxhash64("doc_id"), 1 + F.expr(f"n div {int(bucket)}"))
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("z"))).withColumn("b", b)
    many = rows.where((F.col("more") > 0) & (F.col("n") >= bucket)).groupBy("nth", "size", "b").agg(F.count("*").alias("in_b"))
    upto = F.sum("in_b").over(Window.partitionBy("nth", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = many.select("nth", "size", "b", (upto - F.col("in_b")).alias("before"))
    rows = rows.join(before, ["nth", "size", "b"], "left")
    first = F.row_number().over(Window.partitionBy("nth", "size", "b").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id"))
    taken = F.col("each") + (first + F.coalesce("before", F.lit(0)) <= F.col("more")).cast("long")
    return rows.withColumn("copies", taken).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
