"""Places in a global order against sorting."""

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from molkeys.operators.ranks import numbered


def test_places_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cls string, v int")
    got = {r.id: (r.p, r.n) for r in numbered(df, [(F.col("v"), Column.desc_nulls_last), F.col("id")], ["cls"], "p", "n").collect()}
    want = {}
    for cls in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == cls), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: (k, len(own)) for k, r in enumerate(own, 1)}
    assert got == want


def test_places_of_the_whole_and_of_nothing(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit("x").alias("place"), F.lit(1).alias("_own"))
    got = numbered(df, [F.col("id")], name="nth")
    assert got.columns == ["id", "place", "_own", "nth"] and got.where("nth <> id + 1").count() == 0 and got.count() == 1000
    assert numbered(df.where("id < 0"), [F.col("id")], ["place"]).count() == 0
