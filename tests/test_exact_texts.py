"""Decimal texts of doubles against Python's, and triplets of large groups against combinations."""

import random
import struct
from itertools import combinations

from pyspark.sql import functions as F

from molkeys.functions.identifiers import half_even
from molkeys.operators import triplets


def test_texts_equal_pythons(spark):
    rng = random.Random(8)
    values = [0.35, 0.15, 2.675, 2.25, 0.5, 1.5, 2.5, -0.0, 0.0, -0.04, 0.05, 0.95, 0.9995, 9.995, 999.9999, 1e-320, 5e-324, 2.0**52 + 0.5, 2.0**53 + 2, 4503599627370495.5, 1e15 + 0.3, 1e18, 2.0**62, 2.0**63, 1.2345e19, 3e34]
    values += [rng.randrange(-(10**7), 10**7) / 10 ** rng.randrange(1, 6) for _ in range(40_000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 34) for _ in range(30_000)]
    values += [(rng.randrange(2000) + 0.5) / 10 ** rng.randrange(1, 4) for _ in range(10_000)]
    bits = (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(40_000))
    values += [v for v in bits if abs(v) < 2.0**115]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", *[half_even(F.col("v"), d).alias(f"t{d}") for d in (0, 1, 3)]).collect():
        assert (r.t0, r.t1, r.t3) == ("%.0f" % r.v, "%.1f" % r.v, "%.3f" % r.v), r
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1e200,)], "v double")
    assert [r.t for r in odd.select(half_even(F.col("v"), 1).alias("t")).collect()] == [None] * 4


def test_large_groups_are_cut_into_blocks(spark):
    sizes = {1: 2, 2: 3, 3: 16, 4: 17, 5: 70}
    rows = [(g, i, i % 5 + 1, float(i), 0.0, 1.0) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    atoms = spark.createDataFrame(rows, "g int, idx int, code int, x double, y double, z double")
    got = triplets.enumerate_triplets(atoms, ["g"], block=16)
    want = {(g, *c) for g, n in sizes.items() for c in combinations(range(n), 3)}
    found = [(r.g, r.a_idx, r.b_idx, r.c_idx) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    # units of a large group are spread
    wide = triplets.enumerate_triplets(atoms.where("g = 5"), ["g"], block=4).withColumn("p", F.spark_partition_id())
    assert wide.select("p").distinct().count() > 1 and wide.count() == 70 * 69 * 68 // 6


def test_a_chain_of_thousands_of_atoms(spark):
    atoms = spark.range(5000).selectExpr("1 as g", "id as idx", "1 as code", "double(id) as x", "0D as y", "0D as z")
    some = triplets.enumerate_triplets(atoms, ["g"])
    # the first block's triples with any later pair of blocks are there; only a part of 2 * 10^10 rows is read
    assert some.where("a_idx = 0").limit(100_000).count() == 100_000
