import pytest
from pyspark.sql import functions as F

from molkeys.functions import geometry
from molkeys.operators import triplets
from molkeys.plans import catalogue

# hand-computed cases: atoms (code, x, y, z), order of the input places, distance bin, angle bin, key, mirrored key
CASES = [
    ([(106, 0, 0, 0), (108, 1.5, 0, 0), (109, 1.5, 2, 0)], 3, 16, 713491075, 713491075),
    ([(109, 0, 0, 0), (106, 1.4, 0, 0), (106, 2, 1.5, 0)], 3, 25, 713374156, -713374156),
    ([(108, 0, 0, 0), (108, 3, 0, 0), (106, 1, 1, 0)], 4, 19, 706943139, 706943139),
    ([(106, 0, 0, 0), (106, 1.5, 0, 0), (106, 2.5, 1, 0.5)], 3, 29, 693730256, -693730256),
    ([(106, 0, 0, 0), (106, 2, 0, 0), (106, 1, 3, 0)], 4, 19, 693730275, -693730275),
    ([(106, 0, 0, 0), (106, 0, 3, 4), (106, 3, 0, 4)], 6, 25, 693730339, 693730339),
    ([(109, 0, 0, 0), (108, 20, 0, 0), (106, 5, 6, 0)], 18, 14, 713491508, -713491508),
]


@pytest.mark.parametrize("mirror", [False, True])
def test_keys_of_hand_computed_triplets(spark, mirror):
    rows = [(i, k, *map(float, a[1:]), a[0]) for i, c in enumerate(CASES) for k, a in enumerate(c[0])]
    atoms = spark.createDataFrame(rows, "s int, idx int, x double, y double, z double, code int")
    got = {r.s: (r.dist_bin, r.theta_bin, r.key) for r in triplets.triplet_keys(atoms, ["s"], mirror=mirror).collect()}
    assert got == {i: (c[1], c[2], c[4 if mirror else 3]) for i, c in enumerate(CASES)}


def test_degenerate_triplets_are_errors(spark):
    # only a leading pair in one place leaves no angle; a trailing one is seen under 0 degrees
    rows = [(0, 0, 0.0, 5), (0, 1, 0.0, 5), (0, 2, 1.0, 4), (1, 0, 0.0, 5), (1, 1, 1.0, 5), (2, 0, 0.0, 5), (2, 1, 0.0, 5), (2, 2, 1.0, 6)]
    atoms = spark.createDataFrame(rows, "s int, idx int, x double, code int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = triplets.triplet_keys(atoms, ["s"]).collect()
    assert {(r.s, r.error, r.theta_bin) for r in got} == {(0, "degenerate", None), (2, None, 1)}


def test_bins_at_their_edges(spark):
    rows = spark.createDataFrame([(12.11,), (12.1,), (90.0,), (89.99,), (0.0,)], "t double")
    got = rows.select(geometry.theta_bin(F.col("t")).alias("a"), geometry.theta_bin(F.col("t"), lenient=True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(2, 2), (1, 1), (None, 29), (29, 29), (1, 1)]
    d = spark.createDataFrame([(0.5,), (1.0,), (17.0,), (40.0,)], "d double").select(geometry.distance_bin(F.col("d")).alias("b")).collect()
    assert [r.b for r in d] == [1, 2, 18, 18]


@pytest.mark.parametrize("name", ["chain_triplets", "mirror_keys", "triplet_bins", "triplet_summary", "search_atoms"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name):
    # the JVM interprets methods of 8000 bytes or more, however often they run
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
