"""Triplet geometry as column expressions: distances, vertex order, angle, bins and the integer key.

Everything stays in generated code; there is no UDF. ``lenient`` puts an angle of exactly 90 into the last bin; otherwise it has
no bin, as in the published procedure, and the row gets an ``error``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The left-closed bins of the representative angle begin at these degrees, the first at 0.
THETA_EDGES = [12.11, 17.32, 21.53, 25.21, 28.54, 31.64, 34.55, 37.34, 40.03, 42.64, 45.17, 47.64, 50.05, 52.43, 54.77, 57.08, 59.38, 61.64, 63.87, 66.09, 68.30, 70.5, 72.69, 79.2, 81.36, 83.51, 85.67, 87.80]
THETA_END = 90.0
#: Sizes of the key's places: angle bins, distance bins, label codes.
DTHETA, DLEN, NUM_LABELS = 29, 18, 112
#: The procedure converts radians with this value.
PI = 3.14


def distance(a: str, b: str) -> Column:
    """Between two points whose coordinates are columns such as ``a_x``."""
    return F.sqrt(F.pow(F.col(f"{a}_x") - F.col(f"{b}_x"), 2) + F.pow(F.col(f"{a}_y") - F.col(f"{b}_y"), 2) + F.pow(F.col(f"{a}_z") - F.col(f"{b}_z"), 2))


def theta_bin(theta: Column, lenient: bool = False) -> Column:
    passed = reduce(lambda acc, edge: acc + (theta >= edge).cast("int"), THETA_EDGES, F.lit(1))
    inside = (theta <= THETA_END) if lenient else (theta < THETA_END)
    return F.when((theta >= 0) & inside, passed)


def distance_bin(d: Column) -> Column:
    return F.least(F.floor(d) + 1, F.lit(DLEN)).cast("int")


def fenced(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row.

    A filter on a projected column is pushed below it with the column's expression in place, and nested uses multiply
    there; it stops at a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_vertices(rows: DataFrame, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, v1_*, v2_*, v3_*) of three atoms in flat columns a_*, b_*, c_* (code, x, y, z and what is carried), in their input order.

    Codes go down. Of two equal atoms the one farther from the third comes first if the pair leads and last if it follows; if
    both are as far the earlier one counts as the farther in front and as the nearer behind. Of three equal codes the
    longest side comes first. Columns stay flat, since the optimizer inlines structs into each use of a field.
    """
    rows = rows.withColumns({"d12": distance("a", "b"), "d13": distance("a", "c"), "d23": distance("b", "c")})
    d12, d13, d23 = F.col("d12"), F.col("d13"), F.col("d23")
    cp, cq, cr = F.col("a_code"), F.col("b_code"), F.col("c_code")
    order = lambda i, j, k: F.lit(i | j << 2 | k << 4)

    def pair(x: int, y: int, single: int, above: Column, dx: Column, dy: Column) -> Column:
        """Places of two equal atoms and a third one; ``above`` says whether the pair has the higher code."""
        swapped = dy > dx
        return F.when(above, F.when(swapped, order(y, x, single)).otherwise(order(x, y, single))).otherwise(F.when(swapped, order(single, y, x)).otherwise(order(single, x, y)))

    place = (
        F.when((cp == cq) & (cq == cr), F.when((d12 >= d13) & (d12 >= d23), order(1, 2, 3)).when(d13 >= d23, order(1, 3, 2)).otherwise(order(2, 3, 1)))
        .when(cp == cq, pair(1, 2, 3, cp > cr, d13, d23))
        .when(cp == cr, pair(1, 3, 2, cp > cq, d12, d23))
        .when(cq == cr, pair(2, 3, 1, cq > cp, d12, d13))
        .when((cp > cq) & (cq > cr), order(1, 2, 3))
        .when((cp > cr) & (cr > cq), order(1, 3, 2))
        .when((cq > cp) & (cp > cr), order(2, 1, 3))
        .when((cq > cr) & (cr > cp), order(2, 3, 1))
        .when((cr > cp) & (cp > cq), order(3, 1, 2))
        .otherwise(order(3, 2, 1))
    )
    # which atom a vertex is, worked out once for all its columns: the JVM compiles no generated method over 8000 bytes, and interprets it for each triplet
    rows = fenced(rows, place=place).withColumns({f"_v{v}": F.shiftright("place", 2 * v - 2).bitwiseAND(3) for v in (1, 2, 3)})
    pick = lambda v, k: F.when(F.col(f"_v{v}") == 1, F.col(f"a_{k}")).when(F.col(f"_v{v}") == 2, F.col(f"b_{k}")).otherwise(F.col(f"c_{k}")).alias(f"v{v}_{k}")
    return rows.select(*by, *[pick(v, k) for v in (1, 2, 3) for k in ("code", "x", "y", "z", *carry)])


def key_columns(triplets: DataFrame, mirror: bool = False, lenient: bool = False, dtheta: int = DTHETA, dlen: int = DLEN, num_labels: int = NUM_LABELS) -> DataFrame:
    """Adds max_dist, theta1, theta, theta_bin, dist_bin, key and error to rows with ordered vertices in columns v1_*, v2_*, v3_*."""
    middle = [(F.col(f"v1_{k}") + F.col(f"v2_{k}")) / 2 - F.col(f"v3_{k}") for k in "xyz"]
    out = triplets.withColumns({"d01": distance("v1", "v2"), "d02": distance("v1", "v3"), "d12": distance("v2", "v3"), "d3": F.sqrt(F.pow(middle[0], 2) + F.pow(middle[1], 2) + F.pow(middle[2], 2))})
    out = out.withColumns({"max_dist": F.greatest("d01", "d02", "d12"), "half": F.col("d01") / 2})
    cosine = F.try_divide(F.pow("d02", 2) - F.pow("half", 2) - F.pow("d3", 2), 2 * F.col("half") * F.col("d3"))
    # the generator parts the generated code as well: what comes behind it is a method of its own
    out = fenced(out, theta1=F.nanvl(180 * F.acos(cosine) / PI, F.lit(None).cast("double")))
    theta = F.when(F.col("theta1") <= 90, F.col("theta1")).otherwise(F.abs(180 - F.col("theta1")))
    out = out.withColumn("theta", theta).withColumns({"theta_bin": theta_bin(F.col("theta"), lenient), "dist_bin": distance_bin(F.col("max_dist"))})
    code = lambda v: F.col(f"{v}_code").cast("long") - 1
    key = dlen * dtheta * num_labels * num_labels * code("v1") + dlen * dtheta * num_labels * code("v2") + dlen * dtheta * code("v3") + dtheta * (F.col("dist_bin") - 1) + (F.col("theta_bin") - 1)
    if mirror:
        key = F.when(F.col("theta1") > 90, -key).otherwise(key)
    error = F.when(F.col("theta1").isNull(), "degenerate").when(F.col("theta_bin").isNull(), "right_angle")
    return fenced(out, key=key.cast("long"), error=error).drop("d01", "d02", "d12", "half", "d3")
