"""Filter interaction audit: what each filter removes after the others, in every order, with exact Shapley values.

A document is reduced to the set of filters that it fails, as a bit mask. Of a part only the counts of its masks are kept, at most
2^n of them. They give the part's removal polynomial, the multilinear extension of "documents that the filters S remove":

    f(x) = sum over masks m of c[m] * (1 - product over i in m of (1 - x[i]))

At a corner of the cube f counts the documents that the filters there remove, so corners give survivors and removals of each step.
The integral over the diagonal of the partial derivative for x[i] is the Shapley value of filter i; times n! it is the sum over all orders.

Identity with an earlier text is decided by SHA-256 of the whole text. Documents travel as digests and masks, never as texts, and
copies are counted before each shuffle, so a text that a third of the documents share is a few rows.

Cases: a null text is an empty one; a null part counts under the empty name; a document with a null doc_id has no smaller one and is
nobody's smaller one; rows that share doc_id and text are no copies of each other, each is counted; several labels of a document
count if any of them is 1; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The filters that one text decides, in the order of their bits; the copy filter comes after them.
LETTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions of the filters A to D, from a text and its words."""
    n, upper = F.size(words), F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(50).cast("long") * n, F.lit(100).cast("long") * upper > F.lit(2).cast("long") * F.char_length(text), text.rlike("[#$%&*|]")]


def failure_counts(docs: DataFrame, labels: DataFrame, failures=text_failures, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, the copy filter being the last bit."""
    read = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of("text").alias("text"))
    read = read.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    bits = failures(F.col("text"), F.col("words"))
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    rows = read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    told = labels.where("doc_id is not null").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    rows = rows.join(told, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])

    # of equal texts in a cell, the rows of the smallest doc_id and the rows that have one
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    cells = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(named).alias("low"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("ids"))
    cells = cells.withColumn("first", F.expr("min(low.doc_id) over (partition by digest)"))
    copies = F.col("ids") - F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(bits))).alias("mask"), F.col("copies").alias("n")))
    cells = cells.withColumn("copies", copies).select("part", "quality", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("quality")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def subsets(mask: int):
    """All sets of bits within ``mask``, the empty one last."""
    s = mask
    while s:
        yield s
        s = (s - 1) & mask
    yield 0


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients, by the set of variables of each product, of the polynomial that the counts of masks give."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        for s in subsets(mask):
            if s:  # 1 - prod(1 - x) has no constant term
                out[s] = out.get(s, 0) + (n if s.bit_count() % 2 else -n)
    return out


def at_corner(polynomial: dict[int, int], mask: int) -> int:
    """The value where the variables of ``mask`` are one and all others zero."""
    return sum(polynomial.get(s, 0) for s in subsets(mask))


def shapley(polynomial: dict[int, int], bit: int) -> Fraction:
    """The integral of the partial derivative for one variable along the diagonal."""
    return sum((Fraction(c, s.bit_count()) for s, c in polynomial.items() if s >> bit & 1), Fraction(0))


def audit_part(counts: pd.DataFrame, letters: str = LETTERS) -> pd.DataFrame:
    """All orders and steps of one part, from its counts of masks."""
    n_bits, by = len(letters), {c: dict(zip(counts["mask"], map(int, counts[c]))) for c in ("n", "good", "toxic")}
    total = sum(by["n"].values())
    removed, good, toxic = (removal_polynomial(by[c]) for c in ("n", "good", "toxic"))
    corners = {c: [at_corner(p, s) for s in range(1 << n_bits)] for c, p in (("n", removed), ("good", good), ("toxic", toxic))}
    values = [shapley(removed, i) * factorial(n_bits) for i in range(n_bits)]
    assert all(v.denominator == 1 for v in values)
    out = []
    for order in permutations(range(n_bits)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = {c: v[after] - v[before] for c, v in corners.items()}
            # alone, a filter removes all that fail it; after all the others, those that fail nothing else
            fails, unique = corners["n"][1 << i], corners["n"][-1] - corners["n"][~(1 << i)]
            out.append(("".join(letters[j] for j in order), step, total - corners["n"][after], gone["n"], fails - gone["n"], unique, gone["good"], gone["toxic"], int(values[i])))
            before = after
    frame = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    frame.insert(0, "part", counts["part"].iloc[0])
    return frame


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = failure_counts(docs, labels)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInPandas(lambda c: audit_part(c), schema)
