"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text is cut into k-grams of words; each window of w consecutive k-grams keeps its smallest hash. Two texts that
share a run of w + k - 1 words share such a window and so a kept hash, whichever texts they are: no sufficiently long
shared span is missed. Each text is split into words once, for its length, its fingerprints and its runs as short as a short
item; these are joined with those of the items, and the documents with a common one are searched exactly: an item's windows of ``window`` words are compared with all positions of the document and the matches
extend to the words that any of them covers.

Fingerprints and windows of the items are broadcast while their counted number is below ``BROADCAST_ROWS``; above it the same joins shuffle.

Cases: null or empty texts have no words; an item of fewer words than the window, but not none, is one window of its own
length (such lengths are compared at every position of every document); windows that several items share count for each;
rows that share a doc_id are all reported, each with the hits of all of them; a null doc_id is an identifier like any
other; a null item_id hits but is not listed; empty tables give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_of

#: Upper bound of rows that are broadcast (a fingerprint or an identifier, and a number: at most some 30 MB).
BROADCAST_ROWS = 500_000
#: Words are runs of digits, lower-case letters and all characters beyond ASCII.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str) -> Column:
    return F.array_remove(F.split(F.translate(text_of(column), UPPER, LOWER), BREAK), "")


def grams(array: str, k: int) -> Column:
    """Hashes of all runs of k words; empty if there are fewer."""
    w = F.col(array)
    n = F.size(w)
    run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).otherwise(F.array().cast("array<bigint>"))


def minima(array: str, w: int) -> Column:
    """Distinct smallest values of all runs of w values."""
    g = F.col(array)
    n = F.size(g)
    low = lambda i: F.least(*[F.get(g, i + j) for j in range(w)])
    return F.when(n >= w, F.array_distinct(F.transform(F.sequence(F.lit(0), n - w), low))).otherwise(F.array().cast("array<bigint>"))


def probes(array: str, short: list[int], k: int, window: int) -> Column:
    """What a text with these words may share: its winnowed fingerprints, and all its runs of the lengths of short items."""
    return F.array_distinct(F.concat(minima("g", window - k + 1), *[grams(array, n) for n in short]))


def parse(docs: DataFrame, key: str, short: list[int], k: int, window: int) -> DataFrame:
    """(key, n_words, probes) of every whole text, which is split into words once."""
    rows = docs.select(key, words("text").alias("w")).withColumn("g", grams("w", k))
    return rows.select(key, F.size("w").cast("long").alias("n_words"), probes("w", short, k, window).alias("probes"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; leave the join to shuffle beyond it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _windows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pos, gram) of all runs of n words, as a 96-bit hash of the words."""

    def run(i):
        own = [F.get(F.col("w"), i + j) for j in range(n)]  # as hashing the slice, which would copy all words each time
        return F.struct(F.xxhash64(*own).alias("a"), F.hash(*own).alias("b"))

    # the outer form: for the inner one the optimiser filters by the whole expression, with the words split anew for each place
    return rows.where(F.size("w") >= n).select(key, F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.size("w") - n), run)).alias("pos", "gram"))


def search(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of every row, and (doc_id, pos, n, item_id) of each occurrence of an item's window."""
    item_words = items.select("item_id", words("text").alias("w"))
    own = materialise(_item_windows(item_words, window), "windows")
    lengths = sorted(r.n for r in own.select("n").distinct().collect())  # at most ``window`` numbers
    short = [n for n in lengths if n < window]
    n_own = own.count()
    # a long item's short runs are no windows of its own, but whatever they find is searched exactly
    wanted = materialise(parse(items, "item_id", short, k, window).select(F.explode_outer("probes").alias("probe")).where("probe is not null").distinct(), "wanted")
    parsed = materialise(parse(docs, "doc_id", short, k, window), "parsed")
    hit = parsed.select("doc_id", F.explode("probes").alias("probe")).join(bounded(wanted, wanted.count()), "probe", "left_semi")
    near = materialise(hit.select("doc_id").distinct(), "near")
    rows = docs.join(bounded(near, near.count()), docs["doc_id"].eqNullSafe(near["doc_id"]), "left_semi").select("doc_id", words("text").alias("w"))
    found = [docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), items.schema["item_id"]]))]
    for n in lengths:
        there = bounded(own.where(F.col("n") == n).select("item_id", "gram"), n_own)
        found.append(_windows(rows, "doc_id", n).join(there, "gram").select("doc_id", "pos", F.lit(n).alias("n"), "item_id"))
    return parsed.select("doc_id", "n_words"), reduce(DataFrame.unionByName, found)


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, pos, n, item_id): each occurrence of an item's window in a document."""
    return search(docs, items, window, k)[1]


def _item_windows(item_words: DataFrame, window: int) -> DataFrame:
    parts = [_windows(item_words, "item_id", window).select("item_id", "gram", F.lit(window).alias("n"))]
    short = item_words.where(F.size("w").between(1, window - 1))
    parts.append(short.select("item_id", F.struct(F.xxhash64("w").alias("a"), F.hash("w").alias("b")).alias("gram"), F.size("w").alias("n")))
    return reduce(DataFrame.unionByName, parts).distinct()


def covered(spans: str) -> Column:
    """Number of places that a sorted array of (pos, n) covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))

    def step(acc, s):
        end = s["pos"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + F.greatest(end - F.greatest(acc["end"], s["pos"]), F.lit(0))).alias("total"))

    return F.aggregate(F.col(spans), start, step, lambda acc: acc["total"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    per_doc, hits = search(docs, items, window, k)
    by_doc = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("hit_id"), covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    out = per_doc.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
