"""Ranked lexical search over an index in shards of documents, with integer impacts computed when the index is built.

A shard holds some megabytes of text as compressed sparse rows: its terms in byte order, for each term where its postings begin, and
the postings, that is the place of a document in the shard and its impact

    (1000000000 * tf) div (1000 * tf + 8 * m),   m = 10 + (90 * n * N) div L

with N documents that have a term, L terms in all of them, n terms in the document, tf of which are this one. A shard is one row of a
Parquet table, so a search is a map over its rows: nothing of the postings is shuffled. The lexicon, a second table, has the document
frequency df of each term, from which its weight floor(1000 * ln((2N + 2) / (2df + 1))) comes when a query names it.

A search takes its queries in blocks of bounded bytes. In each shard the terms of a query are added up one after the other in a dense
array of the shard's documents; the best k leave it, equal scores by ascending doc_id, and the best k of all shards are the answer.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; they are compared as they
are, never by hash. Every row is indexed whole. Numbers are 64-bit: 90 * n * N must stay under 2^63.

Cases: null and empty texts and texts without terms are in no posting and do not count in N; rows that share a doc_id are documents of
their own; a null doc_id comes after all others of its score; query rows that share an id (also a null one) are one query, each term
once; a query without a known term has no answer; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, forget, gathered, lean, materialise, scratch_path, steps, string_buffer, text_of, words_of

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms, after A-Z were lowered.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
#: Bytes of text in a shard; a longer single text is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of query terms that one pass over the index takes.
BLOCK_BYTES = 8 << 20

SHARD = "doc_ids array<bigint>, terms array<string>, starts array<int>, docs array<int>, impacts array<int>"
#: A row is a shard of megabytes, so row groups are looked at after each row.
OPTIONS = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


@dataclass(frozen=True)
class Index:
    """An index on disk: the two tables, and the numbers that hold for all documents."""

    spark: SparkSession
    path: str
    n_docs: int
    n_terms: int

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(f"{self.path}/shards")

    @property
    def lexicon(self) -> DataFrame:
        return self.spark.read.schema("term string, df bigint").parquet(f"{self.path}/lexicon")

    def delete(self) -> None:
        forget(self.shards, self.lexicon)


def shard_of(ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    """The compressed sparse rows of some documents, as one row."""
    raw = LOWER[raw]
    starts, ends, row = words_of(raw, offsets, INSIDE)
    if not len(starts):
        return None
    # documents take their places by doc_id, so that a smaller place wins a tie
    order = pc.array_sort_indices(ids, order="ascending").to_numpy()  # nulls last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = np.bincount(row, minlength=len(order)).astype(np.int64)
    m = 10 + (90 * lengths * n_docs) // n_terms
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[INSIDE[raw]])))
    coded = words.dictionary_encode()
    by = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    pairs = rank[coded.indices.to_numpy()] * len(order) + place[row]
    pairs.sort()
    edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    tf = np.diff(np.append(edge, len(pairs)))
    term, doc = np.divmod(pairs[edge], len(order))
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[order][doc])
    begins = np.searchsorted(term, np.arange(len(by) + 1))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    ints = lambda a: one(pa.array(a.astype(np.int32)), pa.int32())
    return pa.RecordBatch.from_arrays([one(ids.take(pa.array(order)), pa.int64()), one(coded.dictionary.take(pa.array(by)), pa.string()), ints(begins), ints(doc), ints(impact)], names=["doc_ids", "terms", "starts", "docs", "impacts"])


def build(docs: DataFrame, path: str) -> Index:
    """Write the index of all rows (doc_id, text) to ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), text_of("text").alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def shards(batches):
        for batch in gathered(batches, SHARD_BYTES):
            ids, (raw, offsets) = batch.column(0), string_buffer(batch.column(1))
            for at, to in steps(offsets, SHARD_BYTES):
                out = shard_of(ids[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n_docs, n_terms)
                if out is not None:
                    yield out

    docs.mapInArrow(lean(shards), SHARD).write.options(**OPTIONS).parquet(f"{path}/shards")
    index = Index(spark, path, n_docs, n_terms)
    counts = F.expr("transform(terms, (t, i) -> struct(t as term, starts[i + 1] - starts[i] as n))")
    index.shards.select(F.explode(counts).alias("c")).groupBy("c.term").agg(F.sum("c.n").alias("df")).write.parquet(f"{path}/lexicon")
    return index


def terms_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, SMALL), F.lit(TERM), F.lit(0))


def weighted_terms(index: Index, queries: DataFrame, key: str) -> DataFrame:
    """(key, term, w): the distinct terms of each query that the index knows, with their weights."""
    asked = queries.select(F.col(key).alias("key"), F.explode(terms_of("text")).alias("term")).distinct()
    ratio = F.lit(2.0 * index.n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)
    return asked.join(index.lexicon, "term").select("key", "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above zero, of equal ones at the limit the smallest places."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= k:
        return found
    values = scores[found]
    limit = values[np.argpartition(values, len(values) - k)[len(values) - k]]
    above, equal = found[values > limit], found[values == limit]
    return np.concatenate([above, equal[: k - len(above)]])


def search(index: Index, queries: DataFrame, key: str = "item_id", k: int = 10) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of each query."""
    spark = index.spark
    asked = materialise(weighted_terms(index, queries, key), "weighted-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    n_blocks = 1 + size // BLOCK_BYTES
    kind = asked.schema["key"].dataType.simpleString()
    found = spark.createDataFrame([], f"key {kind}, doc_id bigint, score bigint")
    for b in range(n_blocks):
        # a block is bounded in bytes; it goes to the executors once
        block = asked.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")).toArrow()
        lists = block.column("terms").combine_chunks()
        terms = pc.struct_field(lists.flatten(), "term").dictionary_encode()
        sent = spark.sparkContext.broadcast((block.column("key").combine_chunks(), terms.dictionary, terms.indices.to_numpy(), pc.struct_field(lists.flatten(), "w").to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))))

        def answer(batches, sent=sent):
            keys, vocabulary, term, weight, first = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, own, starts, docs, impacts = (batch.column(c)[i].values for c in range(5))
                    starts, docs, impacts = (a.to_numpy() for a in (starts, docs, impacts))
                    at = pc.fill_null(pc.index_in(vocabulary.cast(own.type), value_set=own), -1).to_numpy()
                    owners, places, scores = [], [], []
                    for q in range(len(first) - 1):
                        dense = np.zeros(len(ids), np.int64)
                        for t in range(first[q], first[q + 1]):
                            if (j := at[term[t]]) >= 0:
                                postings = slice(starts[j], starts[j + 1])
                                dense[docs[postings]] += weight[t] * impacts[postings].astype(np.int64)
                        top = best(dense, k)
                        owners.append(np.full(len(top), q))
                        places.append(top)
                        scores.append(dense[top])
                    if owners:
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(owners))), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], names=["key", "doc_id", "score"])

        found = found.union(index.shards.mapInArrow(lean(answer), found.schema))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), F.col("rank").cast("int"), "doc_id", "score")


def search_once(docs: DataFrame, queries: DataFrame, key: str = "item_id", k: int = 10) -> DataFrame:
    """Build an index in the shared folder, search it, and delete it."""
    index = build(docs, scratch_path(docs.sparkSession, "lexical"))
    top = materialise(search(index, queries, key, k), "ranked")
    index.delete()
    return top
