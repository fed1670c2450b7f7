"""Toxic spans by a linear-chain conditional random field.

Words of a sentence form a chain with two states. A word's features are hashes of the word and of its beginnings, so that
inflected forms of a stem share evidence; the chain adds start and transition weights. The model is fitted on labelled
tokens of a bounded sample of labelled documents: in a toxic document, the words with a feature that toxic documents have
``RATIO`` times as often, beyond chance, are toxic, and all others are not. Forward and backward passes give each
word's marginal; a document's score is a logistic function of the marginals' sum and maximum, fitted on the same sample,
and its offending offsets are the runs of words whose marginal reaches one half.

Fitting is one task over a bounded sample of the documents that have labels: at most ``TOXIC_SAMPLE`` + ``CLEAN_SAMPLE`` of
them, the first by hash of doc_id, with ``SAMPLE_BYTES`` of text for each label and none over ``SAMPLE_LONGEST``; some 2 million
words, held as 32-bit features. Scoring covers every whole text. Sentences end at . ! ? and line ends; longer ones go on as a further chain after ``CHAIN``
words. Only the text is an input of a score.

Cases: a null or empty text, or one without words, has no spans and gets the score of such texts; labels that are null or
neither 0 nor 1 are left out, and of several labels of a document the largest counts; without toxic or clean training
documents every score is the smoothed share of toxic ones; of texts that share a doc_id the smallest is learnt from; repeated
rows are scored one by one; a null doc_id is never learnt from and its held_out is null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_prefix, lean, mix, span_hash, steps, string_buffer, text_of, words_of

#: Bounds of the sample: documents of each label, bytes of text for each label, bytes of a document.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 4000
SAMPLE_BYTES, SAMPLE_LONGEST = 8 << 20, 256 << 10
#: Hashed features, words of a chain, times that a toxic feature must be more frequent, and the likelihood ratio (twice its
#: logarithm; one in a million by chance) that the difference must reach.
FEATURES, CHAIN, RATIO, GAIN = 1 << 18, 64, 12.0, 24.0
PREFIXES = (3, 4, 5, 6)
EPOCHS, RATE, DECAY = 30, 0.5, 1e-4

INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 63]] = True


@dataclass
class Crf:
    weights: np.ndarray  # of features for the toxic state
    chain: np.ndarray  # start; then from clean to toxic, toxic to clean, toxic to toxic
    doc: np.ndarray  # constant, log of the summed marginals, log-odds of the largest


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the two-byte Latin letters that start with C3, in place of equal length."""
    out = LOWER[raw]
    if len(raw):
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        upper = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
        out[upper] += 0x20
    return out


def tokens_of(raw: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of words, their feature numbers, and where chains begin."""
    low = lowered(raw)
    starts, ends, row = words_of(low, offsets, INSIDE)
    pre = byte_prefix(low)
    feats = np.empty((len(starts), len(PREFIXES) + 1), np.int32)
    feats[:, 0] = mix(span_hash(pre, starts, ends)) & np.uint64(FEATURES - 1)
    for k, n in enumerate(PREFIXES, 1):
        h = mix(span_hash(pre, starts, np.minimum(starts + n, ends)) + np.uint64(k))
        feats[:, k] = np.where(starts + n <= ends, h & np.uint64(FEATURES - 1), 0)  # 0: no such prefix
    stops = np.concatenate([[0], np.cumsum(STOP[low])])
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] != stops[ends[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
        new |= (np.arange(len(starts)) - head) % CHAIN == 0
    return starts, ends, row, feats, np.flatnonzero(new)


def marginals(e: np.ndarray, heads: np.ndarray, chain: np.ndarray, moves: bool = False):
    """Chance of the toxic state of each word; with ``moves`` also the expected starts and transitions, and the log-likelihood's norm.

    e: log-odds of each word by its features. Chains are handled side by side, those of like length together.
    """
    p = np.zeros(len(e))
    lengths = np.diff(np.append(heads, len(e)))
    psi = np.exp(np.array([[0.0, chain[1]], [chain[2], chain[3]]]))
    expected, norm, low = np.zeros(4), 0.0, 0
    w = np.exp(np.clip(e, -40, 40))
    for high in (4, 8, 16, 32, CHAIN):
        at = heads[(lengths > low) & (lengths <= high)]
        n = lengths[(lengths > low) & (lengths <= high)]
        low = high
        if not len(at):
            continue
        t = int(n.max())
        live = np.arange(t) < n[:, None]
        index = np.where(live, at[:, None] + np.arange(t), 0)
        x = w[index]
        a = np.empty((t, len(at), 2))
        scale = np.empty((t, len(at)))
        f0, f1 = np.ones(len(at)), np.exp(chain[0]) * x[:, 0]
        for k in range(t):
            if k:
                f0, f1 = f0 * psi[0, 0] + f1 * psi[1, 0], (f0 * psi[0, 1] + f1 * psi[1, 1]) * x[:, k]
            s = f0 + f1
            f0, f1 = f0 / s, f1 / s
            a[k, :, 0], a[k, :, 1], scale[k] = f0, f1, s
        b0, b1 = np.ones(len(at)), np.ones(len(at))
        for k in range(t - 1, -1, -1):
            if k < t - 1:
                inner = live[:, k + 1]
                c0, c1 = b0 / scale[k + 1], b1 * x[:, k + 1] / scale[k + 1]
                if moves:
                    expected[1] += (a[k, :, 0] * psi[0, 1] * c1)[inner].sum()
                    expected[2] += (a[k, :, 1] * psi[1, 0] * c0)[inner].sum()
                    expected[3] += (a[k, :, 1] * psi[1, 1] * c1)[inner].sum()
                b0, b1 = np.where(inner, psi[0, 0] * c0 + psi[0, 1] * c1, 1.0), np.where(inner, psi[1, 0] * c0 + psi[1, 1] * c1, 1.0)
            g0, g1 = a[k, :, 0] * b0, a[k, :, 1] * b1
            q = g1 / (g0 + g1)
            p[index[live[:, k], k]] = q[live[:, k]]
            if moves and k == 0:
                expected[0] += q.sum()
        norm += np.log(scale)[live.T].sum()
    return (p, expected, norm) if moves else p


def doc_inputs(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    top = np.zeros(rows)
    np.maximum.at(top, row, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(rows), np.log1p(np.bincount(row, p, minlength=rows)), np.log(top / (1 - top))], 1)


@dataclass
class Slab:
    """Some whole documents of the sample: features of their words, rows, where chains begin, labels of documents and words."""

    feats: np.ndarray
    row: np.ndarray
    heads: np.ndarray
    toxic: np.ndarray
    y: np.ndarray


def slabs_of(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> list[Slab]:
    out = []
    for a, b in steps(offsets):
        _, _, row, feats, heads = tokens_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out.append(Slab(feats, row.astype(np.int32), heads, toxic[a:b], np.zeros(len(row), np.int8)))
    return out


def label_tokens(slabs: list[Slab]) -> None:
    """1 for words of toxic documents with a feature that marks such documents."""
    counts = {1: np.zeros(FEATURES), 0: np.zeros(FEATURES)}
    n1, n0 = (sum(int((s.toxic == v).sum()) for s in slabs) for v in (1, 0))
    for s in slabs:
        for value, total in counts.items():
            mine = s.toxic[s.row] == value
            pairs = np.unique(np.repeat(s.row[mine].astype(np.int64), s.feats.shape[1]) * FEATURES + s.feats[mine].ravel())
            total += np.bincount(pairs % FEATURES, minlength=FEATURES)
    with1, with0 = counts[1], counts[0]
    odds = (with1 + 0.5) / (n1 + 1) / ((with0 + 0.5) / (n0 + 1))
    all_with, base = with1 + with0, n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(with1 > 0, with1 * np.log(with1 / (all_with * base)), 0) + np.where(with0 > 0, with0 * np.log(with0 / (all_with * (1 - base))), 0))
    marks = (gain >= GAIN) & (odds >= RATIO)
    marks[0] = False
    for s in slabs:
        s.y = (marks[s.feats].any(1) & (s.toxic[s.row] == 1)).astype(np.int8)


def fit(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> Crf:
    """Adagrad on the penalised likelihood of the token labels, summed slab by slab, then a logistic fit of the documents."""
    slabs = slabs_of(raw, offsets, toxic)
    label_tokens(slabs)
    seen, n_heads = np.zeros(4), sum(len(s.heads) for s in slabs)
    for s in slabs:
        first = np.zeros(len(s.y), bool)
        first[s.heads] = True
        inner = np.flatnonzero(~first)
        before, now = s.y[inner - 1], s.y[inner]
        seen += [s.y[s.heads].sum(), ((before == 0) & (now == 1)).sum(), ((before == 1) & (now == 0)).sum(), ((before == 1) & (now == 1)).sum()]
    w, chain = np.zeros(FEATURES), np.array([-3.0, -3.0, 0.0, 0.0])
    square_w, square_c = np.full(FEATURES, 1e-8), np.full(4, 1e-8)
    for _ in range(EPOCHS):
        grad, expected = -DECAY * w * n_heads / 100, np.zeros(4)
        for s in slabs:
            p, moves, _ = marginals(w[s.feats].sum(1), s.heads, chain, moves=True)
            grad += np.bincount(s.feats.ravel(), np.repeat(s.y - p, s.feats.shape[1]), minlength=FEATURES)
            expected += moves
        grad[0] = 0.0
        move = seen - expected - DECAY * chain
        square_w += grad * grad
        square_c += move * move
        w += RATE * grad / np.sqrt(square_w)
        chain += RATE * move / np.sqrt(square_c)
    x = np.concatenate([doc_inputs(marginals(w[s.feats].sum(1), s.heads, chain), s.row, len(s.toxic)) for s in slabs])
    doc = np.zeros(3)
    for _ in range(25):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ doc, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        doc += np.linalg.solve(hess, x.T @ (toxic - q) - 0.05 * doc)
    return Crf(w, chain, doc)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the bounded sample of documents that are there, have a label and are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("integer").alias("toxic")).where(~held_out("doc_id"))
    there = docs.select("doc_id", F.octet_length(text_of("text")).alias("size")).where(F.col("size") <= SAMPLE_LONGEST).groupBy("doc_id").agg(F.max("size").alias("size"))
    there = there.join(known, "doc_id").withColumn("chance", F.xxhash64("doc_id"))
    first = [there.where(F.col("toxic") == value).orderBy("chance", "doc_id").limit(n) for value, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("chance", "doc_id"))  # at most CLEAN_SAMPLE narrow rows
    return first[0].unionByName(first[1]).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """Fit on the bounded sample of labelled documents that are not held out."""
    text = text_of("text")
    rows = docs.where(F.octet_length(text) <= SAMPLE_LONGEST).select("doc_id", text.alias("text")).join(F.broadcast(sample_of(docs, labels)), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        held = list(batches)
        toxic = np.concatenate([x.column(1).to_numpy() for x in held] or [np.zeros(0)]).astype(np.float64)
        if 0 < toxic.sum() < len(toxic):
            crf = fit(*string_buffer(pa.Table.from_batches(held).column(0)), toxic)
        else:
            share = (toxic.sum() + 0.5) / (len(toxic) + 1)
            crf = Crf(np.zeros(FEATURES), np.zeros(4), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes() if x is crf.weights else x.astype("<f8").tobytes()], pa.binary()) for x in (crf.weights, crf.chain, crf.doc)], names=["weights", "chain", "doc"])

    one = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic").mapInArrow(lean(run), "weights binary, chain binary, doc binary").first()
    if one is None:
        return Crf(np.zeros(FEATURES), np.zeros(4), np.zeros(3))
    return Crf(np.frombuffer(one.weights, "<f4").astype(np.float64), np.frombuffer(one.chain, "<f8"), np.frombuffer(one.doc, "<f8"))


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("marginal", "double"))


def score(docs: DataFrame, model: Crf, *keep: str) -> DataFrame:
    """The columns to keep, score and spans (offsets in characters) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score", "spans"]

    def run(batches):
        crf = shared.value
        for batch in batches:
            raw, offsets = string_buffer(batch.column(0))
            for a, b in steps(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row, feats, heads = tokens_of(part, off)
                p = marginals(crf.weights[feats].sum(1), heads, crf.chain) if len(starts) else np.zeros(0)
                s = 1 / (1 + np.exp(-np.clip(doc_inputs(p, row, b - a) @ crf.doc, -30, 30)))
                hit = np.flatnonzero(p >= 0.5)
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
                f = np.flatnonzero(new)
                chars = np.concatenate([[0], np.cumsum(part & 0xC0 != 0x80)])
                home = row[hit[f]]
                origin = chars[off[home]]
                last = np.append(f[1:], len(hit)) - 1 if len(f) else f
                spans = pa.StructArray.from_arrays([pa.array((chars[starts[hit[f]]] - origin).astype(np.int32)), pa.array((chars[ends[hit[last]]] - origin).astype(np.int32)), pa.array(np.maximum.reduceat(p[hit], f) if len(f) else np.zeros(0))], names=["start", "end", "marginal"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(home, np.arange(b - a + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), pa.array(s), lists], names=names)

    schema = T.StructType([docs.schema[c] for c in keep]).add("score", "double").add("spans", SPANS)
    return docs.select(text_of("text").alias("text"), *keep).mapInArrow(lean(run), schema)
