"""The thin queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collisions, entropy_mix, filter_audit, host_suffixes, jaccard_join, lattice, lexical_index, prefix_free, secret_forest, token_files, toxic_crf, warc, winnow
from .common import for_long_texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for_long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers, from a folder named in the environment or their package."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxic_crf.score(docs, toxic_crf.train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", toxic_crf.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffixes.main_text(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.secrets_by_doc(table(spark, sf_dir, "documents"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_summary(table(spark, sf_dir, "documents"), lattice.load_model(tokenizer_file("piece_bpe_32k.model")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_bundles(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenise_to_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.search_once(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_collisions": op1_collisions, "op10_prefix_free": op10_prefix_free, "op11_filter_audit": op11_filter_audit, "op12_lexical_index": op12_lexical_index, "op13_entropy_mix": op13_entropy_mix, "op2_toxic_crf": op2_toxic_crf, "op3_winnow": op3_winnow, "op4_host_suffixes": op4_host_suffixes, "op5_jaccard_join": op5_jaccard_join, "op6_secret_forest": op6_secret_forest, "op7_lattice": op7_lattice, "op8_warc": op8_warc, "op9_token_files": op9_token_files}

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op1_collisions": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS norm FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding::DOUBLE[] IF x IS NULL OR NOT isfinite(x)]) = 0),
        e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.93 * a.norm * b.norm),
        reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN e ON r = a),
        comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        deg AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, component_id = vec_id AS kept
        FROM embeddings JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)""",
    "op11_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
        f AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m, coalesce(q, false) AS q, coalesce(x, false) AS x FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, m, count(*) AS n, count(*) FILTER (q) AS g, count(*) FILTER (x) AS x FROM f GROUP BY ALL),
        b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
        o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM b p, b q, b r, b s, b t WHERE p.b | q.b | r.b | s.b | t.b = 31),
        s AS (SELECT filter_order, step, bs[step] AS b, list_sum(bs[1:step - 1])::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
        r AS (SELECT part, filter_order, step, b, count(*) AS _, coalesce(sum(n) FILTER (m & (b | coalesce(before, 0)) = 0), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (m & b > 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (m & b > 0 AND m & coalesce(before, 0) > 0), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (m = b), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (m & b > 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
                coalesce(sum(x) FILTER (m & b > 0 AND m & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r""",
    "op12_lexical_index": f"""
        WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents WHERE text IS NOT NULL),
        g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
        q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
        v AS (SELECT DISTINCT term FROM q),
        p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN v USING (term) GROUP BY doc_id, term),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(g.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * g.n) // g.l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op3_winnow": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        own AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM own),
        lengths AS (SELECT DISTINCT n FROM windows),
        at_pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n),
        hits AS (SELECT doc_id, p, a.n, item_id FROM at_pos a JOIN windows b ON a.n = b.n AND array_to_string(w[p:p + a.n - 1], ' ') = gram),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op5_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[p:p + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
        both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
        SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, h, octet_length(encode(h)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
        FROM q""",
}
