"""Digest and length are read from the stored payload, not from headers."""

import hashlib

from pyspark.sql import functions as F

from molkeys.llm import warc


def test_wrong_payloads_are_seen(spark, tmp_path):
    body = "x" * 1500
    pages = spark.createDataFrame([(1, "a", body), (2, "b", body), (3, "c", "tiny")], "page_id long, url string, html string")
    cut = warc.with_revisits(pages).withColumn("payload", F.expr("substring(payload, 1, octet_length(payload) - 1)"))
    warc.write_bundles(cut, f"file://{tmp_path}/w")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_bundles(spark, f"file://{tmp_path}/w").collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {1: ("revisit", 1499, sha(body[1:]), 2), 2: ("response", 1499, sha(body[1:]), None), 3: ("response", 3, sha("tin"), None)}
