"""The registered pN_ queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.llm import abuse, hash_forest, knn_tree, mixture, near_groups, stable_sample, tokens
from tarnwork.runtime import load


def p1_found(spark, sf):
    return hash_forest.repeats(load(spark, sf, "docs"))


def p3_found(spark, sf):
    pairs = knn_tree.nearest(load(spark, sf, "embedding_row"))
    return pairs.select(pairs.a.alias("pk_a"), pairs.b.alias("pk_b"))


def p4_sample(spark, sf):
    return stable_sample.tag_samples(load(spark, sf, "exported_row"), load(spark, sf, "training_tag"))


def p5_found(spark, sf):
    return near_groups.near_groups(load(spark, sf, "docs"))


def p6_ids(spark, sf):
    return tokens.encode(load(spark, sf, "documents"))


def p6_decoded(spark, sf):
    return tokens.decode(tokens.encode(load(spark, sf, "documents")))


def p6_offsets(spark, sf):
    """Where the tokens of each text end and how many there are: the last end is the text's length."""
    found = tokens.encode_with_offsets(load(spark, sf, "documents"))
    whole = F.forall(F.zip_with("starts", "ends", lambda a, b: b > a), lambda x: x)
    return found.select("doc_id", F.coalesce(F.get("starts", F.lit(0)), F.lit(0)).alias("first"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last"), whole.alias("whole"))


# Domains of the sources: where people talk to each other, and what is written to be looked up.
TALK = dict.fromkeys(["issue_tracker", "forum", "chat", "mailing_list"], "talk")
DOMAINS = TALK | dict.fromkeys(["release_notes", "runbook", "design_doc", "benchmark_report", "glossary"], "reference")


def _mixture(spark, sf):
    return mixture.Mixture(load(spark, sf, "documents"), load(spark, sf, "mix_target"), domain_of=DOMAINS)


def p7_mix(spark, sf):
    return _mixture(spark, sf).documents()


def p7_shares(spark, sf):
    return _mixture(spark, sf).shares()


def _marked(spark, sf, *keep):
    docs = load(spark, sf, "documents")
    return abuse.scored(docs, abuse.train(docs, load(spark, sf, "doc_label")), keep)


def p8_found(spark, sf):
    return _marked(spark, sf, "doc_id").where(f"chance >= {abuse.CUTOFF}").select("doc_id").distinct()


def p8_scores(spark, sf):
    return _marked(spark, sf, "doc_id", "source")


def p8_rates(spark, sf):
    return abuse.rates(_marked(spark, sf, "source"))


def queries():
    found = (p1_found, p3_found, p4_sample, p5_found, p6_ids, p6_decoded, p6_offsets, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in found}


GROUPS = """
WITH RECURSIVE n AS (SELECT id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM docs WHERE text IS NOT NULL),
d AS (SELECT id, t FROM n WHERE length(t) >= 40),
g AS (SELECT DISTINCT id, substr(t, i, 3) AS s FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM d)),
k AS (SELECT id, count(*) AS size FROM g GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM g x JOIN g y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
e AS (SELECT a, b FROM shared JOIN k p ON p.id = a JOIN k q ON q.id = b WHERE n >= 0.8 * (p.size + q.size - n)),
r AS (SELECT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id)
SELECT CAST(min(m) AS BIGINT) AS group_id, CAST(id AS BIGINT) AS id FROM r GROUP BY id
"""


def oracle_sql():
    decoded = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    spans = "SELECT doc_id, CAST(0 AS INT) AS first, CAST(length(coalesce(text, '')) AS INT) AS last, true AS whole FROM documents"
    return {"p4_sample": stable_sample.oracle(), "p5_found": GROUPS, "p6_decoded": decoded, "p6_offsets": spans}
