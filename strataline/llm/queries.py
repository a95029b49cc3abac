"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.llm import cooccurrence, doc_pairs, leaks, lookalikes, mixing, names, neighbours, provenance
from strataline.session import table


def _sources(spark, d):
    return table(spark, d, "documents").where(F.col("doc_kind") == "source_file")


def p1_found(spark, d):
    return doc_pairs.symbol_pairs(table(spark, d, "symbols"), _sources(spark, d), with_body=False).select("stable_id").distinct()


def p1_pairs(spark, d):
    """Signature, description and body of every documented function and method."""
    return doc_pairs.symbol_pairs(table(spark, d, "symbols"), _sources(spark, d))


def p1_origins(spark, d):
    """How many pairs were captured in a source text and how many come from stored columns."""
    pairs = doc_pairs.symbol_pairs(table(spark, d, "symbols"), _sources(spark, d), with_body=False)
    return pairs.groupBy("origin").agg(F.count(F.lit(1)).alias("pairs"))


def p1_source_pairs(spark, d):
    """Documented functions with their bodies, out of the source texts themselves."""
    return doc_pairs.source_pairs(_sources(spark, d))


def p2_found(spark, d):
    return cooccurrence.files_together(table(spark, d, "file_changes")).select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p2_lift(spark, d):
    """The same pairs with their counts and how far they exceed chance."""
    t = cooccurrence.files_together(table(spark, d, "file_changes"))
    return t.select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n", F.round("lift", 6).alias("lift"))


def p3_found(spark, d):
    return provenance.not_by_hand(table(spark, d, "files"), table(spark, d, "documents"))


def p3_origins(spark, d):
    """Kind and grammar figures of every path."""
    return provenance.origins(table(spark, d, "files"), table(spark, d, "documents"))


def p4_found(spark, d):
    return names.same_entity(table(spark, d, "commits"))


def p4_entities(spark, d):
    """Every identity with its entity and the rarity of the form that joined it."""
    e = names.entities(table(spark, d, "commits"))
    least = e.groupBy("entity").agg(F.min("identity").alias("entity_name"))
    return e.join(least, "entity").select("identity", "entity_name", "score")


def p5_found(spark, d):
    pairs = neighbours.similar_symbols(table(spark, d, "embedding_meta"), table(spark, d, "symbol_embeddings"))
    return pairs.select("stable_id_a", "stable_id_b")


def p5_search(spark, d):
    """Greedy graph search for every symbol whose id is divisible by 100."""
    return neighbours.search_symbols(table(spark, d, "embedding_meta"), table(spark, d, "symbol_embeddings"))


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_near(spark, d):
    """Exact and proximity matches (up to two other words between two words of an item)."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), slop=2)


def p9_mix(spark, d):
    """How often each document is used in the mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    """Shares reached by the mix, beside their targets."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark, d):
    return lookalikes.same_look(table(spark, d, "documents"))


def p10_spellings(spark, d):
    """Canonical spelling of every token that is not plain ASCII."""
    return lookalikes.spellings(table(spark, d, "documents").select("text"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_origins, p1_source_pairs, p2_found, p2_lift, p3_found, p3_origins, p4_found, p4_entities, p5_found, p5_search, p8_found, p8_near, p9_mix, p9_shares, p10_found, p10_spellings)
}

_TOGETHER = """
WITH f AS (SELECT DISTINCT split_part(file_path, '/', 1) AS p, commit_hash, file_path FROM file_changes
           WHERE file_path LIKE '%/%' AND commit_hash IS NOT NULL),
n AS (SELECT p, count(DISTINCT commit_hash) AS total FROM f GROUP BY p),
a AS (SELECT p, file_path, count(*) AS a FROM f GROUP BY p, file_path),
g AS (SELECT x.p, x.file_path AS file_a, y.file_path AS file_b, count(*) AS n
      FROM f x JOIN f y ON x.p = y.p AND x.commit_hash = y.commit_hash AND x.file_path < y.file_path GROUP BY ALL)
"""
_TOGETHER_FROM = """ FROM g JOIN n ON n.p = g.p JOIN a u ON u.p = g.p AND u.file_path = file_a JOIN a v ON v.p = g.p AND v.file_path = file_b
WHERE g.n >= 4 AND g.n * total >= 4 * u.a * v.a"""

_LEAKS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(unnest([intent, expected])), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS passage FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (passage)"""

_SIMILAR = """
WITH e AS (SELECT symbol_id, min(embedding) AS v FROM symbol_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
x AS (SELECT m.symbol_stable_id AS id, min(e.v)::DOUBLE[] AS v FROM embedding_meta m JOIN e USING (symbol_id) GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM x a JOIN x b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c WHERE s >= 0.9)
SELECT DISTINCT least(a, b) AS stable_id_a, greatest(a, b) AS stable_id_b FROM t WHERE r <= 5"""

ORACLE = {
    "p5_found": _SIMILAR,
    "p8_found": _LEAKS,
    "p2_found": _TOGETHER + "SELECT file_a, file_b" + _TOGETHER_FROM,
    "p2_lift": _TOGETHER + "SELECT file_a, file_b, g.n, round(g.n * total / (u.a * v.a), 6) AS lift" + _TOGETHER_FROM,
}
