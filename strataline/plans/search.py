"""Text and vector search over symbols and source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import embedding
from strataline.operators import text as T
from strataline.operators import vector as V
from strataline.plans import starts
from strataline.tables import Tables, with_views

# Kinds that are compared for duplicates, least length of their text
DUPLICATE_KINDS = ("function", "method", "class", "type", "interface", "enum")
DUPLICATE_SPAN = 60
#: Queries of the exact searches: ids divisible by this.
EVERY = 100


def vectors(t: Tables, dim: int = 64) -> DataFrame:
    """(id, v): one usable vector per embedded symbol."""
    v = t.raw("symbol_embeddings").where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    return v.groupBy(F.col("symbol_id").alias("id")).agg(F.min("embedding").alias("v"))


def semantic_search(t: Tables, k: int = 5, include_tests: bool = False) -> DataFrame:
    """The ``k`` nearest symbols of every hundredth one, tests filtered before the cut."""
    meta = t.raw("embedding_meta").select("symbol_stable_id", F.col("symbol_id").alias("id")).distinct()
    v = vectors(t).join(meta.select("id").distinct(), "id", "left_semi")
    rows = v
    if not include_tests:
        tests = t.placed.where("is_test").select(F.col("stable_id").alias("symbol_stable_id")).join(meta, "symbol_stable_id").select("id")
        rows = v.join(tests, "id", "left_anti")
    return V.search(v.where(F.col("id") % EVERY == 0), rows, k).select("query_id", "id", F.round("score", 6).alias("score"))


def duplicates(t: Tables, least: float = 0.92, k: int = 5, metric: str = "cosine") -> DataFrame:
    """(symbol_a_id, symbol_b_id, similarity): near-equal symbols, one among the ``k`` nearest of the other.

    Kinds and least text length as in DUPLICATE_KINDS and DUPLICATE_SPAN; pairs with a test side are left out.
    """
    ok = t.placed.where(F.col("kind").isin(*DUPLICATE_KINDS) & ~F.col("is_test") & (F.col("byte_end") - F.col("byte_start") >= DUPLICATE_SPAN)).select(F.col("stable_id").alias("symbol_stable_id"))
    ids = t.raw("embedding_meta").join(ok, "symbol_stable_id", "left_semi").select(F.col("symbol_id").alias("id")).distinct()
    hit = V.close(vectors(t).join(ids, "id", "left_semi"), k, least, metric)
    return hit.select(F.least("query_id", "id").alias("symbol_a_id"), F.greatest("query_id", "id").alias("symbol_b_id"), F.round("score", 6).alias("similarity")).distinct()


# Fixed value: what is put before a text before it is hashed
EMBED_SALT = "embed-v2\n"


def stale_embeddings(t: Tables, salt: str = EMBED_SALT) -> DataFrame:
    """Embedded symbols whose hash is not that of their text, or that have no vector: to be embedded again."""
    h = F.substring(F.sha2(F.concat(F.lit(salt), F.col("embed_text")), 256), 1, 16)
    m = t.raw("embedding_meta")
    have = t.raw("symbol_embeddings").where(F.col("embedding").isNotNull()).select("symbol_id").distinct().withColumn("has", F.lit(True))
    x = m.join(have, "symbol_id", "left").withColumn("reason", F.when(F.col("embed_hash") != h, "hash").when(F.col("has").isNull(), "vector"))
    return x.where(F.col("reason").isNotNull()).select("symbol_stable_id", "reason").distinct()


def full_text(t: Tables, query: str, limit: int | None = 20, include_tests: bool = False) -> DataFrame:
    """Symbols by BM25 over name, qualified name and comment; all query words, the last as a prefix."""
    s = t.placed if include_tests else t.placed.where(~F.col("is_test"))
    # identifiers are also searched by their parts
    parts = F.regexp_replace(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    build = lambda: T.inverted_index(s.withColumn("parts", parts), "stable_id", ["parts", "qualified_name", "doc_comment"]).sortWithinPartitions("term")
    idx = t._view("text-index-tests" if include_tests else "text-index", ("symbols", "files"), build)
    hit = T.bm25(idx, "stable_id", query).join(s.select("stable_id", "name", "kind", "path"), "stable_id")
    return hit if limit is None else hit.orderBy(F.desc("score"), "stable_id").limit(limit)


def by_meaning(t: Tables, query: str, encoder, k: int = 10, include_tests: bool = False) -> DataFrame:
    """(stable_id, distance): symbols nearest to a query text; five times ``k`` are taken before tests are dropped."""
    asked = embedding.embed(t.spark.createDataFrame([(0, "search_query: " + query)], "id long, text string"), encoder).select("id", F.col("vector").alias("v"))
    dim = asked.select(F.size("v").alias("n")).first()["n"]
    meta = t.raw("embedding_meta").select(F.col("symbol_stable_id").alias("stable_id"), F.col("symbol_id").alias("id")).distinct()
    near = V.search(asked.withColumn("id", F.lit(-1).cast("long")), vectors(t, dim), 5 * k).join(meta, "id")
    if not include_tests:
        near = near.join(t.placed.where("is_test").select("stable_id"), "stable_id", "left_anti")
    return near.select("stable_id", F.round(1 - F.col("score"), 6).alias("distance")).orderBy("distance", "stable_id").limit(k)


def embed_stale(t: Tables, encoder, salt: str = EMBED_SALT) -> DataFrame:
    """(symbol_id, symbol_stable_id, embedding, embed_hash) of the symbols whose vector is missing or old, embedded anew.

    Properties of less than DUPLICATE_SPAN + 20 bytes are no candidates.
    """
    small = t.placed.where((F.col("kind") == "property") & (F.col("byte_end") - F.col("byte_start") < DUPLICATE_SPAN + 20)).select(F.col("stable_id").alias("symbol_stable_id"))
    todo = t.raw("embedding_meta").join(stale_embeddings(t, salt).select("symbol_stable_id").distinct(), "symbol_stable_id", "left_semi").join(small, "symbol_stable_id", "left_anti")
    rows = todo.select(F.col("symbol_id").alias("id"), F.col("embed_text").alias("text")).distinct()
    new = embedding.embed(rows, encoder).select(F.col("id").alias("symbol_id"), F.col("vector").alias("embedding"))
    fresh = F.substring(F.sha2(F.concat(F.lit(salt), F.col("embed_text")), 256), 1, 16).alias("embed_hash")
    return todo.select("symbol_id", "symbol_stable_id", fresh).distinct().join(new, "symbol_id").select("symbol_id", "symbol_stable_id", "embedding", "embed_hash")


def content(t: Tables, literal: str, prefix: str = "", language: str | None = None, per_file: int | None = None) -> DataFrame:
    """Lines of source texts that hold a literal, by path."""
    f = t.files.where(F.col("path").startswith(prefix)) if prefix else t.files
    if language:
        f = f.where(F.col("language") == language)
    docs = t.raw("documents").where(F.col("doc_kind") == "source_file").join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    return T.content_search(docs.select("path", "text").distinct(), "path", "text", literal, per_file)


def content_counts(t: Tables, literal: str) -> DataFrame:
    """Exact number of matching lines per language."""
    docs = t.raw("documents").where(F.col("doc_kind") == "source_file").join(t.files.select(F.col("id").alias("file_id"), "path", F.col("language").alias("file_language")), "file_id")
    hit = T.content_search(docs.select("file_language", "path", "text").distinct().withColumn("k", F.struct("file_language", "path")), "k", "text", literal)
    return hit.groupBy(F.col("k.file_language").alias("language")).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("k.path").alias("files"))


def _q(f, **kw):
    return lambda spark, d: f(Tables(spark, d), **kw)


QUERIES = {
    "vector_semantic_search": _q(semantic_search),
    "vector_duplicates": _q(duplicates),
    "vector_duplicates_l2": _q(duplicates, metric="l2", least=0.7),
    "vector_stale": _q(stale_embeddings),
    "text_search": lambda s, d: full_text(t := Tables(s, d), starts.spoken(t)),
    "text_search_all": lambda s, d: full_text(t := Tables(s, d), starts.spoken(t).split(" ")[0][:3], limit=None),
    "text_content": _q(content, literal="return"),
    "text_content_capped": _q(content, literal="return", language="go", per_file=3),
    "text_content_counts": _q(content_counts, literal="return"),
}

_VEC = """WITH v AS (SELECT symbol_id AS id, min(embedding) AS v FROM symbol_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
m AS (SELECT DISTINCT symbol_stable_id, symbol_id AS id FROM embedding_meta),
w AS (SELECT id, v::DOUBLE[] AS v FROM v WHERE id IN (SELECT id FROM m)),
r AS (SELECT * FROM w WHERE id NOT IN (SELECT m.id FROM m JOIN sf ON sf.stable_id = m.symbol_stable_id WHERE sf.is_test)),
u AS (SELECT * FROM w WHERE id IN (SELECT m.id FROM m JOIN sf ON sf.stable_id = m.symbol_stable_id WHERE sf.kind IN ('function', 'method', 'class', 'type', 'interface', 'enum')
  AND NOT sf.is_test AND sf.byte_end - sf.byte_start >= 60)),
d AS (SELECT DISTINCT f.path, f.language, x.text FROM documents x JOIN fc f ON f.id = x.file_id WHERE x.doc_kind = 'source_file'),
l AS (SELECT path, language, line, source FROM (SELECT path, language, unnest(string_split(text, chr(10))) AS source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM d) WHERE contains(source, 'return'))
"""
_TOP = """, c AS (SELECT q.id AS query_id, x.id, round(list_cosine_similarity(q.v, x.v), 9) AS s FROM {0} q JOIN {1} x ON q.id <> x.id WHERE q.id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM c)"""
_ALL = """, c AS (SELECT q.id AS query_id, x.id, list_cosine_similarity(q.v, x.v) AS s FROM u q JOIN u x ON q.id <> x.id), e AS (SELECT query_id, id, round({0}, 9) AS s FROM (SELECT query_id, id, least(s, 1.0) AS s FROM c)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM e WHERE s >= {1})
SELECT DISTINCT least(query_id, id) AS symbol_a_id, greatest(query_id, id) AS symbol_b_id, round(s, 6) AS similarity FROM t WHERE r <= 5"""
_s = lambda tail: with_views(_VEC + tail)

ORACLE = {
    "vector_semantic_search": _s(_TOP.format("w", "r") + " SELECT query_id, id, round(s, 6) AS score FROM t WHERE r <= 5"),
    "vector_duplicates": _s(_ALL.format("s", 0.92)),
    "vector_duplicates_l2": _s(_ALL.format("1 - sqrt(2 - 2 * s)", 0.7)),
    "vector_stale": _s(
        """SELECT DISTINCT symbol_stable_id, reason FROM (SELECT symbol_stable_id, CASE WHEN embed_hash <> substr(sha256('embed-v2' || chr(10) || embed_text), 1, 16) THEN 'hash'
        WHEN symbol_id NOT IN (SELECT symbol_id FROM symbol_embeddings WHERE embedding IS NOT NULL) THEN 'vector' END AS reason FROM embedding_meta) WHERE reason IS NOT NULL"""
    ),
    "text_content": _s("SELECT path, line, substr(source, 1, 200) AS source FROM l"),
    "text_content_capped": _s("SELECT path, line, substr(source, 1, 200) AS source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM l WHERE language = 'go') WHERE r <= 3"),
    "text_content_counts": _s("SELECT language, count(*) AS lines, count(DISTINCT path) AS files FROM l GROUP BY 1"),
}
