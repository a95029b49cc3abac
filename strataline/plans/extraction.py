"""Extraction over the source texts of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.sources import extract
from strataline.tables import Tables, with_views

#: Languages that SQL patterns can follow line by line.
BRACED = ("typescript", "javascript", "go", "rust")


def sources(t: Tables, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(path, language, content) of the texts of files."""
    d = t.raw("documents").where((F.col("doc_kind") == "source_file") & F.col("file_id").isNotNull() & F.col("text").isNotNull())
    d = d if languages is None else d.where(F.col("language").isin(*languages))
    f = t.files.select(F.col("id").alias("file_id"), "path")
    return d.select("file_id", "language", F.col("text").alias("content")).join(f, "file_id").select("path", "language", "content").distinct()


def imports(t: Tables) -> DataFrame:
    return extract.imports(sources(t, BRACED)).distinct()


def import_targets(t: Tables) -> DataFrame:
    """Relative imports of scripts with the file each names, or null."""
    found = extract.imports(sources(t, BRACED[:2])).where(F.col("import_path").startswith("."))
    return extract.resolve_imports(found, t.files.select("path")).distinct()


def functions(t: Tables) -> DataFrame:
    """(path, name, line): functions declared outside types."""
    s = extract.symbols(sources(t, ("typescript", "javascript", "go")))
    return s.where((F.col("kind") == "function") & ~F.col("name").startswith("test:")).select("path", "name", F.col("line_start").alias("line")).distinct()


def _q(f):
    return lambda spark, d: f(Tables(spark, d))


QUERIES = {"extract_imports": _q(imports), "extract_import_targets": _q(import_targets), "extract_functions": _q(functions)}

_LINES = """WITH d AS (SELECT DISTINCT f.path, x.language, string_split(x.text, chr(10)) AS l FROM documents x JOIN fc f ON f.id = x.file_id WHERE x.doc_kind = 'source_file' AND x.text IS NOT NULL),
l AS (SELECT path, language, unnest(l) AS s, unnest(range(1, len(l) + 1))::INT AS line FROM d),
i AS (SELECT path, line, CASE language WHEN 'go' THEN regexp_extract(s, '^\\s*(?:import\\s+)?(?:[\\w.]+\\s+)?"([\\w./-]+)"\\s*$', 1) WHEN 'rust' THEN regexp_extract(s, '^\\s*(?:pub\\s+)?use\\s+([\\w:]+)', 1)
  ELSE coalesce(nullif(regexp_extract(s, '(?:import|export)\\b[^''"]*?from\\s*[''"]([^''"]+)[''"]', 1), ''), regexp_extract(s, '(?:import|require)\\s*[(]\\s*[''"]([^''"]+)[''"]', 1)) END AS import_path, language FROM l WHERE language IN ('typescript', 'javascript', 'go', 'rust')),
known AS (SELECT regexp_replace(regexp_replace(path, '[.]\\w+$', ''), '/index$', '') AS k, min(path) AS target FROM fc GROUP BY 1)
"""

ORACLE = {
    "extract_imports": with_views(_LINES + "SELECT DISTINCT path, import_path, line FROM i WHERE import_path <> ''"),
    "extract_import_targets": with_views(
        _LINES + """SELECT DISTINCT path, import_path, line, target FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') || '/' || regexp_replace(import_path, '^[.]/', '') AS k FROM i
        WHERE language IN ('typescript', 'javascript') AND starts_with(import_path, '.')) x LEFT JOIN known USING (k)"""
    ),
    "extract_functions": with_views(
        _LINES + """SELECT DISTINCT path, name, line FROM (SELECT path, line, CASE language WHEN 'go' THEN regexp_extract(s, '^\\s*func\\s+(\\w+)', 1)
        ELSE coalesce(nullif(regexp_extract(s, '^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function[*]?\\s+([\\w$]+)', 1), ''),
          regexp_extract(s, '^\\s*(?:export\\s+)?(?:const|let|var)\\s+([\\w$]+)\\s*(?::[^=]+)?=\\s*(?:async\\s*)?(?:[(][^)]*[)]|[\\w$]+)\\s*(?::[^=]+)?=>', 1)) END AS name FROM l WHERE language IN ('typescript', 'javascript', 'go')) WHERE name <> ''"""
    ),
}
