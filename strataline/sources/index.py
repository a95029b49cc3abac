"""One run from a source tree to stored tables, and its incremental variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline import schemas as S
from strataline.operators import resolution
from strataline.session import Stored, shared_dir
from strataline.sources import channels, discovery, extract, references

#: Tables of an index; ``uses`` keeps what texts refer to, so that names can be resolved again without reading them.
TABLES = ("files", "symbols", "edges", "imports", "api_endpoints", "channel_hits", "documents", "uses")


def _number(*cols):
    """An id that follows from the row, not from the run; never negative."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))


def _endpoints(files: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, *e) for p, t in zip(b["path"], b["content"]) for e in extract.endpoints(t)]
            yield pd.DataFrame(rows, columns=["file_path", "path_pattern", "http_method", "role", "line"])

    return files.select("path", "content").mapInPandas(run, "file_path string, path_pattern string, http_method string, role string, line int")


def extracted(files: DataFrame, now_ms: int, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables that follow from each file alone; ``files`` as ``discovery.discover`` gives them."""
    fid = _number(F.col("path")).alias("file_id")
    src = files.select("path", "language", "content")
    typed = lambda name, df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in S.TABLES[name].split(", "))])
    found = Stored(extract.symbols(src), "symbols-found").read()
    ids = found.select(F.col("path"), F.col("qualified_name").alias("parent"), F.col("stable_id").alias("parent_id")).groupBy("path", "parent").agg(F.min("parent_id").alias("parent_id"))
    symbols = found.join(ids, ["path", "parent"], "left").select("*", _number(F.col("stable_id")).alias("id"), fid).dropDuplicates(["stable_id"])
    out = {"files": typed("files", files.select("*", _number(F.col("path")).alias("id"), F.lit(now_ms).alias("indexed_at")))}
    out["symbols"] = typed("symbols", symbols)
    held = symbols.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("source_id"), F.col("stable_id").alias("target_id"), F.lit("contains").alias("kind"), fid, F.col("line_start").alias("line"), F.lit("resolved").alias("confidence"))
    spread = extract.go_dispatch(found).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("dispatches_to").alias("kind"))
    at = symbols.select(F.col("stable_id").alias("source_id"), "file_id", F.col("line_start").alias("line"))
    held = held.unionByName(spread.join(at, "source_id").withColumn("confidence", F.lit("heuristic")).select(*held.columns))
    out["edges"] = typed("edges", held.withColumn("id", _number("source_id", "target_id", "kind")))
    imports = extract.imports(src)
    out["imports"] = imports.select(F.col("path"), fid.alias("source_file_id"), "import_path", F.lit(False).alias("is_type_only"), "line")
    ends = _endpoints(src)
    out["api_endpoints"] = typed("api_endpoints", ends.withColumn("id", _number("file_path", "path_pattern", "role", "line")))
    texts = files.where(~F.col("is_test")).select(fid, F.col("content").alias("text"))
    hits = channels.link(texts, out["symbols"])
    out["channel_hits"] = typed("channel_hits", hits.withColumn("metadata", F.to_json(F.struct("detail"))).withColumn("id", _number("file_id", "kind", "value", "line")))
    out["documents"] = files.select(fid.alias("doc_id"), F.col("content").alias("text"), F.lit("source_file").alias("doc_kind"), "language", fid)
    out["uses"] = references.table(src, aliases)
    return out


def resolved(uses: DataFrame, symbols: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Edges of the table's schema for all references that name a symbol; across files ``file_id`` is null."""
    f = files.select(F.col("id").alias("file_id"), "path")
    # the type a member belongs to is part of its name, also where it stands in another file
    parent = F.nullif(F.regexp_extract("qualified_name", r"^(.*::.*)\.[^.]*$", 1), F.lit(""))
    e = resolution.resolve(uses, symbols.join(f, "file_id").withColumn("parent", parent), f, modules)
    e = e.join(f, "path").withColumn("file_id", F.when(~F.col("cross_file"), F.col("file_id"))).withColumn("metadata", F.lit(None).cast("string"))
    return e.withColumn("id", _number("source_id", "target_id", "kind", "path", "line")).select(*[F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in S.TABLES["edges"].split(", "))])


def _place_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the file each names, looked up anew: a target that came later is found now."""
    seen = extract.resolve_imports(imports.select("path", "import_path", "line", "source_file_id", "is_type_only"), files.select("path"))
    ids = files.select(F.col("path").alias("target"), F.col("id").alias("target_file_id"))
    return seen.join(ids, "target", "left").withColumn("id", _number("path", "import_path", "line")).select("id", "source_file_id", "target_file_id", "import_path", "is_type_only", "line", "path").dropDuplicates(["id"])


def _write(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> None:
    """Write all tables beside the old ones, then swap: a reader sees the old index or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(out)
    fs = target.getFileSystem(conf)
    fresh, old = jvm.org.apache.hadoop.fs.Path(out.rstrip("/") + ".next"), jvm.org.apache.hadoop.fs.Path(out.rstrip("/") + ".old")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{fresh}/{name}.parquet")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def build(spark: SparkSession, root: str, out: str, now_ms: int, aliases: dict[str, str] | None = None, modules: DataFrame | None = None) -> None:
    """Index the source tree ``root`` into the directory ``out``, readable as ``Tables(spark, out)``.

    ``aliases`` maps import prefixes to directories; ``modules`` has (module_path, root_dir)
    of Go modules. An empty tree gives empty tables.
    """
    shared_dir(spark)
    files = Stored(discovery.discover(spark, root), "sources").read()
    _finish(spark, extracted(files, now_ms, aliases), out, modules)


def _finish(spark: SparkSession, t: dict[str, DataFrame], out: str, modules: DataFrame | None) -> None:
    t = {k: Stored(v, f"index-{k}").read() for k, v in t.items()}
    t["edges"] = t["edges"].unionByName(resolved(t["uses"], t["symbols"], t["files"], modules))
    t["imports"] = _place_imports(t["imports"], t["files"])
    _write(spark, t, out)


def update(spark: SparkSession, root: str, out: str, now_ms: int, aliases: dict[str, str] | None = None, modules: DataFrame | None = None) -> DataFrame:
    """Bring an index up to date: (path, change, old_path) of what was done.

    Only texts of added, modified and renamed files are parsed; rows of gone or changed
    files are dropped from every table and names are resolved anew from the stored uses, so
    imports and calls find files that came later and lose those that went.
    """
    read = {k: spark.read.parquet(f"{out}/{k}.parquet") for k in TABLES}
    now = Stored(discovery.discover(spark, root), "sources").read()
    done = Stored(discovery.changes(read["files"], now), "changes").read()
    gone = done.where(F.col("change") != "added").select(F.coalesce("old_path", "path").alias("path"))
    fresh = now.join(done.where(F.col("change") != "deleted").select("path"), "path", "left_semi")
    new = extracted(fresh, now_ms, aliases)
    lost = read["files"].join(gone, "path", "left_semi").select(F.col("id").alias("file_id"))
    merged = {}
    for k, old in read.items():
        key = {"files": "id", "imports": "source_file_id", "uses": "path", "api_endpoints": "file_path"}.get(k, "file_id")
        if k == "edges":
            old = old.where(F.col("kind").isin("contains", "dispatches_to"))
        drop = gone.withColumnRenamed("path", key) if key in ("path", "file_path") else lost.withColumnRenamed("file_id", key)
        kept = old.join(drop, key, "left_anti")
        merged[k] = kept.select(*new[k].columns).unionByName(new[k])
    _finish(spark, merged, out, modules)
    return done
