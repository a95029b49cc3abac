"""Modules, service definitions and API schemas out of manifest files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import text as fx

# Manifest names by kind
MANIFESTS = {"go.mod": "go", "package.json": "node", "pyproject.toml": "python", "setup.py": "python"}


def manifest_name(path: str, content: str) -> tuple[str, str | None] | None:
    """(name, module path) a manifest declares, or None if it declares none."""
    base = path.rsplit("/", 1)[-1]
    if base == "go.mod":
        m = re.search(r"^\s*module\s+(\S+)", content, re.M)
        return (m[1].rsplit("/", 1)[-1], m[1]) if m else None
    if base == "package.json":
        try:
            name = json.loads(content).get("name")
        except (ValueError, AttributeError):
            return None
        return (name, None) if isinstance(name, str) and name else None
    m = re.search(r"^\s*name\s*=\s*[\"']([^\"']+)[\"']", content, re.M) or re.search(r"\bname\s*=\s*[\"']([^\"']+)[\"']", content)
    return (m[1], None) if m else None


def modules(files: DataFrame) -> DataFrame:
    """(id, name, kind, manifest_path, root_dir, module_path) of the manifests among (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                hit = manifest_name(p, c or "")
                if hit:
                    rows.append((hit[0], MANIFESTS[p.rsplit("/", 1)[-1]], p, p.rpartition("/")[0], hit[1]))
            yield pd.DataFrame(rows, columns=["name", "kind", "manifest_path", "root_dir", "module_path"])

    found = files.where(fx.basename(F.col("path")).isin(*MANIFESTS)).select("path", "content").mapInPandas(read, "name string, kind string, manifest_path string, root_dir string, module_path string")
    return found.withColumn("id", fx.module_id(F.col("manifest_path"))).select("id", "name", "kind", "manifest_path", "root_dir", "module_path")


def proto_symbols(files: DataFrame) -> DataFrame:
    """(id, path, kind, name) of the messages, services and rpcs of .proto files (path, content)."""
    clean = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    p = files.where(F.col("path").endswith(".proto")).select("path", clean.alias("c"))
    out = None
    for kind in ("message", "service", "rpc"):
        x = p.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("c", F.lit(rf"\b{kind}\s+(\w+)\s*[\{{(]"), F.lit(1))).alias("name"))
        out = x if out is None else out.unionByName(x)
    return out.distinct().select(F.concat(F.lit("proto::"), "path", F.lit("::"), "name").alias("id"), "path", "kind", "name")


# Kinds of symbols a proto symbol can stand for
PROTO_KINDS = {"message": ("class", "interface", "type"), "service": ("class", "interface"), "rpc": ("method",)}


def proto_links(protos: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, stable_id): proto symbols and the code symbols of their name and an allowed kind."""
    j = protos.withColumnRenamed("kind", "proto_kind").join(symbols.select("name", "stable_id", "kind"), "name")
    ok = F.lit(False)
    for k, kinds in PROTO_KINDS.items():
        ok = ok | ((F.col("proto_kind") == k) & F.col("kind").isin(*kinds))
    return j.where(ok).select("id", "stable_id").distinct()


def openapi_names(path: str, content: str) -> list[str]:
    """Schema names of an OpenAPI document, JSON or YAML; other documents have none."""
    if path.endswith(".json"):
        try:
            doc = json.loads(content)
        except ValueError:
            return []
        if not isinstance(doc, dict) or not ("openapi" in doc or "swagger" in doc):
            return []
        return sorted({**((doc.get("components") or {}).get("schemas") or {}), **(doc.get("definitions") or {})})
    if not re.search(r"^(?:openapi|swagger)\s*:", content, re.M):
        return []
    names, stack = [], []
    for line in content.splitlines():
        m = re.match(r"( *)([\w.$-]+|\"[^\"]+\"|'[^']+')\s*:", line)
        if not m:
            continue
        depth, key = len(m[1]), m[2].strip("\"'")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if [k for _, k in stack] in (["components", "schemas"], ["definitions"]):
            names.append(key)
        stack.append((depth, key))
    return sorted(set(names))


def openapi_schemas(files: DataFrame) -> DataFrame:
    """(path, name) of the schemas of OpenAPI files among (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n) for p, c in zip(b["path"], b["content"]) for n in openapi_names(p, c or "")]
            yield pd.DataFrame(rows, columns=["path", "name"])

    return files.where(F.col("path").rlike(r"\.(json|ya?ml)$")).select("path", "content").mapInPandas(read, "path string, name string")


def github_feed(rows: DataFrame, watermark: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pull requests, issues) of a JSON feed with a number, a title and updated_at; pull requests carry pull_request."""
    x = rows if watermark is None else rows.where(F.col("updated_at") > watermark)
    pr = x.where(F.col("pull_request").isNotNull()).drop("pull_request")
    return pr, x.where(F.col("pull_request").isNull()).drop("pull_request")
