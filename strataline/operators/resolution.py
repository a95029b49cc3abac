"""Cross-file resolution of names by joins: references x imports x symbols.

No type checker runs. A reference is looked up in the places its language would look, most
specific first: the type of its receiver, what its file imports, its file, its package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.relational import longest_prefix
from strataline.session import Stored

# Kinds of symbols that each kind of reference can name
TARGETS = {
    "calls": ("function", "method", "class", "variable"), "passed_as": ("function", "method"), "instantiates": ("class",), "extends": ("class", "interface"),
    "type_ref": ("interface", "type", "class", "enum"), "field_access": ("property", "variable", "method", "function"),
}


_TYPES = ("class", "interface", "type", "enum")


def scope_of(path):
    """Column form of ``references.file_scope``."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:d\.ts|\w+)$", ""), r"(?:^|/)(?:index|__init__|mod)$", "")


def go_scopes(wanted: DataFrame, files: DataFrame, modules: DataFrame | None) -> DataFrame:
    """(scope, dir): the directory of each Go import path (``scope`` is "go:" and the path).

    The module with the longest path that contains the import gives its directory; else a
    directory below some ``vendor`` of that path; else none.
    """
    w = wanted.where(F.col("scope").startswith("go:")).select("scope").distinct().withColumn("import_path", F.expr("substring(scope, 4)"))
    dirs = files.where(F.col("path").endswith(".go")).select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct()
    vendored = dirs.where(F.col("dir").rlike("(?:^|/)vendor/")).select(F.regexp_extract("dir", "(?:^|/)vendor/(.*)$", 1).alias("import_path"), F.col("dir").alias("vendor"))
    vendored = vendored.groupBy("import_path").agg(F.min("vendor").alias("vendor"))
    out = w.join(vendored, "import_path", "left")
    if modules is None:
        return out.where(F.col("vendor").isNotNull()).select("scope", F.col("vendor").alias("dir"))
    m = modules.select(F.regexp_replace("module_path", "/+$", "").alias("module_path"), F.struct("module_path", "root_dir").alias("module"))
    # the module's own path is a prefix of itself
    deep = longest_prefix(out.withColumn("at", F.concat("import_path", F.lit("/.")))
                          .select("scope", "import_path", "vendor", "at"), "at", m, "module_path", "module")
    rest = F.expr("substring(import_path, length(module.module_path) + 2)")
    own = F.array_join(F.filter(F.array(F.col("module.root_dir"), rest), lambda x: x.isNotNull() & ~x.isin("", ".")), "/")
    return deep.withColumn("dir", F.when(F.col("module").isNotNull(), own).otherwise(F.col("vendor"))).where(F.col("dir").isNotNull()).select("scope", "dir")


def resolve(uses: DataFrame, symbols: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, kind, path, line, col, confidence, cross_file): edges between symbols.

    ``uses`` comes from ``references.table``, ``symbols`` has (stable_id, path, name, kind,
    qualified_name, parent), ``files`` (path). A call of a class is an ``instantiates``. Of
    several targets of one reference the most specific place wins, then the smaller id; a
    reference that names no symbol has no edge. A symbol does not refer to itself.
    """
    u = Stored(uses.withColumn("ref", F.monotonically_increasing_id()), "uses").read()
    s = symbols.select("stable_id", "path", "name", F.col("kind").alias("target_kind"), "qualified_name", "parent")
    refs = u.where("what = 'ref'").select("ref", "path", "owner", "name", "receiver", "kind", "line", "col")
    binds = u.where("what = 'bind'").select("path", F.col("name").alias("local"), F.col("receiver").alias("imported"), "scope")
    typed = u.where("what = 'typed'").select("path", "owner", F.col("name").alias("receiver"), F.col("receiver").alias("type_name"), F.col("kind").alias("package")).distinct()
    go = go_scopes(binds, files, modules)
    binds = binds.join(go, "scope", "left").withColumn("scope", F.when(F.col("dir").isNotNull(), F.concat(F.lit("dir:"), "dir")).otherwise(F.col("scope"))).drop("dir").distinct()
    folder = F.concat(F.lit("dir:"), F.regexp_replace("path", "/?[^/]*$", ""))
    top = s.where(F.col("parent").isNull() | (F.col("target_kind") != "method"))
    here = top.withColumn("scope", scope_of(F.col("path")))
    placed = Stored(here.unionByName(top.where(F.col("path").endswith(".go")).withColumn("scope", folder)), "scoped").read()
    goal = placed.select("scope", "name", F.col("stable_id").alias("target_id"), "target_kind", F.col("path").alias("target_path"))

    def named(rows: DataFrame) -> DataFrame:
        """Rows with (path, name, receiver) joined to what the name means at their place: target and rank."""
        local = rows.where(F.col("receiver").isNull())
        direct = local.join(binds.where("imported <> '*'").withColumnRenamed("local", "name").withColumnRenamed("scope", "from"), ["path", "name"])
        direct = direct.withColumn("name", F.when(F.col("imported") == "default", F.col("name")).otherwise(F.col("imported"))).withColumnRenamed("from", "scope").drop("imported").withColumn("rank", F.lit(2))
        whole = rows.where(F.col("receiver").isNotNull()).join(binds.where("imported = '*'").select("path", F.col("local").alias("receiver"), "scope"), ["path", "receiver"]).withColumn("rank", F.lit(2))
        own = local.withColumn("scope", scope_of(F.col("path"))).withColumn("rank", F.lit(3))
        package = local.where(F.col("path").endswith(".go")).withColumn("scope", folder).withColumn("rank", F.lit(4))
        cols = [*rows.columns, "scope", "rank"]
        places = direct.select(*cols).unionByName(whole.select(*cols)).unionByName(own.select(*cols)).unionByName(package.select(*cols))
        return places.join(goal, ["scope", "name"]).drop("scope")

    plain = named(refs)

    # members: the type of the receiver is a variable's type, the class around (this, self), or the receiver itself
    is_go = F.col("path").endswith(".go")
    within = lambda name: F.concat(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("::"), name)
    type_key = F.when(is_go, within(F.col("name"))).otherwise(F.col("qualified_name"))  # methods of Go may stand in another file of the package
    parent_key = F.when(is_go, within(F.substring_index("parent", "::", -1))).otherwise(F.col("parent"))
    cls = s.where(F.col("target_kind").isin(*_TYPES)).select(F.col("stable_id").alias("target_id"), type_key.alias("type"))
    inner = s.where(F.col("parent").isNotNull()).withColumn("type", parent_key)
    members = inner.select("type", "name", F.col("stable_id").alias("target_id"), "target_kind", F.col("path").alias("target_path"))
    types = typed.select("path", F.col("type_name").alias("name"), F.col("package").alias("receiver"))
    direct = refs.where(F.col("receiver").isNotNull()).select("path", F.col("receiver").alias("name"), F.lit(None).cast("string").alias("receiver"))
    known = named(types.unionByName(direct).distinct()).where(F.col("target_kind").isin(*_TYPES))
    known = known.groupBy("path", "name", "receiver").agg(F.min(F.struct("rank", "target_id")).alias("t")).select("path", F.col("name").alias("type_name"), F.col("receiver").alias("package"), "t.target_id")
    known = Stored(known.join(cls, "target_id").drop("target_id"), "types").read()
    variable = refs.join(typed.withColumnRenamed("package", "of"), ["path", "owner", "receiver"]).join(known, ["path", "type_name"]).where(F.col("of").eqNullSafe(F.col("package")))
    static = refs.join(known.where(F.col("package").isNull()).select("path", F.col("type_name").alias("receiver"), "type"), ["path", "receiver"])
    around = inner.select("path", F.col("qualified_name").alias("owner"), "type").distinct()
    itself = refs.where(F.col("receiver").isin("this", "self", "Self")).join(around, ["path", "owner"])
    cols = [*refs.columns, "type"]
    with_type = variable.select(*cols).unionByName(static.select(*cols)).unionByName(itself.select(*cols)).distinct()
    member = with_type.join(members, ["type", "name"]).drop("type").withColumn("rank", F.lit(1))

    both = plain.unionByName(member.select(*plain.columns))
    fits = F.lit(False)
    for kind, targets in TARGETS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("target_kind").isin(*targets))
    best = both.where(fits).groupBy("ref", "path", "owner", "kind", "line", "col").agg(F.min(F.struct("rank", "target_id", "target_kind", "target_path")).alias("t"))
    owners = s.select("path", F.col("qualified_name").alias("owner"), F.col("stable_id").alias("source_id")).groupBy("path", "owner").agg(F.min("source_id").alias("source_id"))
    kind = F.when((F.col("kind") == "calls") & (F.col("t.target_kind") == "class"), "instantiates").otherwise(F.col("kind"))
    out = best.join(owners, ["path", "owner"]).select("source_id", F.col("t.target_id").alias("target_id"), kind.alias("kind"), "path", "line", "col", F.lit("resolved").alias("confidence"), (F.col("t.target_path") != F.col("path")).alias("cross_file"))
    return out.where(F.col("source_id") != F.col("target_id")).dropDuplicates(["source_id", "target_id", "kind", "path", "line"])


def rebind(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (path, import_path, line, target) whose target was not known, looked up again among ``files``."""
    from strataline.sources.extract import resolve_imports

    open_ = imports.where(F.col("target").isNull()).drop("target")
    return imports.where(F.col("target").isNotNull()).unionByName(resolve_imports(open_, files).select(*imports.columns))
