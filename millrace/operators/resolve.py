"""Scoped name resolution: references to symbols by prioritised equi-joins, the first that matches wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def resolve(refs: DataFrame, symbols: DataFrame, bindings: DataFrame | None = None, wildcards: DataFrame | None = None, imported: DataFrame | None = None) -> DataFrame:
    """(repo_id, file_path, ident, id, confidence, priority) of each reference that has a target.

    `refs` (repo_id, file_path, ident); `symbols` (id, repo_id, file_path, name);
    `bindings` (repo_id, file_path, local_name, id) explicit imports; `wildcards` and
    `imported` (repo_id, file_path, target_path) files whose names are open to, or
    imported by, a file. Branches: 1 explicit binding, 2 member of a namespace, 3 same
    file, 4 same folder (Go), 5 wildcard, 6 unique name, 7 the only imported
    candidate, 8 nearest path. Equal candidates go to the smaller id.
    """
    r = refs.select("repo_id", "file_path", "ident").distinct().withColumn("base", F.regexp_extract("ident", r"([^.:]+)$", 1)).withColumn("hint", F.regexp_extract("ident", r"^(.+?)(?:::|\.)[^.:]+$", 1))
    s = symbols.select("id", "repo_id", F.col("file_path").alias("target_path"), "name")
    counts = s.groupBy("repo_id", "name").agg(F.count("*").alias("k"))
    named = s.join(counts, ["repo_id", "name"])
    j = r.join(named.withColumnRenamed("name", "base"), ["repo_id", "base"])
    if imported is not None:
        i = imported.select("repo_id", "file_path", "target_path").distinct().withColumn("is_imported", F.lit(True))
        j = j.join(i, ["repo_id", "file_path", "target_path"], "left").withColumn("is_imported", F.coalesce("is_imported", F.lit(False)))
    else:
        j = j.withColumn("is_imported", F.lit(False))
    j = materialized_distance(j)
    plain = F.col("ident") == F.col("base")
    go = F.col("file_path").endswith(".go") & F.col("target_path").endswith(".go") & (F.col("distance") == 1)
    hint = F.when((F.col("hint") != "") & F.expr("contains(target_path, hint)"), 0.3).otherwise(0.0)
    near = F.least(F.col("score") + hint, F.lit(1.0))
    near = F.greatest(F.least(near + F.when(F.col("is_imported"), 0.4).otherwise(0.0), F.lit(1.0)), F.lit(0.1))
    only = F.sum(F.col("is_imported").cast("int")).over(Window.partitionBy("repo_id", "file_path", "ident")) == 1
    j = j.withColumn("only", only)
    priority = F.when(plain & (F.col("distance") == 0), 3).when(plain & go, 4).when(F.col("k") == 1, 6).when(F.col("only") & F.col("is_imported"), 7).otherwise(8)
    confidence = F.when(priority <= 4, 1.0).when(priority == 6, F.col("score")).when(priority == 7, 0.95).otherwise(near)
    keep = ["repo_id", "file_path", "ident", "id"]
    found = [j.select(*keep, confidence.alias("confidence"), priority.alias("priority"))]
    if bindings is not None:
        b = bindings.select("repo_id", "file_path", F.col("local_name").alias("ident"), "id").distinct()
        found.append(r.join(b, ["repo_id", "file_path", "ident"]).select(*keep, F.lit(1.0).alias("confidence"), F.lit(1).alias("priority")))
    if wildcards is not None:
        w = wildcards.select("repo_id", "file_path", "target_path").distinct()
        x = r.join(w, ["repo_id", "file_path"]).join(s.withColumnRenamed("name", "base"), ["repo_id", "target_path", "base"])
        found.append(x.select(*keep, F.lit(0.9).alias("confidence"), F.lit(5).alias("priority")))
    every = reduce(DataFrame.unionByName, found)
    first = Window.partitionBy("repo_id", "file_path", "ident").orderBy("priority", F.desc("confidence"), "id")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def materialized_distance(j: DataFrame) -> DataFrame:
    """Adds distance and score of (file_path, target_path)."""
    return j.withColumn("distance", T.path_distance(F.col("file_path"), F.col("target_path"))).withColumn("score", T.scope_score(F.col("distance")))


def module_candidates(path, specifier):  # noqa: ANN001, ANN201 - columns
    """ARRAY<STRING> of the paths that a module specifier may mean, in the order they are tried.

    Relative specifiers are joined to the importing file's folder; `..` climbs.
    """
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    relative = specifier.rlike(r"^\.{1,2}/")
    up = F.regexp_count(specifier, F.lit(r"\.\./"))
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), "/")
    tail = F.regexp_replace(specifier, r"^(?:\.{1,2}/)+", "")
    joined = F.when(base == "", tail).otherwise(F.concat(base, F.lit("/"), tail))
    ts = [F.concat(joined, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]
    dotted = F.regexp_replace(F.regexp_replace(specifier, r"^\.+", ""), r"\.", "/")
    py_base = F.when(specifier.startswith("."), F.concat_ws("/", folder, dotted)).otherwise(dotted)
    py = [F.concat(py_base, F.lit(x)) for x in (".py", "/__init__.py")]
    rust_tail = F.regexp_replace(F.regexp_replace(specifier, r"^(?:crate|self|super)::", ""), "::", "/")
    rust_base = F.when(specifier.startswith("super::"), F.concat_ws("/", folder, rust_tail)).otherwise(F.concat(F.lit("src/"), rust_tail))
    rust = [F.concat(rust_base, F.lit(x)) for x in (".rs", "/mod.rs")]
    return F.when(relative, F.array(*ts)).when(path.endswith(".py"), F.array(*py)).when(path.endswith(".rs"), F.array(*rust)).otherwise(F.array(specifier))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, file_path, module_specifier, target_path): the first candidate that is a file of the repository."""
    i = imports.select("repo_id", T.normalized_path(F.col("file_path")).alias("file_path"), "module_specifier").distinct()
    c = i.select("*", F.posexplode(module_candidates(F.col("file_path"), F.col("module_specifier"))).alias("n", "target_path"))
    known = files.select("repo_id", T.normalized_path(F.col("file_path")).alias("target_path")).distinct()
    return c.join(known, ["repo_id", "target_path"]).groupBy("repo_id", "file_path", "module_specifier").agg(F.min_by("target_path", "n").alias("target_path"))
