"""Change history: diffs, change couplings and what they teach about edge weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Fixed values of the mining rules.
MAX_FILES, MAX_ITEMS, MIN_ITEMS, MIN_SUPPORT, MIN_JACCARD = 25, 40, 2, 2, 0.05
LAYER_DEFAULTS = {"AST Parent": 0.8, "Call": 1.0, "Type Ref": 0.6, "Import": 0.3}
COEDIT_DEFAULT = 0.5


def parse_diff(diffs: DataFrame) -> DataFrame:
    """(key, path, row) of every changed row, 0-based, of unified diffs (key, diff).

    Rows are numbered within a diff; the current file and hunk are carried forward
    and added and context rows counted, all in windows over one diff.
    """
    lines = diffs.select("key", F.posexplode(F.split("diff", "\r?\n")).alias("n", "line"))
    file = F.when(F.col("line").startswith("+++ ") & ~F.col("line").startswith("+++ /dev/null"), F.regexp_replace(F.trim(F.substring("line", 5, 1 << 30)), "^b/", ""))
    hunk = F.when(F.col("line").startswith("@@ "), F.regexp_extract("line", r"\+(\d+)", 1).cast("int"))
    x = lines.select("key", "n", "line", file.alias("f"), hunk.alias("h"))
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("path", F.last("f", True).over(w)).withColumn("hunk", F.last("h", True).over(w)).withColumn("block", F.count("h").over(w))
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    step = (plus | F.col("line").startswith(" ")).cast("int")
    before = Window.partitionBy("key", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("done", F.coalesce(F.sum(step).over(before), F.lit(0)))
    hit = x.where((plus | minus) & F.col("path").isNotNull())
    return hit.select("key", "path", F.greatest(F.coalesce("hunk", F.lit(0)) + F.col("done") - 1, F.lit(0)).cast("bigint").alias("row")).distinct()


def parse_log(log: DataFrame) -> DataFrame:
    """(key, hash, ts, diff): the commits of log texts (key, log) whose commits open with a COMMIT_DELIMITER row."""
    parts = log.select("key", F.posexplode(F.split("log", r"(?:^|\n)COMMIT_DELIMITER ")).alias("n", "c")).where("n > 0")
    head = F.split(F.trim(F.regexp_extract("c", r"^([^\n]*)", 1)), r"\s+")
    return parts.select("key", F.get(head, F.lit(0)).alias("hash"), F.coalesce(F.expr("try_cast(get(split(trim(regexp_extract(c, '^([^\\n]*)', 1)), '\\\\s+'), 1) as bigint)"), F.lit(0)).alias("ts"), F.regexp_replace("c", r"^[^\n]*\n?", "").alias("diff"))


def changed_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, id, hits, weight): symbols whose span holds changed rows; of a file without any, all its symbols.

    `rows` (key, path, row); `symbols` (id, file_path, start_row, end_row) and, where paths recur in several
    checkouts, the `key` they belong to. Paths in one spelling match if they are equal or one of them ends
    with the other's components. The join is by the file's name (and the key); the interval and the folders
    are residuals of that equi-join, so no inequality join is planned.
    """
    keyed = [c for c in ("key",) if c in symbols.columns]
    name = F.substring_index("path", "/", -1)
    r = rows.select("key", T.normalized_path(F.col("path")).alias("path"), "row").withColumn("name", name)
    s = symbols.select(*keyed, "id", T.normalized_path(F.col("file_path")).alias("path"), "start_row", "end_row").withColumn("name", name).withColumnRenamed("path", "own")
    slash = lambda c: F.concat(F.lit("/"), F.col(c))
    j = r.join(s, [*keyed, "name"]).where((F.col("path") == F.col("own")) | F.endswith(slash("path"), slash("own")) | F.endswith(slash("own"), slash("path")))
    inside = (F.col("row") >= F.col("start_row")) & (F.col("row") <= F.col("end_row"))
    hits = j.groupBy("key", "path", "id").agg(F.sum(inside.cast("int")).alias("hits"))
    any_hit = F.max("hits").over(Window.partitionBy("key", "path"))
    hits = hits.withColumn("any", any_hit).where("hits > 0 or any = 0").groupBy("key", "id").agg(F.greatest(F.sum("hits"), F.lit(1)).alias("hits"))
    raw = 1.0 + F.col("hits") * 0.2
    top = F.max(raw).over(Window.partitionBy("key"))
    return hits.withColumn("weight", F.greatest(F.least(raw / top, F.lit(1.0)), F.lit(0.1)))


def commit_sizes(items: DataFrame, max_items: int = MAX_ITEMS, max_files: int = MAX_FILES) -> DataFrame:
    """(grp, commit, t, n, n_files, megacommit, valid): commits of `items` (grp, commit, ts, item, and `path` if known).

    A row with null item counts its file only. A commit of more files or items than the limits is a
    megacommit; any other is valid from MIN_ITEMS items on.
    """
    files = F.countDistinct("path") if "path" in items.columns else F.lit(0)
    c = items.groupBy("grp", "commit").agg(F.max("ts").alias("t"), F.countDistinct("item").alias("n"), files.alias("n_files"))
    mega = (F.col("n_files") > max_files) | (F.col("n") > max_items)
    return c.withColumn("megacommit", mega).withColumn("valid", ~mega & (F.col("n") >= MIN_ITEMS))


def valid_items(items: DataFrame, half_life_days: float = 90.0, max_items: int = MAX_ITEMS, max_files: int = MAX_FILES) -> DataFrame:
    """(grp, commit, item, w): the distinct items of valid commits with the commit's weight by recency before the group's last commit."""
    size = commit_sizes(items, max_items, max_files)
    last = size.groupBy("grp").agg(F.max("t").alias("last_t"))
    ok = size.where("valid").join(last, "grp").select("grp", "commit", T.recency_weight(F.col("last_t") - F.col("t"), half_life_days).alias("w"))
    return items.where("item is not null").select("grp", "commit", "item").distinct().join(ok, ["grp", "commit"])


def couplings(items: DataFrame, half_life_days: float = 90.0, max_items: int = MAX_ITEMS, min_support: int = MIN_SUPPORT, min_jaccard: float = MIN_JACCARD, max_files: int = MAX_FILES) -> DataFrame:
    """(grp, src, dst, raw_count, support, confidence, jaccard), both directions of every coupled pair.

    `items` as in `commit_sizes`; valid commits count, weighted by recency. Pairs come from
    a self-join within commits, which the item limit bounds.
    """
    v = valid_items(items, half_life_days, max_items, max_files)
    one = v.groupBy("grp", "item").agg(F.sum("w").alias("c"))
    a = v.select("grp", "commit", F.col("item").alias("u"), "w")
    b = v.select("grp", "commit", F.col("item").alias("v"))
    pairs = a.join(b, ["grp", "commit"]).where("u < v").groupBy("grp", "u", "v").agg(F.count("*").alias("raw_count"), F.sum("w").alias("support")).where(F.col("raw_count") >= min_support)
    p = pairs.join(one.select("grp", F.col("item").alias("u"), F.col("c").alias("cu")), ["grp", "u"]).join(one.select("grp", F.col("item").alias("v"), F.col("c").alias("cv")), ["grp", "v"])
    p = p.withColumn("jaccard", F.col("support") / F.greatest(F.col("cu") + F.col("cv") - F.col("support"), F.lit(1e-6))).where(F.col("jaccard") >= min_jaccard)

    def directed(s: str, d: str, c: str) -> DataFrame:
        return p.select("grp", F.col(s).alias("src"), F.col(d).alias("dst"), "raw_count", "support", F.least(F.col("support") / F.greatest(F.col(c), F.lit(1e-6)), F.lit(1.0)).alias("confidence"), "jaccard")

    return directed("u", "v", "cu").unionByName(directed("v", "u", "cv"))


def directed_edges(coupled: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """(grp, src, dst, relation, weight): couplings of at least a confidence as edges of a graph."""
    return coupled.where(F.col("confidence") >= min_confidence).select("grp", "src", "dst", F.lit("CoChangesWith").alias("relation"), F.col("confidence").alias("weight"))


def couplings_of(coupled: DataFrame, k: int | None = None) -> DataFrame:
    """`coupled` with the rank of each partner of its source, the most confident first; the `k` best where given."""
    w = Window.partitionBy("grp", "src").orderBy(F.desc("confidence"), F.desc("raw_count"), "dst")
    ranked = coupled.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def confidence_of(coupled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, src, dst, confidence, jaccard) of the asked (grp, src, dst), 0 where the two are not coupled."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return pairs.select("grp", "src", "dst").join(coupled, ["grp", "src", "dst"], "left").select("grp", "src", "dst", zero("confidence"), zero("jaccard"))


def learned_weights(rates: DataFrame, commits: DataFrame, confidence: DataFrame) -> DataFrame:
    """(grp, layer, weight): layer weights shrunk towards their defaults by the number of valid commits.

    `rates` (grp, layer, rate) of all four layers; `commits` (grp, valid); `confidence` (grp, mean_confidence), absent for groups without couplings.
    """
    default = F.create_map(*[F.lit(x) for kv in LAYER_DEFAULTS.items() for x in kv])[F.col("layer")]
    w = Window.partitionBy("grp")
    x = rates.join(commits, "grp").withColumn("d", default).withColumn("top", F.max("rate").over(w))
    lam = F.least(F.greatest(F.exp(-F.col("valid") / 50.0), F.lit(0.10)), F.lit(0.85))
    raw = F.greatest((1 - lam) * F.when(F.col("top") > 0, F.col("rate") / F.col("top")).otherwise(F.col("d")) + lam * F.col("d"), F.lit(0.15))
    x = x.withColumn("raw", raw)
    static = x.withColumn("weight", F.floor(F.col("raw") / F.greatest(F.max("raw").over(w), F.lit(0.01)) * 100 + 0.5) / 100).select("grp", "layer", "weight")
    c = commits.join(confidence, "grp", "left")
    coedit = F.coalesce(F.floor(F.least(F.greatest(0.35 + 0.45 * F.col("mean_confidence"), F.lit(0.2)), F.lit(0.9)) * 100 + 0.5) / 100, F.lit(COEDIT_DEFAULT))
    return static.unionByName(c.select("grp", F.lit("Git Co-Edit").alias("layer"), coedit.alias("weight")))


def mean_reciprocal_rank(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(grp, sources, mrr): `ranked` (grp, src, dst, score) against the wanted (grp, src, dst); sources without a hit count 0."""
    r = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "src").orderBy(F.desc("score"), "dst")))
    hit = r.join(targets.select("grp", "src", "dst").distinct(), ["grp", "src", "dst"]).groupBy("grp", "src").agg(F.min("rank").alias("first"))
    src = targets.select("grp", "src").distinct().join(hit, ["grp", "src"], "left")
    return src.groupBy("grp").agg(F.count("*").alias("sources"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
