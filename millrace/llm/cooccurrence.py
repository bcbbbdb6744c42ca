"""Problem 2: items that appear together, by stripes.

A basket here is one commit of one mining run. Baskets outside the validity
limits (2 to 40 items, at most 25 file paths) are dropped by counts alone, so
that a bulk commit is never gathered. Each valid basket is one short array.
Every map task keeps, per item, an associative array of the neighbours met so
far and hands it on as a *stripe*; stripes of one item are then merged by key in
a sorted stream. A stripe is split into PARTS by its neighbours, so that no item
has all of them in one task; the item itself is a neighbour of its own, which counts
it. The significance of a pair is Dunning's log-likelihood ratio against independence.

Defined cases: rows without run or commit hash belong to no basket; a null item
counts its file path only; letter case of the hash and leading `./` of a path do
not matter; repeated rows count once; an empty table gives no pairs. Scale: the
shuffles are by (run, commit, item) and (run, commit, path) with map-side combine,
by basket, and by (run, item, part) of stripes, of which a hot item has at most one
per map task, flush and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values of the mining rules.
MAX_FILES, MAX_ITEMS, MIN_ITEMS = 25, 40, 2
HALF_LIFE_DAYS, MIN_WEIGHT, MAX_WEIGHT = 90.0, 0.001, 1.0
#: Neighbour entries that a map task keeps before it hands its stripes on.
FLUSH_ENTRIES = 500_000
#: Parts of an item's stripe, by its neighbours.
PARTS = 8
#: Log-likelihood ratio from which a pair is more than chance at one in a thousand.
SIGNIFICANT = 10.83

_STRIPE = "run_id bigint, u bigint, part int, v array<bigint>, c array<bigint>, mass array<double>"
_PAIR = "run_id bigint, src_id bigint, dst_id bigint, together bigint, mass double"


def touches(commits: DataFrame) -> DataFrame:
    """(run_id, h, item, path, ts): the rows that belong to a commit, in one spelling; `h` is binary, half as long for hexadecimal hashes."""
    low = F.lower("commit_hash")
    return commits.where("run_id is not null and commit_hash is not null").select(
        "run_id",
        F.when(low.rlike("^(?:[0-9a-f]{2})+$"), F.unhex(low)).otherwise(F.encode(F.concat(F.lit("="), low), "utf-8")).alias("h"),
        F.col("symbol_id").alias("item"),
        F.regexp_replace("file_path", r"^(\./)+", "").alias("path"),
        F.col("commit_ts").alias("ts"),
    )


def baskets(commits: DataFrame) -> DataFrame:
    """(run_id, h, ts, n_items, n_files, items, valid) of every commit, written to the shared folder; `items` is filled for valid ones only.

    Items and paths are made distinct with the key in the grouping, so one commit
    of any size is counted without being collected; arrays are built only within
    commits that the counts have found short enough.
    """
    t = touches(commits)
    items = materialize(t.groupBy("run_id", "h", "item").agg(F.max("ts").alias("ts")))  # read for the counts and for the arrays
    paths = t.where("path is not null").select("run_id", "h", "path").distinct()
    n_files = paths.groupBy("run_id", "h").agg(F.count("*").alias("n_files"))
    counts = items.groupBy("run_id", "h").agg(F.max("ts").alias("ts"), F.count("item").alias("n_items")).join(n_files, ["run_id", "h"], "left").na.fill(0, ["n_files"])
    valid = (F.col("n_items") >= MIN_ITEMS) & (F.col("n_items") <= MAX_ITEMS) & (F.col("n_files") <= MAX_FILES)
    counts = counts.withColumn("valid", valid)
    short = counts.where("valid").select("run_id", "h")
    arrays = items.where("item is not null").join(short, ["run_id", "h"], "left_semi").groupBy("run_id", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return materialize(counts.join(arrays, ["run_id", "h"], "left"))


def weighted(all_baskets: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(run_id, items, weight) of valid baskets; the weight halves with each half-life before the run's last commit."""
    last = all_baskets.groupBy("run_id").agg(F.max("ts").alias("last_ts"))
    age = F.greatest(F.col("last_ts") - F.col("ts"), F.lit(0)).cast("double")
    weight = F.least(F.greatest(F.pow(F.lit(2.0), -age / F.lit(half_life_days * 86400.0)), F.lit(MIN_WEIGHT)), F.lit(MAX_WEIGHT))
    return all_baskets.where("valid").join(last, "run_id").select("run_id", "items", F.coalesce(weight, F.lit(MAX_WEIGHT)).alias("weight"))


def _emit(stripes: dict) -> pa.RecordBatch:
    rows = []
    for (run, u), near in stripes.items():
        parts: dict[int, list[int]] = {}
        for v in near:
            parts.setdefault((v ^ (v >> 7)) % PARTS, []).append(v)
        rows += [(run, u, part, vs, [near[v][0] for v in vs], [near[v][1] for v in vs]) for part, vs in parts.items()]
    cols = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["run_id", "u", "part", "v", "c", "mass"])


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: dict = {}
    entries = 0
    for b in batches:
        for run, items, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for i, u in enumerate(items):
                near = stripes.get((run, u))
                if near is None:
                    near = stripes[(run, u)] = {}
                for v in items[i:]:
                    e = near.get(v)
                    if e is None:
                        near[v] = [1, w]
                        entries += 1
                    else:
                        e[0] += 1
                        e[1] += w
            if entries >= FLUSH_ENTRIES:
                yield _emit(stripes)
                stripes, entries = {}, 0
    if stripes:
        yield _emit(stripes)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes arrive sorted by (run, item, part): one is open at a time."""
    key: tuple | None = None
    near: dict[int, list] = {}
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        types = [pa.int64()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["run_id", "src_id", "dst_id", "together", "mass"])

    for b in batches:
        for run, u, part, vs, cs, ms in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (run, u, part) != key:
                if key is not None:
                    out.extend((key[0], key[1], v, e[0], e[1]) for v, e in near.items())
                    if len(out) >= 50_000:
                        yield batch()
                        out.clear()
                key, near = (run, u, part), {}
            for v, c, w in zip(vs, cs, ms, strict=True):
                e = near.get(v)
                if e is None:
                    near[v] = [c, w]
                else:
                    e[0] += c
                    e[1] += w
    if key is not None:
        out.extend((key[0], key[1], v, e[0], e[1]) for v, e in near.items())
    if out:
        yield batch()


def llr(together: Column, n_u: Column, n_v: Column, n: Column) -> Column:
    """Log-likelihood ratio G2 of a 2x2 table; 0 where the pair is as frequent as chance."""

    def term(k: Column, row: Column, col: Column) -> Column:
        k = k.cast("double")
        return F.when(k > 0, k * F.ln(k * n / (row.cast("double") * col))).otherwise(0.0)

    return 2 * (term(together, n_u, n_v) + term(n_u - together, n_u, n - n_v) + term(n_v - together, n - n_u, n_v) + term(n - n_u - n_v + together, n - n_u, n - n_v))


def counted_pairs(all_baskets: DataFrame, min_together: int = 1) -> DataFrame:
    """(run_id, src_id, dst_id, together, mass, n_src, mass_src, n_dst, mass_dst, n_valid), src_id < dst_id."""
    stripes = weighted(all_baskets).mapInArrow(_stripes, _STRIPE)
    merged = stripes.repartition("run_id", "u", "part").sortWithinPartitions("run_id", "u", "part").mapInArrow(_merge, _PAIR)
    cells = materialize(merged.where((F.col("src_id") == F.col("dst_id")) | (F.col("together") >= min_together)))  # read for pairs and twice for single items
    own = lambda x: cells.where("src_id = dst_id").select("run_id", F.col("src_id").alias(f"{x}_id"), F.col("together").alias(f"n_{x}"), F.col("mass").alias(f"mass_{x}"))
    runs = all_baskets.where("valid").groupBy("run_id").agg(F.count("*").alias("n_valid"))
    return cells.where("src_id < dst_id").join(own("src"), ["run_id", "src_id"]).join(own("dst"), ["run_id", "dst_id"]).join(runs, "run_id")


def significant_pairs(commits: DataFrame, min_together: int = 3, min_lift: float = 3.0, min_llr: float = 0.0) -> DataFrame:
    """Pairs touched together at least `min_together` times and `min_lift` times as often as chance, with their LLR."""
    all_baskets = baskets(commits)
    p = counted_pairs(all_baskets, min_together)
    p = p.where(F.col("together") * F.col("n_valid") >= F.lit(min_lift) * F.col("n_src") * F.col("n_dst"))
    p = p.withColumn("llr", llr(F.col("together"), F.col("n_src"), F.col("n_dst"), F.col("n_valid")))
    return p.where(F.col("llr") >= min_llr)


def restated_reports(commits: DataFrame, edges: DataFrame, min_support: int = 2, min_jaccard: float = 0.05) -> DataFrame:
    """(run_id, layer, edge_count, cochanged_edges, total_cochange_mass, total_coedit_pairs) of every run and layer.

    Edges count once, without self-loops, if both ends are touched in the run;
    `Contains` counts in both directions. Pairs are directed, as in the reports.
    """
    all_baskets = baskets(commits)
    p = counted_pairs(all_baskets, min_support)
    union = F.greatest(F.col("mass_src") + F.col("mass_dst") - F.col("mass"), F.lit(1e-6))
    p = p.where(F.col("mass") / union >= min_jaccard).select("run_id", F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "mass")
    totals = p.groupBy("run_id").agg((2 * F.count("*")).alias("total_coedit_pairs"))
    layer = F.create_map(*[F.lit(x) for x in ("Contains", "AST Parent", "Calls", "Call", "References", "Type Ref", "Imports", "Import")])
    e = edges.where("src is not null and dst is not null and src <> dst").select("repo_id", "src", "dst", layer[F.col("relation")].alias("layer")).where("layer is not null").distinct()
    back = e.where("layer = 'AST Parent'").select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "layer")
    e = e.unionByName(back).distinct()
    sample = commits.where("symbol_id is not null and run_id is not null").select("run_id", "repo_id", F.col("symbol_id").alias("item")).distinct()
    own = e.join(sample.select("run_id", "repo_id", F.col("item").alias("src")), ["repo_id", "src"]).join(sample.select("run_id", "repo_id", F.col("item").alias("dst")), ["run_id", "repo_id", "dst"])
    own = own.select("run_id", "layer", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    per = own.join(p, ["run_id", "a", "b"], "left").groupBy("run_id", "layer").agg(
        F.count("*").alias("edge_count"), F.count("mass").alias("cochanged_edges"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("total_cochange_mass")
    )
    layers = commits.sparkSession.createDataFrame([(x,) for x in ("AST Parent", "Call", "Type Ref", "Import")], "layer string")
    frame = all_baskets.select("run_id").distinct().crossJoin(F.broadcast(layers))  # four rows
    return (
        frame.join(per, ["run_id", "layer"], "left")
        .join(totals, "run_id", "left")
        .select(
            "run_id",
            "layer",
            *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("edge_count", "cochanged_edges")),
            F.round(F.coalesce("total_cochange_mass", F.lit(0.0)), 4).alias("total_cochange_mass"),
            F.coalesce("total_coedit_pairs", F.lit(0)).cast("bigint").alias("total_coedit_pairs"),
        )
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant_pairs(table(spark, sf_dir, "commit_symbols")).select("run_id", "src_id", "dst_id")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant_pairs(table(spark, sf_dir, "commit_symbols"), min_llr=SIGNIFICANT).select("run_id", "src_id", "dst_id", "together", "n_src", "n_dst", "n_valid", F.round("llr", 4).alias("llr"))


def p2_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restated_reports(table(spark, sf_dir, "commit_symbols"), table(spark, sf_dir, "typed_edges"))


_VALID_SQL = r"""
t AS (SELECT DISTINCT run_id, lower(commit_hash) AS h, symbol_id AS s, regexp_replace(file_path, '^(\./)+', '') AS p, commit_ts AS ts
      FROM commit_symbols WHERE run_id IS NOT NULL AND commit_hash IS NOT NULL),
commits AS (SELECT run_id, h, max(ts) AS ts, count(DISTINCT s) AS ns, count(DISTINCT p) AS nf FROM t GROUP BY 1, 2),
valid AS (SELECT run_id, h, ts FROM commits WHERE ns BETWEEN 2 AND 40 AND nf <= 25),
lasts AS (SELECT run_id, max(ts) AS last_ts FROM commits GROUP BY 1),
w AS (SELECT v.run_id, v.h, least(greatest(power(2.0, -greatest(l.last_ts - v.ts, 0) / 7776000.0), 0.001), 1.0) AS weight
      FROM valid v JOIN lasts l USING (run_id)),
u AS (SELECT DISTINCT t.run_id, t.h, t.s, w.weight FROM t JOIN w ON t.run_id = w.run_id AND t.h = w.h WHERE t.s IS NOT NULL),
one AS (SELECT run_id, s, count(*) AS n, sum(weight) AS mass FROM u GROUP BY 1, 2),
runs AS (SELECT run_id, count(*) AS n_valid FROM valid GROUP BY 1),
pr AS (SELECT a.run_id, a.s AS src_id, b.s AS dst_id, count(*) AS c, sum(a.weight) AS mass
       FROM u a JOIN u b ON a.run_id = b.run_id AND a.h = b.h AND a.s < b.s GROUP BY 1, 2, 3),
st AS (SELECT pr.*, x.n AS n_u, y.n AS n_v, x.mass AS m_u, y.mass AS m_v, r.n_valid FROM pr
       JOIN one x ON x.run_id = pr.run_id AND x.s = pr.src_id JOIN one y ON y.run_id = pr.run_id AND y.s = pr.dst_id
       JOIN runs r ON r.run_id = pr.run_id)"""

_LLR_SQL = " + ".join(
    f"CASE WHEN {k} > 0 THEN CAST({k} AS DOUBLE) * ln(CAST({k} AS DOUBLE) * n_valid / (CAST({r} AS DOUBLE) * {c})) ELSE 0.0 END"
    for k, r, c in (("c", "n_u", "n_v"), ("(n_u - c)", "n_u", "(n_valid - n_v)"), ("(n_v - c)", "(n_valid - n_u)", "n_v"), ("(n_valid - n_u - n_v + c)", "(n_valid - n_u)", "(n_valid - n_v)"))
)

QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p2_reports": p2_reports}
ORACLES = {
    "p2_found": f"WITH {_VALID_SQL} SELECT run_id, src_id, dst_id FROM st WHERE c >= 3 AND c * n_valid >= 3 * n_u * n_v",
    "p2_pairs": f"""WITH {_VALID_SQL} SELECT run_id, src_id, dst_id, c AS together, n_u AS n_src, n_v AS n_dst, n_valid,
        round(2 * ({_LLR_SQL}), 4) AS llr FROM st WHERE c >= 3 AND c * n_valid >= 3 * n_u * n_v AND 2 * ({_LLR_SQL}) >= {SIGNIFICANT}""",
    "p2_reports": f"""WITH {_VALID_SQL},
good AS (SELECT run_id, src_id AS a, dst_id AS b, mass FROM st WHERE c >= 2 AND mass / greatest(m_u + m_v - mass, 1e-6) >= 0.05),
totals AS (SELECT run_id, 2 * count(*) AS total_coedit_pairs FROM good GROUP BY 1),
e0 AS (SELECT DISTINCT repo_id, src, dst, CASE relation WHEN 'Contains' THEN 'AST Parent' WHEN 'Calls' THEN 'Call'
       WHEN 'References' THEN 'Type Ref' WHEN 'Imports' THEN 'Import' END AS layer FROM typed_edges WHERE src <> dst),
e AS (SELECT * FROM e0 WHERE layer IS NOT NULL UNION SELECT repo_id, dst, src, layer FROM e0 WHERE layer = 'AST Parent'),
sample AS (SELECT DISTINCT run_id, repo_id, symbol_id AS item FROM commit_symbols WHERE symbol_id IS NOT NULL AND run_id IS NOT NULL),
own AS (SELECT x.run_id, e.layer, least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b FROM e
        JOIN sample x ON x.repo_id = e.repo_id AND x.item = e.src
        JOIN sample y ON y.repo_id = e.repo_id AND y.item = e.dst AND y.run_id = x.run_id),
per AS (SELECT own.run_id, own.layer, count(*) AS edge_count, count(good.mass) AS cochanged_edges, coalesce(sum(good.mass), 0) AS m
        FROM own LEFT JOIN good ON good.run_id = own.run_id AND good.a = own.a AND good.b = own.b GROUP BY 1, 2),
frame AS (SELECT r.run_id, l.layer FROM (SELECT DISTINCT run_id FROM commits) r, (VALUES ('AST Parent'), ('Call'), ('Type Ref'), ('Import')) l(layer))
SELECT f.run_id, f.layer, CAST(coalesce(edge_count, 0) AS BIGINT) AS edge_count, CAST(coalesce(cochanged_edges, 0) AS BIGINT) AS cochanged_edges,
       round(coalesce(m, 0.0), 4) AS total_cochange_mass, CAST(coalesce(total_coedit_pairs, 0) AS BIGINT) AS total_coedit_pairs
FROM frame f LEFT JOIN per USING (run_id, layer) LEFT JOIN totals USING (run_id)""",
}
