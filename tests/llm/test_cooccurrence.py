"""Stripes against brute-force counts, with bulk commits, repeats, nulls and letter case."""

import itertools
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import cooccurrence as C

SCHEMA = "run_id long, repo_id long, commit_hash string, commit_ts long, file_path string, symbol_id long, author string, n_src string"


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for run in (1, 2):
        for c in range(60):
            h = f"ab{run}{c}"
            base = rng.choice([(1, 2, 3), (4, 5), (6,), (7, 8, 9, 10)])
            for s in {*base, rng.randrange(20)}:
                out.append((run, 1, h.upper() if rng.random() < 0.5 else h, 1000 + c, rng.choice(["./a/f", "a/f"]), s, None, "x"))
        out += [(run, 1, "bulk", 5, "f", s, None, "x") for s in range(100, 150)]
        out += [(run, 1, "wide", 5, f"f{k}", 1 + k % 2, None, "x") for k in range(30)]
        out += [(run, 1, "empty", 5, "f", None, None, "x"), (None, 1, "z", 5, "f", 1, None, "x"), (run, 1, None, 5, "f", 1, None, "x")]
    return out + out[:40]


def brute(data):
    symbols, files = defaultdict(set), defaultdict(set)
    for run, _, h, _, path, s, *_ in data:
        if run is None or h is None:
            continue
        k = (run, h.lower())
        files[k].add(path.removeprefix("./"))
        if s is not None:
            symbols[k].add(s)
        else:
            symbols[k] |= set()
    valid = {k: s for k, s in symbols.items() if 2 <= len(s) <= 40 and len(files[k]) <= 25}
    n, one, two = Counter(), Counter(), Counter()
    for (run, _), s in valid.items():
        n[run] += 1
        for x in s:
            one[run, x] += 1
        for a, b in itertools.combinations(sorted(s), 2):
            two[run, a, b] += 1
    return {k: c for k, c in two.items() if c >= 3 and c * n[k[0]] >= 3 * one[k[0], k[1]] * one[k[0], k[2]]}, n, one


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_ENTRIES", 7)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want, n, one = brute(data)
    got = {(r["run_id"], r["src_id"], r["dst_id"]): r for r in C.significant_pairs(df).collect()}
    assert {k: r["together"] for k, r in got.items()} == want and want
    for (run, a, b), r in got.items():
        assert (r["n_src"], r["n_dst"], r["n_valid"]) == (one[run, a], one[run, b], n[run]) and r["llr"] > 0


def test_a_hot_item_is_split_and_the_level_of_significance_holds(spark):
    data = [(1, 1, f"{c:040x}", 1000 + c, "f", s, None, "x") for c in range(300) for s in (7, 100 + c % 97, 300 + c % 89, *((500, 501) if c % 10 == 0 else ()))]
    df = spark.createDataFrame(data, SCHEMA)
    stripes = C.weighted(C.baskets(df)).mapInArrow(C._stripes, C._STRIPE)
    parts = stripes.where("u = 7").select("part").distinct().count()
    assert parts == C.PARTS
    p = {(r["src_id"], r["dst_id"]): r for r in C.counted_pairs(C.baskets(df)).collect()}
    assert p[7, 100]["n_src"] == 300 and p[7, 100]["together"] == p[7, 100]["n_dst"]
    every = C.significant_pairs(df, 1, 0.0).select("llr").collect()
    kept = C.significant_pairs(df, 1, 0.0, C.SIGNIFICANT).count()
    assert 0 < kept < len(every) and kept == sum(r["llr"] >= C.SIGNIFICANT for r in every)


def test_llr_is_zero_at_chance(spark):
    df = spark.createDataFrame([(25, 50, 50, 100), (50, 50, 50, 100)], "c long, u long, v long, n long")
    a, b = (r[0] for r in df.select(C.llr(F.col("c"), F.col("u"), F.col("v"), F.col("n"))).collect())
    assert abs(a) < 1e-9 and math.isclose(b, 2 * 100 * math.log(2))


def test_empty_and_reports(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert C.significant_pairs(df.limit(0)).count() == 0
    edges = spark.createDataFrame([(1, 1, 2, "Calls", 1.0), (1, 1, 2, "Calls", 1.0), (1, 1, 1, "Calls", 1.0), (1, 4, 5, "Contains", None), (1, 1, 999, "Calls", 1.0)], "repo_id long, src long, dst long, relation string, weight double")
    got = {(r["run_id"], r["layer"]): r for r in C.restated_reports(df, edges).collect()}
    assert len(got) == 8
    assert got[1, "Call"]["edge_count"] == 1 and got[1, "Call"]["cochanged_edges"] == 1
    assert got[1, "AST Parent"]["edge_count"] == 2 and got[1, "Import"]["edge_count"] == 0
    assert got[1, "Call"]["total_coedit_pairs"] % 2 == 0
