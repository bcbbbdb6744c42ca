"""Scalar functions, retrieval, resolution, diffs, sources and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import history as H
from millrace.operators import resolve as Rs
from millrace.operators import retrieval as R
from millrace.sources import files as Fs
from millrace.sources import parse as P
from millrace.streaming import watch as W

WORDS = {
    "ContextSelector": ["context", "selector"], "HTTPClientHandler": ["http", "client", "handler"], "parseASTTree": ["parse", "ast", "tree"], "OAuth2Callback": ["oauth", "2", "callback"],
    "sha256_digest": ["sha", "256", "digest"], "estimate_tokens_bpe-fast": ["estimate", "tokens", "bpe", "fast"], "": [], "  ": [],
}


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokenizer(spark):
    assert column(spark, list(WORDS), T.tokenize_ident) == list(WORDS.values())


def test_tokens_and_grams(spark):
    assert column(spark, ["", " \t\n", "a::b", "fooBar2", "x" * 40], T.token_estimate) == [0, 0, 3, 3, 10]
    assert column(spark, ["ab"], T.char_ngrams) == [["<ab", "<ab>", "ab>"]]
    assert R.grams_of("ab") == {"<ab", "<ab>", "ab>"}


def test_paths_and_tasks(spark):
    assert column(spark, ["crates/motor/x.rs", "src/auth/y.rs", "docs/z.md", "main.go", ""], T.subsystem) == ["crates-motor", "auth", "docs", "core", "root"]
    assert column(spark, ["fix the crash", "add tests", "rename it", "new thing", "readme", "where is it", "hello"], T.task_kind) == ["bugfix", "test_creation", "refactor", "feature", "documentation", "exploration", "general"]
    df = spark.createDataFrame([("a/b.rs", "a/b.rs"), ("a/b.rs", "a/c.rs"), ("a/b/c.rs", "a/d/e.rs"), ("x.rs", "y.rs")], "a string, b string")
    assert [r[0] for r in df.select(T.path_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 4, 1]
    assert column(spark, ["main", "-rf", "a;b", "v1.2~3^{x}"], T.valid_revision) == [True, False, False, True]


def nodes(spark):
    rows = [(1, "parse_config", "src/config.rs", "fn parse_config()", None), (2, "other_thing", "src/other.rs", "fn other_thing(config: Config) -> Config " + "x " * 40, "parse config " * 30), (3, "noise", "src/noise.rs", "fn noise()", None)]
    return spark.createDataFrame(rows, "id long, name string, file_path string, signature string, docstring string")


def test_bm25_prefers_the_concise(spark):
    q = R.query_table(spark, [(1, "parse config"), (2, "zzzz qqqq")])
    s = {(r["query"], r["id"]): r["score"] for r in R.bm25(R.documents(nodes(spark)), q).collect()}
    assert s[1, 1] > s[1, 2] > 0 and (1, 3) not in s and not any(k[0] == 2 for k in s)
    best = R.search(nodes(spark), q, 3)
    first = {r["query"]: r["id"] for r in best.where("rank = 1").collect()}
    assert first[1] == 1


def test_embedding():
    import numpy as np

    a, b, c = (R.embed_text(t.split(), R.grams_of(t)) for t in ("parse the config file", "parsing config files", "zebra quilt onyx"))
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > 0.4 > a @ c
    assert not R.embed_text([], R.grams_of("  ")).any()
    assert R.fnv1a(b"") == 0xCBF29CE484222325 and R.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_cosine_topk(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = [(r["query"], r["id"]) for r in R.cosine_topk(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert got == [(0, 1), (0, 2)]


def test_resolution_priorities(spark):
    s = spark.createDataFrame([(1, 1, "a/x.go", "f"), (2, 1, "a/y.go", "g"), (3, 1, "b/z.rs", "h"), (4, 1, "c/w.rs", "k"), (5, 1, "d/v.rs", "k"), (6, 2, "a/x.go", "g")], "id long, repo_id long, file_path string, name string")
    r = spark.createDataFrame([(1, "a/x.go", "f"), (1, "a/x.go", "g"), (1, "a/x.go", "h"), (1, "a/x.go", "k"), (1, "a/x.go", "none")], "repo_id long, file_path string, ident string")
    b = spark.createDataFrame([(1, "a/x.go", "h", 5)], "repo_id long, file_path string, local_name string, id long")
    got = {x["ident"]: (x["id"], x["confidence"], x["priority"]) for x in Rs.resolve(r, s).collect()}
    assert got == {"f": (1, 1.0, 3), "g": (2, 1.0, 4), "h": (3, 0.3, 6), "k": (4, 0.3, 8)}
    assert {x["ident"]: x["id"] for x in Rs.resolve(r, s, bindings=b).collect()}["h"] == 5
    i = spark.createDataFrame([(1, "a/x.go", "d/v.rs")], "repo_id long, file_path string, target_path string")
    assert {x["ident"]: (x["id"], x["confidence"]) for x in Rs.resolve(r, s, imported=i).collect()}["k"] == (5, 0.95)
    assert {x["ident"]: x["priority"] for x in Rs.resolve(r, s, wildcards=i).collect()}["k"] == 5


def test_module_paths(spark):
    i = spark.createDataFrame([(1, "src/a/b.ts", "../c/d"), (1, "pkg/m.py", ".util"), (1, "src/x.rs", "crate::y")], "repo_id long, file_path string, module_specifier string")
    f = spark.createDataFrame([(1, "src/c/d.ts"), (1, "pkg/util.py"), (1, "src/y.rs")], "repo_id long, file_path string")
    assert {r["target_path"] for r in Rs.resolve_modules(i, f).collect()} == {"src/c/d.ts", "pkg/util.py", "src/y.rs"}


LOG = "COMMIT_DELIMITER abc 1000\ndiff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -1,1 +1,2 @@ fn\n-old\n+new\n+more\n@@ -20 +21 @@\n-q\n+r\nCOMMIT_DELIMITER def 2000\n--- a/y.rs\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"


def test_log_and_diff(spark):
    log = spark.createDataFrame([("k", LOG), ("e", "")], "key string, log string")
    commits = H.parse_log(log)
    assert sorted((r["hash"], r["ts"]) for r in commits.collect()) == [("abc", 1000), ("def", 2000)]
    rows = H.parse_diff(commits.select(F.col("hash").alias("key"), "diff"))
    assert sorted((r["key"], r["path"], r["row"]) for r in rows.collect()) == [("abc", "x.rs", 0), ("abc", "x.rs", 1), ("abc", "x.rs", 20)]
    s = spark.createDataFrame([(1, "./x.rs", 0, 3), (2, "x.rs", 4, 9)], "id long, file_path string, start_row long, end_row long")
    assert [(r["id"], r["hits"], r["weight"]) for r in H.changed_symbols(rows, s).collect()] == [(1, 2, 1.0)]
    outside = spark.createDataFrame([("k", "x.rs", 50)], "key string, path string, row long")
    assert {r["id"] for r in H.changed_symbols(outside, s).collect()} == {1, 2}


def test_couplings(spark):
    rows = [(1, c, 100, i) for c in range(3) for i in (1, 2)] + [(1, 9, 100, i) for i in range(50)] + [(1, 8, 100, 3)]
    got = {(r["src"], r["dst"]): r for r in H.couplings(spark.createDataFrame(rows, "grp long, commit long, ts long, item long")).collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2]["raw_count"] == 3 and got[1, 2]["confidence"] > 0.9


def test_megacommits_by_files_and_items(spark):
    rows = [(1, c, 100, i, "f") for c in range(3) for i in (1, 2)] + [(1, 9, 900, i, "f") for i in range(50)] + [(1, 7, 100, 1 + k % 2, f"f{k}") for k in range(26)] + [(1, 6, 100, 1 + k % 2, f"f{k}") for k in range(25)] + [(1, 5, 100, None, f"g{k}") for k in range(26)] + [(1, 5, 100, 1, "f"), (1, 5, 100, 2, "f")]
    df = spark.createDataFrame(rows, "grp long, commit long, ts long, item long, path string")
    size = {r["commit"]: (r["megacommit"], r["valid"]) for r in H.commit_sizes(df).collect()}
    assert size == {0: (False, True), 1: (False, True), 2: (False, True), 9: (True, False), 7: (True, False), 6: (False, True), 5: (True, False)}
    c = H.couplings(df)
    got = {(r["src"], r["dst"]): r for r in c.collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2]["raw_count"] == 4
    assert {r["weight"] for r in H.directed_edges(c).collect()} == {1.0} and H.directed_edges(c, 1.1).count() == 0
    asked = spark.createDataFrame([(1, 1, 2), (1, 1, 9)], "grp long, src long, dst long")
    assert {(r["dst"], r["confidence"]) for r in H.confidence_of(c, asked).collect()} == {(2, 1.0), (9, 0.0)}
    assert [r["rank"] for r in H.couplings_of(c, 1).orderBy("src").collect()] == [1, 1]


def test_changed_symbols_of_two_checkouts_with_one_path(spark):
    rows = spark.createDataFrame([("r1", "src/x.rs", 50), ("r2", "src/x.rs", 1), ("r2", "lib/y.rs", 3)], "key string, path string, row long")
    s = spark.createDataFrame([("r1", 1, "src/x.rs", 0, 3), ("r2", 2, "./src/x.rs", 0, 3), ("r2", 3, "src/x.rs", 5, 9), ("r2", 4, "repo/lib/y.rs", 0, 9), ("r2", 5, "y.rs", 0, 9), ("r2", 6, "ay.rs", 0, 9)], "key string, id long, file_path string, start_row long, end_row long")
    assert {(r["key"], r["id"], r["hits"]) for r in H.changed_symbols(rows, s).collect()} == {("r1", 1, 1), ("r2", 2, 1), ("r2", 4, 1), ("r2", 5, 1)}


def test_parser():
    py = P.symbols_of("a.py", "class A:\n    def f(self):\n        \"doc\"\n        g()\n\ndef h(): pass\n")
    assert [(s["name"], s["kind"], s["container_name"]) for s in py] == [("A", "Struct", None), ("f", "Method", "A"), ("h", "Function", None)]
    assert py[1]["docstring"] == "doc" and py[1]["calls"] == ["g"]
    rs = P.symbols_of("a.rs", "impl T for S {\n    /// d\n    pub fn f(&self) -> u8 { g(\"{\") }\n}\nstruct S { a: u8 }\nfn g() {}\n")
    assert [(s["name"], s["kind"], s["container_name"], s["trait_name"]) for s in rs] == [("f", "Method", "S", "T"), ("S", "Struct", None, None), ("g", "Function", None, None)]
    go = P.symbols_of("a.go", "package a\n\nfunc (s *S) F(a int) error {\n\treturn g()\n}\n\ntype S struct {\n}\n")
    assert [(s["name"], s["kind"], s["container_name"]) for s in go] == [("F", "Method", "S"), ("S", "Struct", None)]
    ts = P.symbols_of("a.ts", "export class A {\n  m(x: number): void {\n    if (x) { f(x); }\n  }\n}\nexport const k = (a: number) => a;\ninterface I {}\n")
    assert [(s["name"], s["kind"]) for s in ts] == [("A", "Struct"), ("m", "Method"), ("k", "Function"), ("I", "Trait")]
    assert P.symbols_of("a.py", "def (") == [] and P.symbols_of("a.md", "x") == []
    assert P.imports_of("a.rs", "use a::{b, c::*, d as e};\n") == [("a", "b", "b", False), ("a::c", None, "*", True), ("a", "d", "e", False)]
    assert P.imports_of("a.py", "import a.b\nfrom .c import d as e\n") == [("a.b", None, "a.b", False), ("a.b", None, "a", False), (".c", "d", "e", False)]
    assert P.imports_of("a.ts", "import x, { a as b } from './m';\nimport * as n from 'q';") == [("./m", "a", "b", False), ("./m", "default", "x", False), ("q", None, "n", True)]
    assert P.imports_of("a.go", "import (\n\tz \"a/b\"\n\t\"c/d\"\n)\n") == [("a/b", None, "z", False), ("c/d", None, "d", False)]


def test_scan_and_snapshot(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in (("src/a.rs", "fn a() {}"), ("src/b.py", "x = 1"), ("node_modules/c.js", "1"), ("src/skip.go", "package a"), (".hidden.py", "1"), ("big.ts", "1" * 300)):
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("skip.go\n# c\n")
    f = Fs.scan(spark, str(tmp_path), max_bytes=200)
    assert sorted(r["file_path"] for r in f.collect()) == ["src/a.rs", "src/b.py"]
    snap = str(tmp_path / "snap")
    Fs.write_snapshot(f.drop("content"), snap)
    (tmp_path / "src/a.rs").write_text("fn a() { }")
    again = Fs.scan(spark, str(tmp_path), max_bytes=200)
    assert [r["file_path"] for r in Fs.changed_since(again, Fs.read_snapshot(spark, snap)).collect()] == ["src/a.rs"]
    Fs.clean_snapshots(snap)
    assert Fs.read_snapshot(spark, snap) is None
    with pytest.raises(PermissionError):
        Fs.confined(str(tmp_path), "../x")


def test_rendering(spark):
    s = spark.createDataFrame([(1, 1, "a.rs", "fn a()", "doc"), (1, 2, "b.rs", "fn b()", None)], "query long, step long, file_path string, signature string, docstring string")
    assert Fs.markdown(s).first()["text"] == "## a.rs\n\n/// doc\nfn a()\n\n## b.rs\n\nfn b()"


def test_stream_upserts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 1, "h1"), ("a", 2, "h1"), ("b", 1, "h2"), ("a", 3, "h3"), ("b", 2, None)]
    spark.createDataFrame(rows, "path string, seq long, hash string").coalesce(1).write.parquet(src)
    got = W.drain(W.upserts(W.watch(spark, src, "path string, seq long, hash string"))).collect()
    assert sorted((r["path"], r["event"], r["version"]) for r in got) == [("a", "patched", 1), ("a", "patched", 2), ("b", "patched", 1), ("b", "removed", 2)]


def test_stream_debounce(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("u", "x", t), ("u", "x", t + dt.timedelta(seconds=1)), ("u", "x", t + dt.timedelta(hours=3))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, i string, ts timestamp").coalesce(1).write.parquet(src)
    got = W.drain(W.debounced(W.watch(spark, src, "k string, i string, ts timestamp"), "k", "i", "ts", "1 minute", "1 minute")).collect()
    assert [(r["k"], r["i"], r["n"]) for r in got] == [("u", "x", 2)]


def test_stream_sessions_keep_rows_of_any_file(spark, tmp_path):
    import datetime as dt
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from millrace.plans.source_queries import stream_sessions

    os.makedirs(tmp_path / "events.parquet")
    for i in range(303):  # the last files hold the earliest rows
        path = tmp_path / "events.parquet" / f"{i:03}.parquet"
        pq.write_table(pa.table({"user_id": [1], "event_type": ["x"], "ts": pa.array([dt.datetime(2024, 3, 1) - dt.timedelta(hours=12 * i)], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    assert stream_sessions(spark, str(tmp_path)).count() == 302  # all but the open one


def test_slicing():
    from millrace.sources.slicing import sliced

    short = "fn a() {\n  x;\n}"
    assert sliced(short) == short
    body = "fn a() -> u8 {\n" + "    let x = 1;\n" * 6 + "    if x > 1 {\n        go(x);\n    }\n" + "    let y = 2;\n" * 3 + "    y\n}"
    cut = sliced(body).split("\n")
    assert cut[0] == "fn a() -> u8 {" and "    ... [6 lines elided] ..." in cut and "    y" in cut and "        go(x);" in cut and "    let y = 2;" not in cut
    py = 'def f():\n    """Doc\n    more."""\n' + "    a = 1\n" * 8 + "    return a"
    assert "    more." in sliced(py, True) and "    a = 1" not in sliced(py, True).split("\n")


def test_sql_functions_equal_the_column_functions(spark):
    from millrace.functions import registry

    names = registry.register(spark)
    rows = [("fooBar(x) -> y::z 12a", "./a\\b.rs", 86400 * 90), ("", "x/test_a.py", 0), (None, None, None), ("it's \"q\" \\d", "a.test.ts", -5)]
    df = spark.createDataFrame(rows, "t string, p string, n long")
    df.createOrReplaceTempView("sql_function_rows")
    args = {"BIGINT": "n"}
    for name in names:
        parameters, result, make = registry.FUNCTIONS[name]
        columns = [args.get(kind, "p" if x in ("p", "path") else "t") for x, kind in parameters.items()]
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(columns)}) FROM sql_function_rows").collect()]
        want = [r[0] for r in df.select(make(*[F.col(c) for c in columns]).cast(result)).collect()]
        assert got == want, name
