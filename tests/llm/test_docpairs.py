"""Documentation: attachment by the as-of join and the judgement of substance."""

import pytest

from millrace.llm import docpairs as D

FILES = {
    "a.rs": "/// Rounds half to even.\n#[inline]\n#[cfg(\n  x\n)]\npub fn good() {}\n\n/// Lost to a blank row.\n\npub fn blank() {}\n/// Taken by the statement.\nlet x = 1;\nfn stolen() {}\nfn one() {} // trailing\nfn two() {}\n/** Block\n\n * comment that says more. */\nfn block() {}\n",
    "b.py": 'def good(a,\n         b) -> dict[str, int]:\n    """Says something new."""\n\n# A comment above.\n@cached\ndef above():\n    pass\n\ndef late():\n    x = 1\n    """No docstring."""\n\nclass A:\n    def method(self):\n        \'\'\'Mutates in place!\'\'\'\n\ndef fmt():\n    f"""Not {1} one."""\n',
    "c.ts": "/**\n * @param x\n */\nexport function tags(x: number) {\n}\n\nexport class K {\n  // Not thread safe.\n  run(a: number): Promise<Map<string, number>> {\n  }\n}\n// Lower is better.\nexport const arrow = (x: number) => x;\n",
    "d.go": "package a\n\n// Do does it twice as fast.\nfunc Do() {\n}\n\n// Run\nfunc Run() {\n}\n",
}
WANT = {("a.rs", "good"), ("a.rs", "block"), ("b.py", "good"), ("b.py", "above"), ("b.py", "method"), ("c.ts", "run"), ("c.ts", "arrow"), ("d.go", "Do")}

YES = ["Not thread safe.", "Returns -1 when nothing fits.", "Nur für alte invoice nötig.", "TODO: tidy up.\nOlder clients send a late marker.", "@param x the lattice to use", "Panics on empty input."]
NO = ["", " ", "TODO", "TODO: document", "todo(docs)", "FIXME write docs", "No description.", "Description here.", "----------", "***", "@author dev042", "Author: dev051", "@param x\n@returns", "@since 9.1", "eslint-disable-next-line no-shadow", "pylint: disable=too-many-locals",
      "rustfmt::skip", "nolint:gocyclo", "let token = old_token(yarrow)?;", "const token = oldToken(juniper);", "This function load thread journal.", "load_thread_journal", "Loads the thread journal.", "LOAD THREAD JOURNAL", "n/a", "..."]


@pytest.mark.parametrize("text", YES)
def test_substance(text):
    assert D.substance("load_thread_journal", "\n".join(f"/// {x}" for x in text.split("\n")))
    assert D.substance("load_thread_journal", f'"""{text}"""')


@pytest.mark.parametrize("text", NO)
def test_no_substance(text):
    assert not D.substance("load_thread_journal", "\n".join(f"// {x}" for x in text.split("\n")))
    assert not D.substance("load_thread_journal", f'"""{text}"""')


@pytest.mark.parametrize("crlf", [False, True])
def test_operator(spark, crlf):
    ids = {p: i for i, p in enumerate(FILES, start=1)}
    change = (lambda t: "\ufeff" + t.replace("\n", "\r\n")) if crlf else (lambda t: t)
    files = [(i, 1, p, change(FILES[p]), 5) for p, i in ids.items()] + [(1, 1, "a.rs", change(FILES["a.rs"]), 6), (9, 1, "n.rs", None, 1), (8, 1, "e.py", "", 1), (7, 1, None, "x", 1), (None, 1, "z.py", "def z(): pass", 1)]
    f = spark.createDataFrame(files, "file_id long, repo_id long, file_path string, content string, kind long")
    names = [(p, n) for p in FILES for n in ("good", "blank", "stolen", "one", "two", "block", "above", "late", "method", "fmt", "tags", "run", "arrow", "Do", "Run", "missing")]
    apis = [(k, ids[p], n, "Function", f"fn {n}()", None) for k, (p, n) in enumerate(names)]
    apis += [apis[0], (1000, ids["a.rs"], "good", "Struct", "x", None), (1001, None, "good", "Function", "x", None), (1002, 1, None, "Function", "x", None)]
    a = spark.createDataFrame(apis, "symbol_id long, file_id long, name string, kind string, signature string, comment string")
    got = [r["symbol_id"] for r in D.documented(f, a).collect()]
    assert sorted(names[i] for i in got) == sorted(WANT) and len(got) == len(set(got))
    assert D.documented(f.limit(0), a).count() == 0 and D.documented(f, a.limit(0)).count() == 0


def test_same_name_twice_goes_by_the_signature(spark):
    text = "impl A {\n    /// Says a lot here.\n    fn go(&self, a: u8) {}\n}\nimpl B {\n    fn go(&self, b: u16) {}\n}\n"
    f = spark.createDataFrame([(1, "a.rs", text)], "file_id long, file_path string, content string")
    a = spark.createDataFrame([(1, 1, "go", "Method", "fn go(&self,  a: u8)"), (2, 1, "go", "Method", "fn go(&self, b: u16)")], "symbol_id long, file_id long, name string, kind string, signature string")
    assert [r["symbol_id"] for r in D.documented(f, a).collect()] == [1]


def test_long_file(spark):
    text = "# note\n" * 20000 + "def f():\n    'Says much more.'\n"
    f = spark.createDataFrame([(1, "a.py", text)], "file_id long, file_path string, content string")
    a = spark.createDataFrame([(1, 1, "f", "Function", "def f()")], "symbol_id long, file_id long, name string, kind string, signature string")
    assert D.documented(f, a).count() == 1


def test_long_return_types_and_long_rows_after_a_docstring():
    ts = "class K {\n  // Not thread safe.\n  run(a: number): " + "Map<string, " * 80 + "number" + ">" * 80 + " {\n  }\n}\n"
    assert "run" in {e[3] for e in D.spans_of("a.ts", ts) if e[0] == "function"}
    py = 'def f():\n    """Says something new."""' + " " * 400 + "# and a remark\n    return 1\n"
    assert [e[0] for e in D.spans_of("a.py", py)].count("docstring") == 1
