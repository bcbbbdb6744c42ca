"""Generated, minified, vendored and data-only files against hand-written look-alikes."""

import random

import pytest

from millrace.llm import handwritten as H

GETTERS = "\n".join(f"export function getRow{i}(m) {{\n  return m.slots[{i}];\n}}\n" for i in range(30))
rng = random.Random(1)


def hand(seed):
    """Hand-written code of its own shape."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(8))

    def expression(depth=0):
        if depth > 2 or r.random() < 0.3:
            return r.choice([name(), str(r.randrange(99)), "this", f"{name()}.{name()}", f"{name()}[{r.randrange(9)}]"])
        return r.choice([f"({expression(depth + 1)} {r.choice('+-*/%&|^')} {expression(depth + 1)})", f"{name()}({expression(depth + 1)}, {expression(depth + 1)})", f"!{expression(depth + 1)}", f"[{expression(depth + 1)}, {expression(depth + 1)}]", f"{{ {name()}: {expression(depth + 1)} }}"])

    def statement():
        return r.choice([f"  {name()} = {expression()};", f"  if ({expression()}) {{ return {expression()}; }}", f"  for (const {name()} of {expression()}) {{ {name()}({expression()}); }}", f"  const {name()} = {expression()};", f"  while ({expression()}) {name()}--;"])

    return "\n".join(f"function {name()}({name()}) {{\n" + "\n".join(statement() for _ in range(r.randrange(3, 9))) + "\n}\n" for _ in range(6))


HAND = "@HAND@"
MIN = "".join(f"function a{i}(e,t){{var n=e.length;for(;n--;)t.push(e[n]<<{i});return t}}" for i in range(30))
TABLE = "export const TABLE = [\n" + "\n".join("  " + ", ".join(str(rng.randrange(256)) for _ in range(16)) + "," for _ in range(40)) + "\n];\n"

POSITIVE = {
    "src/a.js": "// Code generated by tool. DO NOT EDIT.\n\n" + HAND, "src/b.js": "/* generated with tool 1.2.3 - do not modify by hand\n */\n" + HAND, "src/c.js": "// Diese Datei wurde automatisch erzeugt (tool). Nicht bearbeiten.\n" + HAND,
    "src/d.js": "// Fichier produit par tool, ne pas modifier\n" + HAND, "src/e.js": "// tool 3.4.5\n// source: schema/x.gql\n\n" + HAND, "src/generated/x/f.js": HAND, "src/g_pb2.py": "def get_a(m):\n    return m._f[0]\n",
    "public/h.js": MIN, "src/i.min.js": MIN + "\n", "node_modules/x/j.js": HAND, "src/Vendor/k.js": HAND, "src/l.js": "// Copied verbatim from the XyzAbc release 1.2.3; upstream fixes go there.\n" + HAND, "src/m.ts": TABLE,
    "src/n.go": 'package data\n\nvar Payload = "' + "aB3/" * 400 + '"\n',
}
NEGATIVE = {
    "src/o.js": HAND, "src/p.js": "// This module replaces the generated client we used to ship.\n" + HAND, "src/q.js": "// Generated files live in the sibling folder, not here.\n" + HAND, "src/r.js": "// Do not edit without asking the quota group first.\n" + HAND,
    "src/s.js": "// Ported by hand from the old vendor branch, see the notes.\n" + HAND, "src/t.js": "// Copyright the X team. Internal use under the house licence.\n" + HAND, "app/vendor_portal/u.js": HAND, "lib/generator/v.js": HAND, "src/external_orders/w.js": HAND,
    "src/x.js": 'const header = "// Code generated by tool. DO NOT EDIT.";\n' + HAND, "src/y.js": 'const text = "' + "word " * 150 + '";\n' + HAND, "src/z.js": "const t = [1, 2, 3, 4, 5, 6, 7, 8];\n" + HAND, "src/empty.js": "", "src/comment.js": "// only this\n",
}


def build():
    files = [(i, i % 5, p, t.replace(HAND, hand(i))) for i, (p, t) in enumerate({**POSITIVE, **NEGATIVE}.items())]
    family = [(100 + i, 7 + i % 3, f"src/fam{i}.ts", ("// Machine written. Run `tool build`.\n" if i < 3 else "") + GETTERS.replace("Row", f"Row{i}x")) for i in range(6)]
    return files, family


def test_operator(spark):
    files, family = build()
    extra = [(200, 1, "x.toml", GETTERS), (201, 1, "n.js", None), (202, None, "o.js", hand(999)), files[0], files[0]]
    df = spark.createDataFrame([(*r, 1) for r in files + family + extra], "file_id long, repo_id long, file_path string, content string, family int")
    got = {r["file_id"]: r["reason"] for r in H.classified(df).collect()}
    paths = {r[0]: r[2] for r in files}
    for i, p in paths.items():
        assert (got[i] is not None) == (p in POSITIVE), (p, got[i])
    assert all(got[r[0]] == "generated" for r in family)  # the silent members follow the declared ones
    assert 200 not in got and 201 not in got and got[202] is None
    assert H.classified(df.limit(0)).count() == 0


def test_families_pass_on_what_they_show(spark):
    import re

    names = sorted(set(re.findall(r"\b[a-h]{8}\b", hand(50))))
    changed = re.sub(rf"\b{names[0]}\b", "renamed", hand(50))
    other = lambda text, n: re.sub(r"\b[a-h]{8}\b", lambda m: f"{m.group()[::-1]}{n}", re.sub(r"\b\d+\b", lambda m: f"{m.group()}{n}", text))
    files = [
        (1, 1, "src/a.js", "// first header 1.2.0\n" + hand(50)), (2, 2, "lib/b.js", "// another one 1.3.1\n// and more\n" + changed),  # copies, header and an identifier changed
        (3, 1, "src/c.js", hand(51)), (4, 2, "src/d.js", other(hand(51), 7)),  # of one form by chance: nothing else is shared
        (5, 3, "src/e.js", "// @generated by x\n" + hand(52)), (6, 3, "src/f.js", "// @generated by x\n" + other(hand(52), 1)), (7, 3, "src/g.js", other(hand(52), 2)),  # a silent member
        (8, 4, "src/h.js", "// @generated by x\n" + hand(53)), (9, 5, "src/i.js", other(hand(53), 3)),  # one declared member elsewhere says nothing
        (10, 6, "vendor/j.js", hand(54)), (11, 6, "src/k.js", "// ours\n" + hand(54).replace("return", "return ", 1)),  # a silent copy beside the declared one
        (12, 7, "src/l.js", hand(55).replace("  ", "")[:240]), (13, 8, "src/m.js", "// later\n" + hand(55).replace("  ", "")[:240]),  # short, only the header changed
    ]
    df = spark.createDataFrame(files, "file_id long, repo_id long, file_path string, content string")
    got = {r["file_id"]: r["reason"] for r in H.classified(df).collect()}
    assert got == {1: "vendored", 2: "vendored", 3: None, 4: None, 5: "generated", 6: "generated", 7: "generated", 8: "generated", 9: None, 10: "vendored", 11: "vendored", 12: "vendored", 13: "vendored"}


def test_links_are_those_of_brute_force(spark):
    r = random.Random(3)
    base = [list(r.sample(range(1000), 60)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(4):
            x = set(b)
            for _ in range(r.choice([0, 2, 4])):
                x.discard(r.choice(b))
                x.add(r.randrange(10**6))
            sets.append(sorted(x))
    import numpy as np

    rows = []
    for i, s in enumerate(sets):
        h = np.array(s, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h.sort()
        sig = H.signature(h)
        rows.append((i, h.view(np.int64).tolist(), sig.tolist(), H.band_keys(sig)))
    df = spark.createDataFrame(rows, "class long, hashes array<long>, sig array<long>, bands array<long>")
    own = {r["class"]: r["family"] for r in H.families(df).collect()}
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(set(a) & set(sets[j])) >= 0.8 * len(set(a) | set(sets[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert own == {i: root(i) for i in range(len(sets))}


def test_links_among_classes_that_resemble_their_leader(spark):
    """One bucket of classes most of which are 0.6 to 0.8 similar to its first one."""
    import numpy as np
    import xxhash

    r = random.Random(5)
    first = list(range(100))
    swap = lambda x, n, at: sorted({*x} - set(r.sample(sorted(x), n)) | set(range(at, at + n)))
    sets = [first]
    for i in range(12):  # pairs: alike to each other, not to the first
        sets.append(swap(first, 15, 1000 + 100 * i))
        sets.append(swap(sets[-1], 5, 1050 + 100 * i))
    sets.append(swap(first, 9, 5000))  # in the first one's ball
    sets.append(swap(sets[-1], 9, 5100))  # alike to that member only
    rows = []
    for i, x in enumerate(sets):
        h = np.array([xxhash.xxh64_intdigest(str(v)) for v in x], dtype=np.uint64)
        h.sort()
        rows.append((i, h.view(np.int64).tolist(), H.signature(h).tolist(), [7]))
    df = spark.createDataFrame(rows, "class long, hashes array<long>, sig array<long>, bands array<long>")
    own = {r["class"]: r["family"] for r in H.families(df).collect()}
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len({*a} & {*sets[j]}) >= 0.8 * len({*a} | {*sets[j]}):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert len(set(want)) == 13 and own == dict(enumerate(want))


def test_a_bucket_of_many_unlike_classes(spark):
    """20,000 classes of one bucket, half alike but for 50 similar pairs: no comparison of whole signatures for each two."""
    import time

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    n, common = 20_000, r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, x])) for x in r.integers(0, 2**63, (n, 20), dtype=np.uint64)]
    for i in range(50):
        sets[2 * i + 1] = np.sort(np.concatenate([sets[2 * i][:-2], sets[2 * i + 1][-2:]]))
    column = lambda rows: pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))
    table = pa.table({"class": pa.array(range(n), pa.int64()), "hashes": column(sets), "sig": column([H.signature(x) for x in sets]), "bands": column([np.array([7])] * n)})
    df = spark.createDataFrame(table).repartition(2)
    H.links(df.limit(0)).collect()
    began = time.time()
    got = {(min(x), max(x)) for x in H.links(df).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(50)}
    assert time.time() - began < 45


def test_near_pairs_leave_out_no_similar_one():
    """Buckets below and above SMALL, sets of all sizes, some with more hashes than parities can tell apart."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = []
    for key, classes in ((-5, 1), (-4, 64), (-2, 65), (1, 9), (3, 1100)):
        base = [r.integers(0, 2**63, m, dtype=np.uint64) for m in (1, 3, 12, 60, 200, 700, 2500)]
        for _ in range(classes):
            x = base[r.integers(len(base))]
            rows.append((key, np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 2**63, r.integers(len(x) // 9 + 1), dtype=np.uint64), x[:1]]))))
    rows.sort(key=lambda x: (x[0], len(x[1])))
    key, n = np.array([x[0] for x in rows]), np.array([len(x[1]) for x in rows], dtype=np.int32)
    for places in (H.PLACES, 2 * H.PLACES):
        found = [(i, j) for a, b in H.near_pairs(key, n, np.stack([H.parities(x[1], places) for x in rows])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len({*found}) and all(j < i and key[i] == key[j] for i, j in found)
        similar = set()
        for i in range(0, len(rows), 7):
            for j in range(i):
                if key[i] == key[j] and n[j] >= 0.8 * n[i]:
                    common = len(np.intersect1d(rows[i][1], rows[j][1], assume_unique=True))
                    if common >= 0.8 * (n[i] + n[j] - common):
                        similar.add((i, j))
        assert len(similar) > 1000 and similar <= {*found}
    assert not list(H.near_pairs(key[:0], n[:0], np.zeros((0, 8), dtype=np.uint64)))


def test_pieces_end_with_their_keys():
    import pyarrow as pa

    keys = [[1, 1, 2], [], [2, 2], [2], [3], [4, 5], [6, 6]]
    parts, got = [], []
    for b in H._pieces(pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], names=["key"]) for k in keys):
        if b is not None:
            parts += b.column(0).to_pylist()
        else:
            got.append(parts)
            parts = []
    assert not parts and sum(got, []) == sum(keys, [])
    assert all(not {*a} & {*b} for i, a in enumerate(got) for b in got[:i])


def test_tokens_of_literals():
    same = lambda path, *texts: len({H.evidence(path, x)["hashes"].tobytes() for x in texts}) == 1
    assert same("a.rs", 'let a = r"x y";', 'let a = r#"x "y" z"#;', "let b = 'c';\n\n  ", 'let a = br##"x"# "##; // r#', "let r = '\\n';")
    assert same("a.py", "x = rb'a'", 'y = """a\n#"""  # b', "z = 'f'\n" + " " * 100_000)
    assert same("a.js", "x = /a[/]b/g", "y = `a\n${b}`", "z = 'c' /* d */")
    assert not same("a.rs", "let a = r#type;", 'let a = r#"type"#;')


@pytest.mark.parametrize(("line", "want"), [("@generated by x", (True, False)), ("Upstream: A, tag v1.2.3 (imported, keep in sync)", (False, True)), ("quartz 6.25, copyright its authors", (False, True)), ("All rights reserved.", (False, False)), ("replaces the generated client", (False, False))])
def test_declared(line, want):
    assert H.declared([line]) == want
