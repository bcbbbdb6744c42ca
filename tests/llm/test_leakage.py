"""Leaks: forms that must be found, near misses that must not, recall against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import leakage as L

COMMON = "Complete the task below. Return only code.\n\n"


def item(rng, k):
    words = [f"w{rng.randrange(100000)}" if rng.random() < 0.5 else rng.choice("the of and when each row may be".split()) for _ in range(70)]
    lines = [f"    line_{rng.randrange(9999)} = fn_{rng.randrange(9999)}(a, {rng.randrange(99)})" for _ in range(8)]
    return (k, COMMON + " ".join(words) + ".", "def f(a):\n" + "\n".join(lines))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [item(rng, k) for k in range(1, 41)]


def forms(text):
    w = text.split()
    p = " ".join(w[10:34])
    return {
        "plain": p, "upper": p.upper(), "wrapped": "> " + "\n> ".join(" ".join(w[10 + i : 14 + i]) for i in range(0, 24, 4)), "html": "<p>" + p.replace(" ", " <b>", 1).replace(" ", "</b> ", 2) + "</p>", "zero width": "\u200b".join(p),
        "json": '{"prompt": "' + p.replace(" ", "\\n", 3) + '"}', "comment": "\n".join("// " + " ".join(w[10 + i : 16 + i]) for i in range(0, 24, 6)), "changed": " ".join(w[10:18] + ["zzz"] + w[19:34]), "tabs": "\t\n".join(w[10:34]),
        "foreign line": " ".join(w[10:22]) + "\nsome quite unrelated foreign line here\n" + " ".join(w[22:34]),
    }


def test_forms(spark, items):
    own = items[3][1][len(COMMON) :]
    rng = random.Random(9)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    docs, want = [], set()
    for k, (name, f) in enumerate(forms(own).items()):
        docs.append((k, f"{noise(300)}\n\n{f}\n\n{noise(700)}", name))
        want.add((k, 4))
    s = items[7][2].split("\n")
    docs.append((100, noise(50) + "\n```\n" + "\n".join("+" + x for x in s[1:7]) + "\n```\n" + noise(50), "solution"))
    want.add((100, 8))
    docs += [(200, noise(50) + "\n" + "\n".join(s[1:4]), "few lines"), (201, noise(20) + " " + " ".join(own.split()[5:17]), "mention"), (202, COMMON, "instruction"), (203, None, "null"), (204, "", "empty"), (205, " ".join(sorted(own.split())), "shuffled"), (206, "word " * 30000, "long")]
    docs.append((300, docs[0][1], "copy"))
    want.add((300, 4))
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (900, None, None), (901, None, "x")], "item_id long, prompt string, solution string")
    got = {(r["doc_id"], r["item_id"]) for r in L.search(d, i).collect()}
    assert got == want
    assert {(r["doc_id"], r["item_id"]) for r in L.search(d, i, block=7).collect()} == want
    assert L.search(d.limit(0), i).count() == 0 and L.search(d, i.limit(0)).count() == 0


def test_search_misses_nothing_that_brute_force_finds(items):
    rng = random.Random(2)
    parts = L.parts_of(items, COMMON)
    index = L.Index(parts)
    docs = []
    for _ in range(120):
        p = rng.choice(parts).tokens
        a = rng.randrange(max(len(p) - 22, 1))
        noise = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(400))]
        cut = rng.randrange(len(noise) + 1)
        docs.append(noise[:cut] + p[a : a + 22] + noise[cut:])
    hashes = [L.shingles(d) for d in docs]
    found = {divmod(x, len(parts)) for x in index.contained(hashes, index.candidates(hashes)).tolist()}
    brute = {(k, j) for k, d in enumerate(docs) for j, p in enumerate(parts) if L.leaked(d, hashes[k], p, index.hashes[j])}
    assert brute and len(brute - found) <= 0.01 * len(brute)


def test_containment_of_a_batch_equals_that_of_each_pair(items):
    parts = L.parts_of(items, COMMON)
    index = L.Index(parts)
    docs = [parts[k].tokens[:n] * 2 + ["x", "y", "z"] for k in range(0, 40, 3) for n in (5, 12, 70)] + [[], ["a"]]
    hashes = [L.shingles(d) for d in docs]
    every = np.arange(len(docs) * len(parts))
    want = [d * len(parts) + p for d in range(len(docs)) for p in range(len(parts)) if len(set(hashes[d].tolist()) & set(index.hashes[p].tolist())) >= index.least[p]]
    assert index.contained(hashes, every).tolist() == want and want


def verdict(part, doc):
    return L.leaked(doc, L.shingles(doc), part, L.shingles(part.tokens))


def test_twenty_words_and_single_changed_ones():
    t = [f"t{i}" for i in range(60)]
    part = L.Part(1, False, t)
    noise = [f"n{i}" for i in range(30)]
    cut = lambda a, b, *changed: noise + ["zzz" if i in changed else t[i] for i in range(a, b)] + noise
    assert verdict(part, cut(10, 30)) and not verdict(part, cut(10, 29)) and not verdict(part, cut(10, 27))
    assert verdict(part, cut(10, 30, 28)) and verdict(part, cut(10, 30, 11)) and verdict(part, cut(10, 30, 20))
    assert not verdict(part, cut(10, 30, 12, 16, 20)) and not verdict(part, cut(10, 29, 27))
    assert verdict(part, cut(0, 60, 12, 27, 42))
    short = L.Part(1, False, t[:9])
    assert verdict(short, noise + t[:9]) and not verdict(short, noise + t[:8])


def test_chains_over_very_long_runs():
    t = [f"t{i}" for i in range(3000)]
    part = L.Part(1, True, t, [i // 10 for i in range(3000)], 300)
    doc = t[:1400] + ["zzz"] + t[1401:1600]
    assert verdict(part, doc) and not verdict(part, t[:1400] + ["q"] * 80 + t[2000:2100])


def test_bands_follow_the_partition_size():
    assert [L.bands(u) for u in L.PARTITIONS] == sorted(L.bands(u) for u in L.PARTITIONS)
