"""Subjects: what counts as prose, the model on a planted corpus with held-out labels, the defined cases."""

import random

import numpy as np

from millrace.llm import subjects as S

WORDS = {1: "invoice ledger refund escrow payout tax".split(), 2: "nurse biopsy vaccine ward clinic dosage".split(), 3: "violin chord tempo chorus melody octave".split()}
TEMPLATES = ["The import of {} takes long, most of it spent on {}.", "Please make sure that {} values are compared with {}.", "Renamed the {} column, because {} was misleading."]
TOOLING = ["Everything compiles again once the cache is cleared.", "The flaky loader test is skipped for now.", "Build times fell after the cleanup."]


def test_prose():
    text = "# Heading\n\nOne sentence. Another one!\nwrapped on.\n\n```py\ncode = 1\n```\n- a bullet\n- b bullet\n2024-01-01T10:00:00Z WARN x[1] ok\n> quoted prose here.\n"
    assert S.prose(text) == ["One sentence.", "Another one!", "wrapped on.", "a bullet", "b bullet", "quoted prose here."]
    assert S.prose(None) == [] and S.prose("  \n") == []
    words, owner = S.sentences(["", "See `fn_name` in a/b.rs and https://x.y/z now", None], np.zeros(0, dtype=np.int64))
    assert words == [["see", "in", "and", "now"]] and owner.tolist() == [1]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        subjects = rng.sample([1, 2, 3], rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(TOOLING) for _ in range(2)]
        for s in subjects:
            lines += [rng.choice(TEMPLATES).format(*rng.sample(WORDS[s], 2)) for _ in range(3)]
        if rng.random() < 0.2 and subjects:
            other = rng.choice([s for s in WORDS if s not in subjects])
            lines.append(rng.choice(TEMPLATES).format(*rng.sample(WORDS[other], 2)))
        rng.shuffle(lines)
        docs.append((k, " ".join(lines), "en"))
        truth[k] = set(subjects)
    return docs, truth


def test_held_out_accuracy_and_cases(spark):
    docs, truth = corpus(400)
    labels = [(k, s, "a") for k in range(120) for s in (truth[k] or {None})] + [(3, 2, "wrong"), (9999, 1, "unknown"), (0, 1, "a"), (None, 1, "a")]
    subjects = [(1, "payments", "Money movement."), (2, "medicine", "Clinics."), (3, "music", None), (None, "x", "y")]
    rows = [*docs, (1000, None, None), (1001, "", "en"), (1002, docs[5][1], None), (1003, "```\ninvoice ledger\n```", "xx"), (1004, " ".join(docs[7][1] for _ in range(2000)), "en")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, subject_id string")
    lab = spark.createDataFrame(labels, "doc_id long, subject_id int, labeller string")
    sub = spark.createDataFrame(subjects, "subject_id int, subject_name string, description string")
    got: dict = {}
    for r in S.areas(d, lab, sub).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    held = [k for k in range(120, 400)]
    tp = sum(len(got.get(k, set()) & truth[k]) for k in held)
    assert tp / sum(len(truth[k]) for k in held) > 0.95
    assert tp / max(sum(len(got.get(k, set())) for k in held), 1) > 0.95
    assert not {1000, 1001, 1003} & set(got) and got.get(1002, set()) == got.get(5, set()) and got.get(1004, set()) == truth[7]
    assert S.areas(d.limit(0), lab, sub).count() == 0
    assert S.areas(d, lab.limit(0), sub).count() >= 0


def test_quoted_test_passages_do_not_count(spark):
    prompt = "Rows of violin chord tempo chorus melody octave are ordered by octave then by chord and the violin goes last."
    other = "The violin is in the chorus today."
    t = S.item_triples([(1, prompt, None)])
    assert S.sentences([prompt], t)[0] == [] and S.sentences([other], t)[0]
    docs = spark.createDataFrame([(1, prompt + " " + other, "en"), (2, None, None), (3, other, "de")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, prompt, None), (2, "Quite another passage of a test item", "x")], "item_id long, prompt string, solution string")
    got = [{r["doc_id"]: (r["words"], r["sizes"]) for r in S._encode(docs, items, block).collect()} for block in (5, 1)]
    assert got[0] == got[1] and len(got[0][1][1]) == 1 and got[0][2] == ([], [])


def test_topics_are_found_without_labels_and_passes_improve_them(spark):
    docs, truth = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    sub = spark.createDataFrame([(1, "payments", "x"), (2, "medicine", "x"), (3, "music", "x")], "subject_id int, subject_name string, description string")
    lab = spark.createDataFrame([(k, s, "a") for k in range(40) for s in truth[k]], "doc_id long, subject_id int, labeller string")
    fits = [S.fit(d, lab, sub, passes=n) for n in (0, 3)]
    spelled = {r["hash"]: r["word"] for r in fits[0].encoded.selectExpr("explode(spelled) as x").select("x.*").collect()}
    for f in fits:
        for k, (lead, weight) in enumerate(zip(*S.top_terms(f.topics), strict=True)):
            if f.subject_of_topic[k] >= 0:
                own = WORDS[f.subjects[f.subject_of_topic[k]]]
                terms = [spelled[f.vocabulary[w]] for w, x in zip(lead, weight, strict=True) if x > 0.05]
                assert sum(t in own for t in terms) * 2 > len(terms)

    def wrong(f):
        got = {k: set() for k in truth}
        for r in S.proportions(f).where(f"share >= {S.AREA_SHARE}").collect():
            got[r["doc_id"]].add(r["subject_id"])
        return sum(len(got[k] ^ truth[k]) for k in truth)

    assert wrong(fits[1]) <= wrong(fits[0]) and wrong(fits[1]) < 0.05 * len(truth)


def test_posterior_is_a_distribution():
    c = S.corpus([np.array([0, 1, 2]), np.array([]), np.array([1])], [np.array([0, 0, 1]), np.array([]), np.array([0])], np.array([2, 0, 1]))
    topics = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
    r, counts = S.posterior(c, topics)
    assert np.allclose(r.sum(axis=1), 1) and np.allclose(counts.sum(axis=1), [3, 0, 1])
