"""Greedy kernels against brute force and their guarantees; sessions and navigation."""

import itertools
import random

import numpy as np
import pytest

from millrace.operators import selection as S
from millrace.operators import sessions as N


def pool(seed, n=12, levels=False):
    rng = random.Random(seed)
    items = [
        S.Candidate(i, rng.randint(1, 40), rng.random(), f"f{rng.randrange(4)}", None, tuple(rng.sample(range(n), 2)), levels=tuple(sorted(rng.randint(1, 60) for _ in range(4))) if levels else ())
        for i in range(n)
    ]
    return S.Pool(items, {c.id: c.score for c in items})


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("method", [S.lazy_greedy, S.threshold_greedy, S.multiple_choice])
def test_budget_and_trace(seed, method):
    p = pool(seed, levels=method is S.multiple_choice)
    steps = method(p, 80)
    assert steps and steps[-1].tokens <= 80
    assert all(b.tokens >= a.tokens and b.utility >= a.utility - 1e-12 for a, b in itertools.pairwise(steps))
    if method is not S.multiple_choice:
        assert sum(s.cost for s in steps) == steps[-1].tokens


@pytest.mark.parametrize("seed", range(6))
def test_exact_is_brute_force(seed):
    rng = random.Random(seed)
    costs, values = [rng.randint(1, 30) for _ in range(10)], [rng.random() for _ in range(10)]
    best = max((sum(values[i] for i in c) for k in range(11) for c in itertools.combinations(range(10), k) if sum(costs[i] for i in c) <= 60), default=0)
    value, chosen = S.exact_knapsack(costs, values, 60)
    assert abs(value - best) < 1e-9 and sum(costs[i] for i in chosen) <= 60


def test_exact_refuses_too_many():
    with pytest.raises(ValueError):
        S.exact_knapsack([1] * 33, [1.0] * 33, 3)


def test_single_item_beats_greedy():
    small, big = S.Candidate(1, 1, 0.01, "a"), S.Candidate(2, 100, 5.0, "b")
    steps = S.lazy_greedy(S.Pool([small, big], {1: 0.01, 2: 5.0}), 100)
    assert [s.id for s in steps] == [2]


def test_framing_costs():
    a, b = S.Candidate(1, 10, 1.0, "f", "C", file_frame=5, container_frame=3), S.Candidate(2, 10, 1.0, "f", "C", file_frame=5, container_frame=3)
    p = S.Pool([a, b], {1: 1.0, 2: 1.0})
    assert [s.cost for s in S.lazy_greedy(p, 100)] == [18, 10]


def test_frontier():
    assert [x[0] for x in S.frontier((10, 12, 30, 100))] == [0, 2, 3, 4]
    assert [x[0] for x in S.frontier((10, 10, 10, 10))] == [0, 4]
    assert S.frontier((5, 3, 8, 9))[1][1] >= 5


def test_knee():
    assert S.knee([]) is None and S.knee([(1, 1.0)]) == 0 and S.knee([(1, 1.0), (2, 3.0)]) == 1
    assert S.knee([(1, 1.0), (1, 2.0), (1, 3.0)]) == 0
    assert S.knee([(0, 0.0), (10, 8.0), (20, 9.0), (100, 10.0)]) == 1


def test_knees_frame(spark):
    rows = [(1, i, float(x), y) for i, (x, y) in enumerate([(0, 0.0), (10, 8.0), (20, 9.0), (100, 10.0)])] + [(2, 0, 1.0, 1.0), (2, 1, 2.0, 2.0), (3, 0, 5.0, 1.0)]
    got = {r["query"]: r["step"] for r in S.knees(spark.createDataFrame(rows, "query long, step int, cost double, utility double")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def utility():
    k = np.array([[1, 0.6, 0.2], [0.6, 1, 0.5], [0.2, 0.5, 1]])
    return S.Utility(np.array([0.9, 0.5, 0.3]), k, ["a", "a", "b"], [None, None, None])


def test_diminishing_returns():
    u = utility()
    before = u.gain(1)
    u.add(0)
    assert u.gain(1) <= before
    batch = 1 - np.prod(1 - np.minimum(u.kernel[[0]], 1 - 1e-7), axis=0)
    assert abs(u.coverage() - float((u.relevance * batch).sum())) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_submodular_ratio(seed):
    rng = np.random.default_rng(seed)
    n = 7
    k = rng.random((n, n)) * 0.5
    np.fill_diagonal(k, 1.0)
    u = S.Utility(rng.random(n), k, [f"f{i}" for i in range(n)], [None] * n)
    costs = [int(c) for c in rng.integers(1, 20, n)]
    greedy = sum(g for _, g in S.submodular_greedy(u, costs, 30))
    best = 0.0
    for r in range(n + 1):
        for c in itertools.combinations(range(n), r):
            if sum(costs[i] for i in c) <= 30:
                u.reset()
                best = max(best, sum(u.add(i) for i in c))
    assert greedy >= 0.316 * best - 1e-9


def test_select_frame(spark):
    rows = [(q, i, 5 + i, 0.1 * i, "f", None, [i + 1]) for q in (1, 2) for i in range(6)]
    c = spark.createDataFrame(rows, "query long, id long, cost long, score double, file string, container string, near array<long>")
    got = S.select(c, 20).collect()
    assert {r["query"] for r in got} == {1, 2} and all(r["tokens"] <= 20 for r in got)
    assert S.select(c.limit(0), 20).count() == 0


def test_levels(spark):
    rows = [(1, 1, 0.9, True, [5, 8, 20, 40]), (1, 2, 0.5, False, [5, 9, 20, 40]), (1, 3, 0.4, False, [5, 30, 40, 50])]
    got = {r["id"]: r["level"] for r in S.assign_levels(spark.createDataFrame(rows, "query long, id long, score double, seed boolean, levels array<long>"), 56).collect()}
    assert got == {1: 3, 2: 1, 3: 0}


def test_sessions(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(seconds=s), 1, i) for k, (s, i) in enumerate([(0, "a"), (0, "a"), (30, "b"), (200, "a")])]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, item string")
    got = sorted((r["session"], r["item"], r["n"]) for r in N.debounce(e, "user_id", "item", "ts", 60).collect())
    assert got == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]


def test_navigation_stops_within_budget():
    nodes = {i: (1.0 / (i + 1), "Function", 10) for i in range(20)}
    out = {i: [i + 1] for i in range(19)}
    steps = N.navigate_kernel(nodes, out, {}, {}, [0], 60)
    assert steps[-1][1] == "stop" and all(s[4] >= 0 for s in steps) and len(steps) <= 15
    assert N.navigate_kernel({}, {}, {}, {}, [], 100)[-1][1] == "stop"
