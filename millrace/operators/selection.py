"""Budgeted selection: sequential greedy kernels, one per query, run side by side.

A kernel gets the candidates of one query as arrays; queries are groups of
`applyInPandas`, prefiltered to candidates that can matter. Ties go to the
smaller id everywhere.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Constants of the gains.
MIN_RELEVANCE, NO_SCORE, NO_NEIGHBOR_SCORE, NEIGHBOR_WEIGHT, DIVERSITY = 1e-5, 0.01, 0.005, 0.2, 0.4
LEVELS = ("signature", "documented", "sliced", "full")
LEVEL_UTILITY = (0.35, 0.60, 0.85, 1.0)


@dataclass
class Candidate:
    id: int
    cost: int
    score: float
    file: str
    container: str | None = None
    near: tuple[int, ...] = ()
    file_frame: int = 0
    container_frame: int = 0
    levels: tuple[int, ...] = ()


@dataclass
class Step:
    id: int
    cost: int
    tokens: int
    gain: float
    utility: float
    level: int = 0


@dataclass
class Pool:
    """Candidates of a query and the state of a selection over them."""

    items: list[Candidate]
    scores: dict[int, float]
    covered: set[int] = field(default_factory=set)
    file_tokens: dict[str, int] = field(default_factory=dict)
    containers: set[tuple[str, str]] = field(default_factory=set)
    tokens: int = 0

    def gain(self, c: Candidate, size: int | None = None, share: float = 1.0, neighbors: bool = True) -> float:
        """Relevance, uncovered neighbours, and the diversity of a file that is not full yet."""
        near = sum(self.scores.get(n, NO_NEIGHBOR_SCORE) for n in c.near if n not in self.covered) if neighbors else 0.0
        grown = (max(c.cost, 1) if size is None else size) / (1.0 + self.file_tokens.get(c.file, 0))
        return share * self.scores.get(c.id, NO_SCORE) + NEIGHBOR_WEIGHT * near + DIVERSITY * math.log1p(grown)

    def price(self, c: Candidate, own: int | None = None) -> int:
        """Tokens that a candidate adds now, with the frames of a file and container it opens."""
        cost = c.cost if own is None else own
        if c.file not in self.file_tokens:
            cost += c.file_frame
        if c.container is not None and (c.file, c.container) not in self.containers:
            cost += c.container_frame
        return max(cost, 1)

    def take(self, c: Candidate, cost: int, cover: bool = True) -> None:
        self.tokens += cost
        self.file_tokens[c.file] = self.file_tokens.get(c.file, 0) + cost
        if cover:
            self.covered.add(c.id)
            self.covered.update(c.near)
            if c.container is not None:
                self.containers.add((c.file, c.container))


def _best_single(pool: Pool, budget: int) -> Step | None:
    best = None
    for c in pool.items:
        cost, gain = pool.price(c), pool.gain(c)
        if cost <= budget and (best is None or gain > best.gain):
            best = Step(c.id, cost, cost, gain, gain)
    return best


def _or_single(steps: list[Step], single: Step | None) -> list[Step]:
    """The knapsack guarantee: a single item that beats the whole greedy answer replaces it."""
    return [single] if single and single.gain > (steps[-1].utility if steps else 0.0) else steps


def lazy_greedy(pool: Pool, budget: int) -> list[Step]:
    """Gain per token with lazy re-evaluation; what does not fit when it is looked at is never tried again."""
    single = _best_single(pool, budget)
    by_id = {c.id: c for c in pool.items}
    heap = [(-pool.gain(c) / pool.price(c), c.id, 0) for c in pool.items if pool.price(c) <= budget]
    heapq.heapify(heap)
    steps: list[Step] = []
    total = 0.0
    while heap and pool.tokens < budget:
        density, i, seen = heapq.heappop(heap)
        c = by_id[i]
        cost = pool.price(c)
        if pool.tokens + cost > budget:
            continue
        if seen != len(steps):
            gain = pool.gain(c)
            if gain > 0:
                heapq.heappush(heap, (-gain / cost, i, len(steps)))
            continue
        gain = max(-density * cost, 0.0)
        total += gain
        pool.take(c, cost)
        steps.append(Step(i, cost, pool.tokens, gain, total))
    return _or_single(steps, single)


def threshold_greedy(pool: Pool, budget: int, epsilon: float = 0.1) -> list[Step]:
    """Passes over all candidates with a falling density threshold, without a queue."""
    eps = min(max(epsilon, 0.01), 0.5)
    single = _best_single(pool, budget)
    if single is None or single.gain <= 0:
        return []
    waiting = [c for c in pool.items if pool.price(c) <= budget and pool.gain(c) > 0]
    steps: list[Step] = []
    total, tau = 0.0, single.gain
    while tau >= eps / max(budget, 1) * single.gain and pool.tokens < budget and waiting:
        left = []
        for c in waiting:
            cost = pool.price(c)
            gain = pool.gain(c)
            if pool.tokens + cost <= budget and gain / cost >= tau:
                total += gain
                pool.take(c, cost)
                steps.append(Step(c.id, cost, pool.tokens, gain, total))
            else:
                left.append(c)
        waiting = left
        tau *= 1.0 - eps
    return _or_single(steps, single)


def frontier(costs: tuple[int, ...], utilities: tuple[float, ...] = LEVEL_UTILITY) -> list[tuple[int, int, float]]:
    """(level, cost, utility) on the upper hull from nothing (level 0); costs never fall with the level."""
    points = [(0, 0, 0.0)]
    last = 0
    for k, (c, u) in enumerate(zip(costs, utilities, strict=True), start=1):
        last = max(last, c, 1)
        if last == points[-1][1]:
            points[-1] = (k, last, max(u, points[-1][2]))
        elif u > points[-1][2]:
            points.append((k, last, u))
    hull: list[tuple[int, int, float]] = []
    for p in points:
        while len(hull) >= 2:
            a, b = hull[-2], hull[-1]
            if (b[2] - a[2]) * (p[1] - b[1]) <= (p[2] - b[2]) * (b[1] - a[1]):
                hull.pop()
            else:
                break
        hull.append(p)
    return hull


def multiple_choice(pool: Pool, budget: int) -> list[Step]:
    """Jointly which candidates and at which level: upgrades along each hull by gain per token."""
    hulls = {c.id: frontier(c.levels) for c in pool.items}
    by_id = {c.id: c for c in pool.items if len(hulls[c.id]) > 1 and pool.price(c, hulls[c.id][1][1]) <= budget}
    single = None
    for c in by_id.values():
        frame = pool.price(c, 0) if (c.file_frame or c.container_frame) else 0
        near = NEIGHBOR_WEIGHT * sum(pool.scores.get(n, NO_NEIGHBOR_SCORE) for n in c.near)
        for level, cost, u in hulls[c.id][1:]:
            whole = cost + frame
            if whole <= budget:
                value = u * pool.scores.get(c.id, 0.0) + near + DIVERSITY * math.log1p(whole)
                if single is None or value > single.gain:
                    single = Step(c.id, whole, whole, value, value, level)
    at = dict.fromkeys(by_id, 0)

    def upgrade(c: Candidate) -> tuple[float, int]:
        j = at[c.id]
        (_, c0, u0), (_, c1, u1) = hulls[c.id][j], hulls[c.id][j + 1]
        cost = pool.price(c, c1 - c0) if j == 0 else c1 - c0
        return pool.gain(c, c1 - c0, u1 - u0, j == 0), max(cost, 1)

    heap = []
    for c in by_id.values():
        g, cost = upgrade(c)
        heap.append((-g / cost, c.id, 0, 0))
    heapq.heapify(heap)
    steps: list[Step] = []
    total = 0.0
    while heap:
        density, i, j, seen = heapq.heappop(heap)
        if at[i] != j or j + 1 >= len(hulls[i]):
            continue
        c = by_id[i]
        g, cost = upgrade(c)
        if pool.tokens + cost > budget:
            continue
        if seen != len(steps):
            heapq.heappush(heap, (-g / cost, i, j, len(steps)))
            continue
        gain = max(-density * cost, 0.0)
        total += gain
        pool.take(c, cost, j == 0)
        at[i] = j + 1
        steps.append(Step(i, cost, pool.tokens, gain, total, hulls[i][j + 1][0]))
        if j + 2 < len(hulls[i]):
            g, cost = upgrade(c)
            heapq.heappush(heap, (-g / cost, i, j + 1, len(steps)))
    return _or_single(steps, single)


def exact_knapsack(costs: list[int], values: list[float], budget: int, max_items: int = 32, max_nodes: int = 100_000) -> tuple[float, list[int]]:
    """Best subset of additive values by depth-first branch and bound with the fractional bound."""
    if len(costs) > max_items:
        raise ValueError(f"at most {max_items} candidates")
    order = sorted(range(len(costs)), key=lambda i: (-values[i] / max(costs[i], 1), i))
    best, chosen, seen = 0.0, [], 0

    def bound(k: int, room: int, value: float) -> float:
        for i in order[k:]:
            if costs[i] <= room:
                room -= costs[i]
                value += values[i]
            else:
                return value + values[i] * room / max(costs[i], 1)
        return value

    stack: list[tuple[int, int, float, tuple[int, ...]]] = [(0, budget, 0.0, ())]
    while stack and seen < max_nodes:
        k, room, value, taken = stack.pop()
        seen += 1
        if value > best + 1e-12:
            best, chosen = value, list(taken)
        if k == len(order) or bound(k, room, value) <= best + 1e-12:
            continue
        i = order[k]
        stack.append((k + 1, room, value, taken))
        if costs[i] <= room:
            stack.append((k + 1, room - costs[i], value + values[i], (*taken, i)))
    return best, sorted(chosen)


@dataclass
class Utility:
    """Weighted relevance, coverage, tests and paths less redundancy; components normalised by their totals."""

    relevance: np.ndarray
    kernel: np.ndarray
    files: list[str]
    containers: list[str | None]
    tests: np.ndarray | None = None
    weights: tuple[float, float, float, float] = (0.35, 0.35, 0.15, 0.10)

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.left = np.zeros(self.kernel.shape[1])
        self.tests_left = np.zeros(self.tests.shape[1]) if self.tests is not None else None
        self.selected: list[int] = []

    @staticmethod
    def _cover(left: np.ndarray, row: np.ndarray, weight: np.ndarray) -> float:
        return float((weight * np.exp(left) * row).sum())

    def gain(self, i: int) -> float:
        a, b, t, red = self.weights
        total = max(float(self.relevance.sum()), 1e-12)
        g = a * float(self.relevance[i]) / total + b * self._cover(self.left, self.kernel[i], self.relevance) / total
        if self.tests is not None:
            g += t * self._cover(self.tests_left, self.tests[i], np.ones(self.tests.shape[1])) / max(self.tests.shape[1], 1)
        if self.selected:
            same = sum(0.2 + 0.4 * (self.containers[i] is not None and self.containers[i] == self.containers[j]) for j in self.selected if self.files[i] == self.files[j])
            g -= red * same / len(self.selected)
        return max(g, 0.0)

    def add(self, i: int) -> float:
        g = self.gain(i)
        self.left += np.log1p(-np.minimum(self.kernel[i], 1 - 1e-7))
        if self.tests is not None:
            self.tests_left += np.log1p(-np.minimum(self.tests[i], 1 - 1e-7))
        self.selected.append(i)
        return g

    def coverage(self) -> float:
        return float((self.relevance * (1 - np.exp(self.left))).sum())


def submodular_greedy(u: Utility, costs: list[int], budget: int) -> list[tuple[int, float]]:
    """(index, gain) by gain per token over the utility, with the single-item correction."""
    single = max(((u.gain(i), -i) for i in range(len(costs)) if costs[i] <= budget), default=(0.0, 0))
    heap = [(-u.gain(i) / max(costs[i], 1), i, 0) for i in range(len(costs)) if costs[i] <= budget]
    heapq.heapify(heap)
    out: list[tuple[int, float]] = []
    used = 0
    while heap:
        d, i, seen = heapq.heappop(heap)
        if used + costs[i] > budget:
            continue
        if seen != len(out):
            g = u.gain(i)
            if g > 0:
                heapq.heappush(heap, (-g / max(costs[i], 1), i, len(out)))
            continue
        out.append((i, u.add(i)))
        used += costs[i]
    if single[0] > sum(g for _, g in out):
        return [(-single[1], single[0])]
    return out


def knee(points: list[tuple[int, float]], floor: float = 0.35) -> int | None:
    """Index of the knee of a (cost, utility) curve: farthest above the chord among points with enough utility."""
    if not points:
        return None
    if len(points) <= 2:
        return len(points) - 1
    (x0, y0), (x1, y1) = points[0], points[-1]
    if x1 - x0 <= 1e-6 or y1 - y0 <= 1e-6:
        return 0
    best, at = -math.inf, len(points) - 1
    for i, (x, y) in enumerate(points):
        d = (y - y0) / (y1 - y0) - (x - x0) / (x1 - x0)
        if y / max(y1, 1e-6) >= floor and d > best:
            best, at = d, i
    return at


def knees(curve: DataFrame, floor: float = 0.35) -> DataFrame:
    """(query, step, cost, utility) of the knee of each query's curve (query, step, cost, utility), in windows."""
    w = Window.partitionBy("query")
    o = w.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = curve.withColumns({"x0": F.first("cost").over(o), "x1": F.last("cost").over(o), "y0": F.first("utility").over(o), "y1": F.last("utility").over(o), "n": F.count("*").over(w), "s0": F.first("step").over(o), "s1": F.last("step").over(o)})
    flat = (F.col("x1") - F.col("x0") <= 1e-6) | (F.col("y1") - F.col("y0") <= 1e-6)
    diff = F.when(~flat, F.round((F.col("utility") - F.col("y0")) / (F.col("y1") - F.col("y0")) - (F.col("cost") - F.col("x0")) / (F.col("x1") - F.col("x0")), 9))
    key = F.when(F.col("n") <= 2, (F.col("step") == F.col("s1")).cast("double")).when(flat, (F.col("step") == F.col("s0")).cast("double")).when(F.col("utility") / F.greatest("y1", F.lit(1e-6)) >= floor, diff)
    x = x.withColumn("d", key).where("d is not null")
    return x.withColumn("r", F.row_number().over(w.orderBy(F.desc("d"), "step"))).where("r = 1").select("query", "step", "cost", "utility")


# -- per-query kernels over DataFrames -------------------------------------------


def pools(pdf: pd.DataFrame) -> Pool:
    levels = pdf["levels"] if "levels" in pdf else [()] * len(pdf)
    items = [
        Candidate(int(i), int(c), float(s), f, k if isinstance(k, str) else None, tuple(int(x) for x in n) if n is not None else (), levels=tuple(int(x) for x in lv) if lv is not None else ())
        for i, c, s, f, k, n, lv in zip(pdf["id"], pdf["cost"], pdf["score"], pdf["file"], pdf["container"], pdf["near"], levels, strict=True)
    ]
    items.sort(key=lambda c: c.id)
    return Pool([c for c in items if c.score >= MIN_RELEVANCE], {c.id: c.score for c in items})


STEPS = "query bigint, step bigint, id bigint, cost bigint, tokens bigint, gain double, utility double, level bigint"


def select(candidates: DataFrame, budget: int, method: Callable[[Pool, int], list[Step]] = lazy_greedy) -> DataFrame:
    """(query, step, id, cost, tokens, gain, utility, level): the selection of each query within the budget.

    `candidates` (query, id, cost, score, file, container, near[, levels]).
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = method(pools(pdf), budget)
        return pd.DataFrame([(key[0], n, s.id, s.cost, s.tokens, s.gain, s.utility, s.level) for n, s in enumerate(steps, start=1)], columns=[c.split()[0] for c in STEPS.split(", ")])

    return candidates.groupBy("query").applyInPandas(run, STEPS)


def auto_budget(candidates: DataFrame, least: int, most: int) -> DataFrame:
    """(query, budget, tokens, symbols): runs to the ceiling, cuts at the knee, keeps within [least, most]."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = lazy_greedy(pools(pdf), most)
        k = knee([(s.tokens, s.utility) for s in steps])
        budget = min(max(steps[k].tokens if k is not None else least, least), most)
        kept = [s for s in steps if s.tokens <= budget]
        return pd.DataFrame({"query": [key[0]], "budget": [budget], "tokens": [kept[-1].tokens if kept else 0], "symbols": [len(kept)]})

    return candidates.groupBy("query").applyInPandas(run, "query bigint, budget bigint, tokens bigint, symbols bigint")


def stability(candidates: DataFrame, bounds: DataFrame, budget: int) -> DataFrame:
    """(query, selected, stable, stability): selected items whose density stays above every rival's even if the
    rival's score and its neighbours' are too low by their error bounds. `bounds` (query, id, bound)."""
    j = candidates.join(bounds.select("query", "id", "bound"), ["query", "id"], "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        error = {int(i): float(b) for i, b in zip(pdf["id"], pdf["bound"], strict=True) if b == b and b is not None}
        chosen = {s.id for s in lazy_greedy(pools(pdf), budget)}
        full = pools(pdf)
        by = {c.id: c for c in full.items}
        for i in sorted(chosen):
            full.take(by[i], max(by[i].cost, 1))
        rival = 0.0
        for c in full.items:
            if c.id not in chosen and c.cost <= budget:
                extra = error.get(c.id, 0.0) + NEIGHBOR_WEIGHT * sum(error.get(n, 0.0) for n in c.near if n not in full.covered)
                rival = max(rival, (full.gain(c) + extra) / max(c.cost, 1))
        stable = 0
        for i in sorted(chosen):
            p = pools(pdf)
            for o in sorted(chosen):
                if o != i:
                    p.take(by[o], max(by[o].cost, 1))
            stable += p.gain(by[i]) / max(by[i].cost, 1) > rival
        return pd.DataFrame({"query": [key[0]], "selected": [len(chosen)], "stable": [stable], "stability": [stable / len(chosen) if chosen else 1.0]})

    return j.groupBy("query").applyInPandas(run, "query bigint, selected bigint, stable bigint, stability double")


def assign_levels(selected: DataFrame, budget: int) -> DataFrame:
    """(query, id, level, cost): every selected item as a signature first, seeds then raised as far as they fit,
    others to documented by score. `selected` (query, id, score, seed, levels)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["id"], pdf["score"], pdf["seed"], pdf["levels"], strict=True), key=lambda r: (-bool(r[2]), -r[1], r[0]))
        level = {int(r[0]): 0 for r in rows}
        used = sum(int(r[3][0]) for r in rows)
        for i, _, seed, costs in rows:
            for want in (3, 2, 1) if seed else (1,):
                more = int(costs[want]) - int(costs[0])
                if used + more <= budget:
                    used += more
                    level[int(i)] = want
                    break
        return pd.DataFrame({"query": key[0], "id": [int(r[0]) for r in rows], "level": [level[int(r[0])] for r in rows], "cost": [int(r[3][level[int(r[0])]]) for r in rows]})

    return selected.groupBy("query").applyInPandas(run, "query bigint, id bigint, level bigint, cost bigint")


def omission_reason(score, cost, gain, remaining: int | object, limit: int, least: float = MIN_RELEVANCE):  # noqa: ANN001, ANN201 - columns
    """Why a candidate was left out."""
    return F.when(score < least, "below_threshold").when((cost > remaining) | (cost > limit), "budget_exhausted").when((gain <= 0.15 * score) | (gain <= 0), "redundant").otherwise("outranked")


def confidence(selected_relevance, total_relevance, used, budget, path_probability):  # noqa: ANN001, ANN201 - columns
    """Confidence of a context from relevance, use of the budget and mean path probability."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    rel = F.when(total_relevance > 1e-6, clamp(selected_relevance / total_relevance)).otherwise(F.when(selected_relevance > 0, 1.0).otherwise(0.0))
    return clamp(0.7 * rel + 0.2 * F.least(used / budget, F.lit(1.0)) + 0.1 * clamp(F.coalesce(path_probability, F.lit(0.0))))
