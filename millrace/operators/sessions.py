"""Agent sessions and adaptive navigation: traces, totals and the navigation kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the navigation actions: what an action of unknown size is taken to cost and how types are weighed.
ACTION_COST = {"trace": 64, "test": 34}
TYPE_PRIOR = {"Function": 1.0, "Method": 1.0, "Struct": 0.9, "Trait": 0.9, "Module": 0.7, "Enum": 0.6, "TypeAlias": 0.6}
OVERHEAD = 4


def session_totals(steps: DataFrame) -> DataFrame:
    """Calls, tokens, distinct items and items per 1000 tokens of each session (session, item, tokens, ok)."""
    s = steps.groupBy("session").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.countDistinct("item").alias("items"), F.sum(F.col("ok").cast("int")).alias("succeeded"))
    return s.withColumn("per_1000", F.when(F.col("tokens") > 0, F.col("items") * 1000.0 / F.col("tokens")).otherwise(0.0))


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """`events` with `session`, a number per key that grows after every pause longer than the gap."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts, "event_id")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    pause = micros - F.lag(micros).over(w)
    new = (pause.isNull() | (pause > int(gap_seconds * 1_000_000))).cast("bigint")
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def debounce(events: DataFrame, key: str, item: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, session, item, first_ts, last_ts, n): changes of one item within a burst become one."""
    s = sessionize(events, key, ts, gap_seconds)
    return s.groupBy(key, "session", item).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean reductions of `after` against `before`, both session totals keyed by scenario."""
    j = before.alias("b").join(after.alias("a"), "scenario")
    cut = lambda c: F.avg(F.greatest(1 - F.col(f"a.{c}") / F.greatest(F.col(f"b.{c}"), F.lit(1)), F.lit(0.0)) * 100)
    return j.agg(F.count("*").alias("scenarios"), cut("tokens").alias("token_reduction"), cut("calls").alias("call_reduction"))


def navigate_kernel(nodes: dict[int, tuple], out: dict[int, list[int]], back: dict[int, list[int]], tests: dict[int, list[int]], start: list[int], budget: int, max_steps: int = 15) -> list[tuple]:
    """(step, action, item, cost, left) of one walk: at each step the action of most gain per cost.

    `nodes` id -> (relevance, kind, snippet tokens). Candidates are cut to the ten of highest priority before
    they are weighed; the last step is always a stop.
    """
    seen: set[int] = set()
    observed: set[int] = set(start)
    frontier = list(start)
    left, steps = budget, []
    for n in range(1, max_steps + 1):
        options = []
        fresh = [i for i in frontier if i in nodes and i not in seen]
        for i in fresh:
            rel, kind, tokens = nodes[i]
            near = out.get(i, []) + back.get(i, [])
            unknown = sum(x not in observed for x in near) / len(near) if near else 0.1 / 0.30
            gain = max((0.35 * rel + 0.30 * unknown) * TYPE_PRIOR.get(kind, 0.4), 0.01)
            options.append((0.85 if kind in ("Function", "Method") else 0.8 if kind in ("Struct", "Trait") else 0.7 if kind == "Module" else 0.6, "inspect", i, gain, 2 + tokens + OVERHEAD))
            if left >= 100:
                room = min(left, 500)
                options.append((0.75, "expand", i, (0.35 * rel + 0.24) * min(max(room / 1000.0, 0.5), 1.5), room // 4 + 2 * OVERHEAD))
            if tests.get(i):
                options.append((0.70, "test", i, 0.15 * (0.5 + 0.5 * rel), max(12 * len(tests[i]), 4) + 2 + OVERHEAD))
        known = sorted(seen)
        for i in fresh[:3]:
            if known:
                options.append((0.65, "trace", i, 0.20 * 0.9, ACTION_COST["trace"]))
        stop = 0.95 if left < 50 else 0.50 if len(seen) >= 5 else 0.10
        options.append((stop, "stop", -1, 0.05 * (2.0 if not fresh else 1.5 if left < 40 else 0.5), 1))
        options.sort(key=lambda o: (-o[0], o[2], o[1]))
        options = [o for o in options[:10] if o[1] == "stop" or o[4] <= left]
        best = max(options, key=lambda o: (o[3] / max(o[4], 1), -o[2]), default=None)
        if best is None or best[1] == "stop" or best[3] / best[4] < 1e-4 or n == max_steps:
            steps.append((n, "stop", None, 0, left))
            break
        _, action, i, _, cost = best
        left -= cost
        steps.append((n, action, i, cost, left))
        seen.add(i)
        grown = out.get(i, []) + (back.get(i, []) if action == "expand" else []) + (tests.get(i, []) if action == "test" else [])
        observed.update(out.get(i, []), back.get(i, []))
        frontier += [x for x in grown if x not in frontier]
    return steps


def navigate(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = 2000, max_steps: int = 15) -> DataFrame:
    """(query, step, action, item, cost, remaining): one walk per query over the nodes of its group.

    `nodes` (query, id, relevance, kind, tokens, is_test); `edges` (src, dst); `seeds` (query, id).
    """
    own = nodes.select("query", F.col("id").alias("src"))
    e = edges.select("src", "dst").distinct().join(own, "src").groupBy("query", "src").agg(F.sort_array(F.collect_list("dst")).alias("near"))
    s = seeds.select("query", "id").distinct().withColumn("seed", F.lit(True))
    j = nodes.join(e.withColumnRenamed("src", "id"), ["query", "id"], "left").join(s, ["query", "id"], "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        info = {int(i): (float(r), k, int(t)) for i, r, k, t in zip(pdf["id"], pdf["relevance"], pdf["kind"], pdf["tokens"], strict=True)}
        out = {int(i): [int(x) for x in n] for i, n in zip(pdf["id"], pdf["near"], strict=True) if n is not None}
        back: dict[int, list[int]] = {}
        for a, near in out.items():
            for b in near:
                back.setdefault(b, []).append(a)
        test_ids = {int(i) for i, t in zip(pdf["id"], pdf["is_test"], strict=True) if t}
        tests = {i: [x for x in back.get(i, []) if x in test_ids] for i in info}
        start = [int(i) for i, x in zip(pdf["id"], pdf["seed"], strict=True) if x is True]
        steps = navigate_kernel(info, out, back, tests, start, budget, max_steps)
        return pd.DataFrame([(key[0], *r) for r in steps], columns=["query", "step", "action", "item", "cost", "remaining"])

    return j.groupBy("query").applyInPandas(run, "query bigint, step bigint, action string, item bigint, cost bigint, remaining bigint")
