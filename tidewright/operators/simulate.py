"""Simulation: state-space runs, Monte Carlo, queues, agents, sensitivity. Scenarios and runs are rows.

Random numbers depend on a seed and the key of the run alone, never on partitions. Expressions of
users are checked against a list of allowed names before they become columns; nothing is evaluated
as code.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import kurtosis, skewness

#: For each law the names of its parameters, those of the generator's, and what is optional.
LAWS = {
    "normal": ({"mean": "loc", "std": "scale"}, {}),
    "uniform": ({"low": "low", "high": "high"}, {}),
    "lognormal": ({"mu": "mean", "sigma": "sigma"}, {"mu": 0.0, "sigma": 1.0}),
    "triangular": ({"left": "left", "mode": "mode", "right": "right"}, {}),
    "beta": ({"a": "a", "b": "b"}, {}),
    "exponential": ({"scale": "scale"}, {}),
    "gamma": ({"shape": "shape", "scale": "scale"}, {"scale": 1.0}),
    "poisson": ({"lam": "lam"}, {}),
    "weibull": ({"a": "a", "scale": "scale"}, {"scale": 1.0}),
    "binomial": ({"n": "n", "p": "p"}, {}),
    "chisquare": ({"df": "df"}, {}),
    "constant": ({"value": "value"}, {}),
}


def sample(spec: dict, rng: np.random.Generator, size: int = 1) -> np.ndarray:
    """Values of one of the twelve laws; an unknown law, and a parameter too many or too few, is an error."""
    law = spec.get("dist")
    if law not in LAWS:
        raise ValueError(f"no such law: {law}")
    names, given = LAWS[law][0], {k: v for k, v in spec.items() if k != "dist"}
    if given.keys() - names.keys():
        raise ValueError(f"{law} has no {', '.join(sorted(given.keys() - names.keys()))}")
    given = LAWS[law][1] | given
    if names.keys() - given.keys():
        raise ValueError(f"{law} needs {', '.join(sorted(names.keys() - given.keys()))}")
    own = {names[k]: v for k, v in given.items()}
    if law == "constant":
        return np.full(size, float(own["value"]))
    if law == "weibull":
        return own["scale"] * rng.weibull(own["a"], size)
    return np.asarray(getattr(rng, law)(**own, size=size), float)


def excitation(grid: DataFrame, kind: str, amplitude: float = 1.0, freq: float = 1.0, t_on: float = 0.0) -> DataFrame:
    """grid (t, ...) with u: step, impulse, sine, ramp or zero."""
    t = F.col("t").cast("double")
    kinds = {"step": F.when(t >= t_on, amplitude).otherwise(0.0), "impulse": F.when(F.abs(t - t_on) < 1e-6, amplitude).otherwise(0.0), "sine": amplitude * F.sin(2 * np.pi * freq * t), "ramp": F.when(t >= t_on, amplitude * (t - t_on)).otherwise(0.0), "zero": F.lit(0.0)}
    if kind not in kinds:
        raise ValueError(f"no such signal: {kind}")
    return grid.withColumn("u", kinds[kind])


def input_function(kind: str, amplitude: float = 1.0, freq: float = 1.0, t_on: float = 0.0) -> Callable[[float], float]:
    return {
        "step": lambda t: amplitude if t >= t_on else 0.0,
        "impulse": lambda t: amplitude if abs(t - t_on) < 1e-6 else 0.0,
        "sine": lambda t: amplitude * np.sin(2 * np.pi * freq * t),
        "ramp": lambda t: amplitude * (t - t_on) if t >= t_on else 0.0,
        "zero": lambda t: 0.0,
    }[kind]


def euler_first_order(scenarios: DataFrame, steps: int) -> DataFrame:
    """scenario, step, x of x' = a x + b u from x0 by Euler steps of dt; scenarios: scenario, a, b, u, x0, dt."""
    def one(xs: Column, _: Column) -> Column:
        last = F.element_at(xs, -1)
        return F.concat(xs, F.array(last + F.col("dt") * (F.col("a") * last + F.col("b") * F.col("u"))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col("x0").cast("double")), one)
    return scenarios.select("scenario", F.posexplode(path).alias("step", "x"))


def _rk4(a: np.ndarray, b: np.ndarray, x: np.ndarray, u: Callable[[float], float], t: float, dt: float) -> np.ndarray:
    slope = lambda s, at: a @ s + b @ np.full(b.shape[1], u(at))
    k1 = slope(x, t)
    k2 = slope(x + dt / 2 * k1, t + dt / 2)
    k3 = slope(x + dt / 2 * k2, t + dt / 2)
    k4 = slope(x + dt * k3, t + dt)
    return x + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def check_model(a: np.ndarray, b: np.ndarray, x0: np.ndarray) -> None:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError(f"A must be square, not {a.shape}")
    if b.shape[0] != len(a):
        raise ValueError(f"B has {b.shape[0]} rows, A {len(a)}")
    if len(x0) != len(a):
        raise ValueError(f"x0 has {len(x0)} values, A {len(a)} rows")


def state_space(a: np.ndarray, b: np.ndarray, x0: np.ndarray, u: Callable[[float], float], t_end: float, dt: float, euler: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Times and states of x' = A x + B u."""
    check_model(a, b, x0)
    t = np.arange(0, t_end + dt, dt)
    x = np.zeros((len(t), len(a)))
    x[0] = x0
    for i in range(len(t) - 1):
        x[i + 1] = x[i] + dt * (a @ x[i] + b @ np.full(b.shape[1], u(t[i]))) if euler else _rk4(a, b, x[i], u, t[i], dt)
    return t, x


def stable(a: np.ndarray) -> bool:
    return bool((np.linalg.eigvals(a).real < 0).all())


def run_scenarios(scenarios: DataFrame, t_end: float, dt: float, kind: str = "step") -> DataFrame:
    """scenario, step, t, state, x of state-space models given as JSON (column model: A, B, x0), by Runge-Kutta steps."""

    def run(batches):
        u = input_function(kind)
        for rows in batches:
            for s, text in zip(rows["scenario"], rows["model"], strict=True):
                m = json.loads(text)
                a, b = np.array(m["A"], float), np.array(m["B"], float)
                t, x = state_space(a, b, np.array(m.get("x0", np.zeros(len(a))), float), u, t_end, dt)
                n, k = x.shape
                yield pd.DataFrame({"scenario": s, "step": np.repeat(np.arange(n), k), "t": np.repeat(t, k), "state": np.tile(np.arange(k), n), "x": x.ravel()})

    return scenarios.select(F.col("scenario").cast("string"), "model").mapInPandas(run, "scenario string, step long, t double, state long, x double")


def run_nonlinear(spark: SparkSession, f: Callable, starts: list[list[float]], t_end: float, dt: float) -> DataFrame:
    """scenario, step, t, state, x of x' = f(t, x) from each start; f is a Python function, by Runge-Kutta steps."""

    def run(batches):
        for rows in batches:
            for s, x0 in zip(rows["scenario"], rows["x0"], strict=True):
                t = np.arange(0, t_end + dt, dt)
                x = np.zeros((len(t), len(x0)))
                x[0] = x0
                for i in range(len(t) - 1):
                    k1 = np.asarray(f(t[i], x[i]))
                    k2 = np.asarray(f(t[i] + dt / 2, x[i] + dt / 2 * k1))
                    k3 = np.asarray(f(t[i] + dt / 2, x[i] + dt / 2 * k2))
                    x[i + 1] = x[i] + dt / 6 * (k1 + 2 * k2 + 2 * k3 + np.asarray(f(t[i] + dt, x[i] + dt * k3)))
                n, k = x.shape
                yield pd.DataFrame({"scenario": s, "step": np.repeat(np.arange(n), k), "t": np.repeat(t, k), "state": np.tile(np.arange(k), n), "x": x.ravel()})

    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(starts)], "scenario long, x0 array<double>")
    return rows.mapInPandas(run, "scenario long, step long, t double, state long, x double")


# --- Monte Carlo ------------------------------------------------------------------------------


def inject(model: dict, path: str, value: float) -> None:
    """Puts a value at a path such as A[0][1] or b[0]."""
    parts = [int(p) if p.isdigit() else p for p in path.replace("]", "").replace("[", ".").split(".")]
    for p in parts[:-1]:
        model = model[p]
    model[parts[-1]] = value


def mc_run(model: dict, x0: list[float], u: Callable[[float], float], t_end: float, dt: float) -> np.ndarray:
    """One trajectory (steps, states): a state-space model or an ARX recursion from zero."""
    if "A" in model:
        a, b = np.array(model["A"], float), np.array(model["B"], float)
        return state_space(a, b, np.array(x0[: len(a)] if len(x0) >= len(a) else np.zeros(len(a)), float), u, t_end, dt)[1]
    if "a" not in model:
        raise ValueError("a model needs A and B, or a and b")
    a, b, nk = np.array(model["a"], float), np.array(model.get("b", [1.0]), float), int(model.get("nk", 1))
    t = np.arange(0, t_end + dt, dt)
    y, ut = np.zeros(len(t)), np.array([u(s) for s in t])
    for i in range(max(len(a), len(b) + nk - 1), len(t)):
        y[i] = -sum(a[j] * y[i - j - 1] for j in range(len(a))) + sum(b[j] * ut[i - nk - j] for j in range(len(b)) if i - nk - j >= 0)
    return y[:, None]


def monte_carlo(spark: SparkSession, model: dict, laws: dict[str, dict], runs: int = 1000, t_end: float = 10.0, dt: float = 0.1, x0: list[float] | None = None, kind: str = "step", seed: int = 0) -> DataFrame:
    """run_id, step, x (last state) of runs with sampled parameters; runs that fail or overflow are left out."""

    def run(batches):
        u = input_function(kind)
        for rows in batches:
            for r in rows["run_id"]:
                own, rng = json.loads(json.dumps(model)), np.random.default_rng([seed, int(r)])
                for path, law in laws.items():
                    inject(own, path, float(sample(law, rng)[0]))
                try:
                    with np.errstate(all="ignore"):
                        x = mc_run(own, x0 or [], u, t_end, dt)[:, -1]
                except (ValueError, FloatingPointError):
                    continue
                yield pd.DataFrame({"run_id": r, "step": np.arange(len(x)), "x": x})

    return spark.range(runs).withColumnRenamed("id", "run_id").mapInPandas(run, "run_id long, step long, x double")


def terminal(traj: DataFrame) -> DataFrame:
    """Statistics of the last step over runs: moments, extremes, the 5 % quantile and the mean below it."""
    last = traj.groupBy("run_id").agg(F.max_by("x", "step").alias("x")).where("not isnan(x)")
    q = last.agg(F.percentile("x", F.lit(0.05)).alias("q"))
    both = last.join(F.broadcast(q))  # q is one row
    return both.agg(F.count("*").alias("runs"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), skewness("x").alias("skew"), (kurtosis("x") - 3).alias("kurtosis"), F.min("x").alias("min"), F.max("x").alias("max"), F.max("q").alias("var_5"), F.avg(F.when(F.col("x") <= F.col("q"), F.col("x"))).alias("cvar_5"))


def bands(traj: DataFrame) -> DataFrame:
    """step and the 5, 25, 50, 75 and 95 % quantiles over runs."""
    p = F.percentile("x", F.array(*[F.lit(q / 100) for q in (5, 25, 50, 75, 95)]))
    return traj.where("not isnan(x)").groupBy("step").agg(p.alias("p")).select("step", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((5, 25, 50, 75, 95))])


def convergence(traj: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """n, mean, change, converged of the mean of the first n runs' ends, for n = 100, 200, 500, 1000, ..."""
    from pyspark.sql import Window

    last = traj.groupBy("run_id").agg(F.max_by("x", "step").alias("x"))
    sizes = [m * 10**e for e in range(2, 9) for m in (1, 2, 5)]
    # Each run counts for the sizes beyond its number: sums by the first such size, then running over sizes.
    first = F.coalesce(*[F.when(F.col("run_id") < s, F.lit(s)) for s in sizes])
    part = last.groupBy(first.alias("n")).agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    upto = Window.orderBy("n")
    out = part.withColumn("mean", F.sum("s").over(upto) / F.sum("c").over(upto)).withColumn("before", F.lag("mean").over(upto))
    change = F.abs(F.col("mean") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-12))
    return out.select("n", "mean", change.alias("change"), F.coalesce((F.col("n") >= 200) & (change < tolerance), F.lit(False)).alias("converged"))


# --- queues -----------------------------------------------------------------------------------


def queue_waits(customers: DataFrame, servers: int = 1) -> DataFrame:
    """queue, i, arrival, start, finish, wait of first-come first-served customers (queue, i, arrival, service).

    Each takes the server that is free first; one fold over each queue's arrivals.
    """
    own = customers.groupBy("queue").agg(F.array_sort(F.collect_list(F.struct("arrival", "i", "service"))).alias("c"))
    begin = F.struct(F.array_repeat(F.lit(0.0), servers).alias("free"), F.array().cast("array<struct<i:bigint,arrival:double,start:double,finish:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = F.greatest(a["free"][0], x["arrival"].cast("double"))
        done = start + x["service"]
        row = F.struct(x["i"].cast("long").alias("i"), x["arrival"].cast("double").alias("arrival"), start.alias("start"), done.alias("finish"))
        return F.struct(F.array_sort(F.concat(F.slice(a["free"], 2, servers), F.array(done))).alias("free"), F.concat(a["out"], F.array(row)).alias("out"))

    rows = own.select("queue", F.inline(F.aggregate("c", begin, step)["out"]))
    return rows.withColumn("wait", F.col("start") - F.col("arrival"))


def lindley_waits(customers: DataFrame) -> DataFrame:
    """queue, i, wait with one server, by windows alone: the rise of the work's running sum over its lowest value so far."""
    from pyspark.sql import Window

    w = Window.partitionBy("queue").orderBy("i")
    step = F.lag("service").over(w) - (F.col("arrival") - F.lag("arrival").over(w))
    rows = customers.withColumn("s", F.coalesce(step, F.lit(0.0))).withColumn("sum", F.sum("s").over(w))
    return rows.withColumn("wait", F.col("sum") - F.min("sum").over(w)).select("queue", "i", "wait")


def queue_stats(waits: DataFrame, t_end: float, servers: int = 1) -> DataFrame:
    """Mean, largest and 95 % wait, throughput and utilisation of each queue up to t_end."""
    busy = F.greatest(F.lit(0.0), F.least(F.col("finish"), F.lit(t_end)) - F.col("start"))
    a = waits.where(F.col("start") <= t_end).groupBy("queue").agg(F.avg("wait").alias("mean_wait"), F.max("wait").alias("max_wait"), F.percentile("wait", F.lit(0.95)).alias("p95_wait"), (F.count_if(F.col("finish") <= t_end) / t_end).alias("throughput"), F.least(F.lit(1.0), F.sum(busy) / (t_end * servers)).alias("utilisation"))
    return a


def discrete_events(arrival: dict, service: dict, servers: int, t_end: float, seed: int = 0) -> dict:
    """One replicate of the event-driven queue; simultaneous events keep the order in which they were planned."""
    rng, count = np.random.default_rng(seed), 0
    events: list[tuple[float, int, str, int]] = []

    def plan(t: float, kind: str, server: int = -1) -> None:
        nonlocal count
        heapq.heappush(events, (t, count, kind, server))
        count += 1

    plan(float(sample(arrival, rng)[0]), "arrival")
    free, queue, waits, lengths, busy, served = list(range(servers)), [], [], [], 0.0, 0
    while events and events[0][0] <= t_end:
        t, _, kind, server = heapq.heappop(events)
        if kind == "arrival":
            after = t + float(sample(arrival, rng)[0])
            if after <= t_end:
                plan(after, "arrival")
            queue.append(t)
        else:
            served += 1
            heapq.heappush(free, server)
        while queue and free:
            s = float(sample(service, rng)[0])
            waits.append(t - queue.pop(0))
            busy += min(s, max(0.0, t_end - t))
            plan(t + s, "departure", heapq.heappop(free))
        lengths.append(len(queue))
    return {"served": served, "mean_wait": float(np.mean(waits)) if waits else 0.0, "max_wait": max(waits, default=0.0), "p95_wait": float(np.percentile(waits, 95)) if waits else 0.0, "mean_length": float(np.mean(lengths)) if lengths else 0.0, "max_length": max(lengths, default=0), "utilisation": min(1.0, busy / (t_end * servers)), "throughput": served / t_end}


def replicate_queues(spark: SparkSession, arrival: dict, service: dict, servers: int = 1, t_end: float = 100.0, runs: int = 100, seed: int = 0) -> DataFrame:
    """run_id and the statistics of independent replicates."""

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([{"run_id": int(r), **discrete_events(arrival, service, servers, t_end, seed * 1_000_003 + int(r))} for r in rows["run_id"]])

    schema = "run_id long, served long, mean_wait double, max_wait double, p95_wait double, mean_length double, max_length long, utilisation double, throughput double"
    return spark.range(runs).withColumnRenamed("id", "run_id").mapInPandas(run, schema)


# --- agents -----------------------------------------------------------------------------------


def topology(n: int, kind: str, rng: np.random.Generator, k: int = 6, rewire: float = 0.1, m: int = 3) -> list[set[int]]:
    """Neighbours of each agent: complete, grid, small_world or scale_free."""
    near: list[set[int]] = [set() for _ in range(n)]

    def link(a: int, b: int) -> None:
        if a != b:
            near[a].add(b), near[b].add(a)

    if kind == "complete":
        return [set(range(n)) - {i} for i in range(n)]
    if kind == "grid":
        side = int(np.ceil(np.sqrt(n)))
        for i in range(n):
            if (i + 1) % side and i + 1 < n:
                link(i, i + 1)
            if i + side < n:
                link(i, i + side)
    elif kind == "small_world":
        for i in range(n):
            for d in range(1, k // 2 + 1):
                j = (i + d) % n
                if rng.random() < rewire and len(near[i]) < n - 1:
                    j = int(rng.choice([x for x in range(n) if x != i and x not in near[i]]))
                link(i, j)
    elif kind == "scale_free":
        ends: list[int] = []
        for i in range(min(m + 1, n)):
            for j in range(i):
                link(i, j)
                ends += [i, j]
        for i in range(m + 1, n):
            chosen: set[int] = set()
            while len(chosen) < m:
                chosen.add(int(ends[rng.integers(len(ends))]))
            for j in sorted(chosen):
                link(i, j)
                ends += [i, j]
    else:
        raise ValueError(f"no such topology: {kind}")
    return near


def agents(spark: SparkSession, n: int = 100, steps: int = 100, kind: str = "grid", threshold: float = 0.0, law: dict | None = None, noise: float = 0.0, runs: int = 1, seed: int = 0) -> DataFrame:
    """run_id, step, mean, std, active of agents that take the mean of their neighbours, one after another in place.

    Agents whose value is over threshold act; noise adds a random walk. One replicate is one row's work.
    """

    def run(batches):
        for rows in batches:
            for r in rows["run_id"]:
                rng = np.random.default_rng([seed, int(r)])
                near = [np.array(sorted(x), int) for x in topology(n, kind, rng)]
                x = sample(law or {"dist": "uniform", "low": 0.0, "high": 1.0}, rng, n)
                out = []
                for s in range(steps):
                    out.append((r, s, x.mean(), x.std(), (x > 0).mean()))
                    for i in range(n):
                        if x[i] > threshold and len(near[i]):
                            x[i] = x[near[i]].mean()
                        if noise:
                            x[i] += rng.normal(0, noise)
                yield pd.DataFrame(out, columns=["run_id", "step", "mean", "std", "active"])

    return spark.range(runs).withColumnRenamed("id", "run_id").mapInPandas(run, "run_id long, step long, mean double, std double, active double")


def agents_at_once(nodes: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """id, x after steps in which all agents at the same time take the mean of their neighbours; joins only.

    Differs from agents(), which updates in place; this one has no limit on the number of agents.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    now = nodes.select("id", F.col("x").cast("double").alias("x"))
    for _ in range(steps):
        mean = both.join(now, F.col("dst") == F.col("id")).groupBy("src").agg(F.avg("x").alias("m"))
        now = now.join(mean, F.col("id") == F.col("src"), "left").select("id", F.coalesce("m", "x").alias("x"))
    return now


# --- sensitivity ------------------------------------------------------------------------------

_NAME = re.compile(r"[A-Za-z_]\w*")
FUNCTIONS = {"abs", "sqrt", "exp", "ln", "log10", "sin", "cos", "tan", "pow", "least", "greatest"}


def safe_expression(text: str, names: list[str]) -> Column:
    """An arithmetic expression over names as a column; anything but numbers, operators and allowed functions is an error."""
    if not re.fullmatch(r"[\w\s+\-*/%().,]*", text):
        raise ValueError(f"not an arithmetic expression: {text}")
    for word in _NAME.findall(re.sub(r"\b\d+(\.\d+)?([eE][+-]?\d+)?\b", "0", text)):
        if word not in names and word not in FUNCTIONS:
            raise ValueError(f"unknown name: {word}")
    return F.expr(text).cast("double")


def one_at_a_time(spark: SparkSession, expression: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """param, low, high, delta: the expression at both ends of each range, the others at their middles."""
    names = list(ranges)
    rows = [(p, end, *[ranges[q][end] if q == p else sum(ranges[q]) / 2 for q in names]) for p in names for end in (0, 1)]
    grid = spark.createDataFrame([(a, b, *map(float, rest)) for a, b, *rest in rows], "param string, side int, " + ", ".join(f"`{n}` double" for n in names))
    out = grid.withColumn("value", safe_expression(expression, names)).groupBy("param").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high"))
    return out.withColumn("delta", F.col("high") - F.col("low"))


def sobol(spark: SparkSession, expression: str, ranges: dict[str, tuple[float, float]], n: int = 1024, seed: int = 0) -> DataFrame:
    """param, s1, st: shares of variance by one parameter alone and with all others, from paired random samples."""
    names = list(ranges)

    def rows(batches):
        for own in batches:
            for i in own["id"]:
                rng = np.random.default_rng([seed, int(i)])
                lo, hi = np.array(list(ranges.values()), float).T
                a, b = (lo + (hi - lo) * rng.random(len(names)) for _ in range(2))
                out = [(i, "", *a), (i, " ", *b)]  # no names of parameters
                for k, p in enumerate(names):
                    x = a.copy()
                    x[k] = b[k]
                    out.append((i, p, *x))
                yield pd.DataFrame(out, columns=["id", "which", *names])

    cols = ", ".join(f"`{x}` double" for x in names)
    f = spark.range(n).mapInPandas(rows, f"id long, which string, {cols}").withColumn("f", safe_expression(expression, names)).select("id", "which", "f")
    base = f.groupBy("id").agg(F.max(F.when(F.col("which") == "", F.col("f"))).alias("fa"), F.max(F.when(F.col("which") == " ", F.col("f"))).alias("fb"))
    var = base.select(F.col("fa").alias("v")).union(base.select("fb")).agg(F.var_pop("v").alias("v"))
    both = f.where(~F.col("which").isin("", " ")).join(base, "id").groupBy(F.col("which").alias("param")).agg(F.avg(F.col("fb") * (F.col("f") - F.col("fa"))).alias("x"), (F.avg((F.col("fa") - F.col("f")) ** 2) / 2).alias("y"))
    share = lambda c: F.coalesce(F.col(c) / F.nullif("v", F.lit(0.0)), F.lit(0.0))
    return both.join(F.broadcast(var)).select("param", share("x").alias("s1"), share("y").alias("st"))  # var is one row


def morris(spark: SparkSession, expression: str, ranges: dict[str, tuple[float, float]], paths: int = 64, levels: int = 4, seed: int = 0) -> DataFrame:
    """param, mu_star, sigma of elementary effects along random paths that change one parameter at a time."""
    names = list(ranges)

    def rows(batches):
        for own in batches:
            for i in own["id"]:
                rng = np.random.default_rng([seed, int(i)])
                lo, hi = np.array(list(ranges.values()), float).T
                jump = levels / (2 * (levels - 1))
                x = rng.integers(0, levels // 2, len(names)) / (levels - 1)
                out = [(i, 0, "", *(lo + (hi - lo) * x))]
                for k, j in enumerate(rng.permutation(len(names))):
                    x = x.copy()
                    x[j] += jump
                    out.append((i, k + 1, names[j], *(lo + (hi - lo) * x)))
                yield pd.DataFrame(out, columns=["id", "k", "param", *names])

    from pyspark.sql import Window

    cols = ", ".join(f"`{x}` double" for x in names)
    f = spark.range(paths).mapInPandas(rows, f"id long, k int, param string, {cols}").withColumn("f", safe_expression(expression, names))
    e = f.withColumn("e", (F.col("f") - F.lag("f").over(Window.partitionBy("id").orderBy("k"))) / (levels / (2 * (levels - 1)))).where("k > 0")
    return e.groupBy("param").agg(F.avg(F.abs("e")).alias("mu_star"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("sigma"))


def bridge(outputs: DataFrame) -> DataFrame:
    """Simulation outputs (mode, metrics map) as the inputs of a later validation, named by mode."""
    m = F.col("metrics")
    named = F.when(F.col("mode") == "sd", F.create_map(F.lit("stability"), m["is_stable"], F.lit("settling"), m["settling_time"])).when(F.col("mode") == "mc", F.create_map(F.lit("baseline_mean"), m["mean"], F.lit("baseline_std"), m["std"])).when(F.col("mode") == "sensitivity", F.map_filter(m, lambda _, v: v.isNotNull()))
    return outputs.select("mode", F.coalesce(named, m).alias("phase_5_inputs"))
