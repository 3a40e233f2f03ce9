"""First-order chains on transition counts, many at once.

Every function takes edges (keys..., from_state, to_state, cnt) and returns one
result for each combination of ``keys``; with no keys there is one chain.  What
needs counts only is plain aggregation.  What needs linear algebra runs in a
grouped map, one chain a group: a chain's size is bounded by the vocabulary of
screens, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import columns as C

Keys = Sequence[str]


def counts(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Summed positive counts of each edge."""
    return edges.where("cnt > 0").groupBy(*keys, "from_state", "to_state").agg(F.sum("cnt").alias("cnt"))


def probabilities(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """counts with prob, the share of its origin."""
    return counts(edges, keys).withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "from_state")))


def is_end(state: str):
    return F.col(state).isin(*C.ENDS)


def states(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    both = F.explode(F.array("from_state", "to_state")).alias("state")
    return edges.where("cnt > 0").select(*keys, both).distinct()


def screens(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    return states(edges, keys).where(~is_end("state"))


def state_rank(state: str):
    """Order of states: START, the screens by name, EXIT."""
    return F.when(F.col(state) == C.START, 0).when(F.col(state) == C.EXIT, 2).otherwise(1)


def determinism(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """How foreseeable the next step of each screen is; null where none was seen.  Ties of top_to go to the first state in order."""
    p = probabilities(edges, keys)
    top = F.row_number().over(Window.partitionBy(*keys, "from_state").orderBy(F.desc("cnt"), state_rank("to_state"), "to_state"))
    own = p.withColumn("_r", top).groupBy(*keys, F.col("from_state").alias("state")).agg(
        F.sum(C.information(F.col("prob"))).alias("entropy"), F.sum(F.col("prob") * F.col("prob")).alias("hhi"), F.max("prob").alias("top_p"),
        F.count(F.lit(1)).alias("out_degree"), F.max(F.when(F.col("_r") == 1, F.col("to_state"))).alias("top_to"),
    )
    return screens(edges, keys).join(own, [*keys, "state"], "left").withColumns({"effective_choices": F.exp("entropy"), "out_degree": F.coalesce("out_degree", F.lit(0))}).select(
        *keys, "state", "entropy", "hhi", "top_p", "effective_choices", "out_degree", "top_to"
    )


def exit_probabilities(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of each screen's steps that end the session."""
    out = probabilities(edges, keys).where(F.col("to_state") == C.EXIT).select(*keys, F.col("from_state").alias("state"), F.col("prob").alias("exit_prob"))
    return screens(edges, keys).join(out, [*keys, "state"], "left").withColumn("exit_prob", F.coalesce("exit_prob", F.lit(0.0)))


def pointwise_information(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """cnt, joint probability and pmi = ln(p(i,j) / (p(i) p(j))) of every edge, ends included."""
    c = counts(edges, keys)
    total = F.sum("cnt").over(Window.partitionBy(*(keys or [F.lit(1)])))
    out = F.sum("cnt").over(Window.partitionBy(*keys, "from_state"))
    into = F.sum("cnt").over(Window.partitionBy(*keys, "to_state"))
    return c.withColumns({"_t": total, "_o": out, "_i": into}).select(
        *keys, "from_state", "to_state", "cnt", (F.col("cnt") / F.col("_t")).alias("joint"), F.ln(F.col("cnt") * F.col("_t") / (F.col("_o") * F.col("_i"))).alias("pmi")
    )


# ---------------------------------------------------------------- dense chains


class Chain:
    """States in order, counts and row probabilities; a state without steps stays where it is."""

    def __init__(self, pdf: pd.DataFrame):
        names = set(pdf["from_state"]) | set(pdf["to_state"])
        middle = sorted(names - set(C.ENDS))
        self.states = [C.START] * (C.START in names) + middle + [C.EXIT] * (C.EXIT in names)
        self.at = {s: i for i, s in enumerate(self.states)}
        n = len(self.states)
        self.counts = np.zeros((n, n))
        np.add.at(self.counts, (pdf["from_state"].map(self.at).to_numpy(), pdf["to_state"].map(self.at).to_numpy()), pdf["cnt"].to_numpy(float))
        total = self.counts.sum(axis=1, keepdims=True)
        self.p = np.where(total > 0, self.counts / np.where(total > 0, total, 1), np.eye(n))
        self.screens = np.array([self.at[s] for s in middle], int)

    @property
    def names(self) -> list[str]:
        return [self.states[i] for i in self.screens]

    def reaching(self, targets: np.ndarray) -> np.ndarray:
        """States from which a target can be reached (the targets too)."""
        linked = self.p > 0
        found = targets.copy()
        while True:
            more = found | linked[:, found].any(axis=1)
            if np.array_equal(more, found):
                return found
            found = more

    def _walk(self, empty: str) -> np.ndarray:
        q = self.p[np.ix_(self.screens, self.screens)]
        total = q.sum(axis=1, keepdims=True)
        n = len(self.screens)
        rest = np.eye(n) if empty == "stay" else np.full((n, n), 1.0 / max(1, n))
        return np.where(total > 0, q / np.where(total > 0, total, 1), rest)

    def stationary(self) -> np.ndarray:
        """Share of time on each screen while sessions last: the least-norm solution if the chain falls apart."""
        n = len(self.screens)
        system = np.vstack([self._walk("stay").T - np.eye(n), np.ones(n)])
        return np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0]

    def pagerank(self, damping: float = 0.85) -> np.ndarray:
        w, n = self._walk("spread"), len(self.screens)
        rank = np.full(n, 1.0 / max(1, n))
        for _ in range(1000):
            new = (1 - damping) / n + damping * (w.T @ rank)
            if np.abs(new - rank).sum() < 1e-14:
                return new
            rank = new
        raise ValueError(f"page rank did not settle in 1000 rounds at damping {damping}")

    def next_steps(self) -> dict[str, object]:
        """What ``determinism`` says of each screen."""
        seen = self.counts[self.screens]
        left = seen.sum(axis=1) > 0
        p = np.where(left[:, None], self.p[self.screens], 0)
        entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
        known = {"entropy": entropy, "hhi": (p * p).sum(axis=1), "top_p": p.max(axis=1), "effective_choices": np.exp(entropy)}
        # States are in order, so the first of the largest is the one that ties go to.
        top = [self.states[i] if some else None for i, some in zip(seen.argmax(axis=1), left, strict=True)]
        return {k: np.where(left, v, np.nan) for k, v in known.items()} | {"out_degree": (seen > 0).sum(axis=1), "top_to": top}

    def expected_steps(self) -> np.ndarray:
        """Steps to EXIT of each screen; infinite where the session may get somewhere without a way out."""
        out = np.full(len(self.screens), np.inf)
        exits = np.array([s == C.EXIT for s in self.states])
        stuck = ~self.reaching(exits) if exits.any() else np.ones(len(self.states), bool)
        sound = ~self.reaching(stuck) if stuck.any() else np.ones(len(self.states), bool)
        good = self.screens[sound[self.screens]]
        if len(good):
            out[sound[self.screens]] = np.linalg.solve(np.eye(len(good)) - self.p[np.ix_(good, good)], np.ones(len(good)))
        return out

    def absorption(self, ends: Sequence[str] = (C.EXIT,)) -> tuple[list[str], np.ndarray]:
        """Transient states and their chances to end in each of ``ends``; not a number if some may never end."""
        missing = [e for e in ends if e not in self.at]
        if missing:
            raise KeyError(f"unknown state: {missing[0]!r}")
        kept = [i for i, s in enumerate(self.states) if s not in ends and s != C.START]
        try:
            b = np.linalg.solve(np.eye(len(kept)) - self.p[np.ix_(kept, kept)], self.p[np.ix_(kept, [self.at[e] for e in ends])])
        except np.linalg.LinAlgError:
            b = np.full((len(kept), len(ends)), np.nan)
        if not np.isfinite(b).all():
            b = np.full_like(b, np.nan)
        return [self.states[i] for i in kept], b

    def exit_within(self, k: int) -> np.ndarray:
        if k < 1:
            raise ValueError(f"a horizon is at least 1, not {k}")
        if C.EXIT not in self.at:
            return np.zeros(len(self.screens))
        e = self.at[C.EXIT]
        if self.counts[e].sum() > 0:
            raise ValueError("EXIT has steps that leave it: its column would mean being there at step k, not having got there")
        return np.linalg.matrix_power(self.p, k)[self.screens, e]

    def hits(self, source: str, target: str, most: int) -> np.ndarray:
        """Chance to have reached the target within 1..most steps: the target keeps what gets there."""
        for role, s in (("source", source), ("target", target)):
            if s not in self.at:
                raise KeyError(f"unknown {role} state: {s!r}")
        p = self.p.copy()
        t = self.at[target]
        p[t] = 0
        p[t, t] = 1
        row, out = np.eye(len(self.states))[self.at[source]], []
        for _ in range(most):
            row = row @ p
            out.append(row[t])
        return np.array(out)


def per_chain(edges: DataFrame, keys: Keys, solve: Callable[[Chain], pd.DataFrame], schema: str) -> DataFrame:
    """``solve`` for each chain; ``schema`` is that of its result without the keys."""
    c = counts(edges, keys)
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in c.schema}
    grouped = c.groupBy(*keys) if keys else c.groupBy(F.lit(0).alias("_one"))
    full = ", ".join([*(f"{k} {types[k]}" for k in keys), schema])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(Chain(pdf))
        for n, k in enumerate(keys):
            out.insert(n, k, pdf[k].iloc[0])
        return out

    return grouped.applyInPandas(run, full)


FLOW = (
    "state string, exit_prob double, pi double, expected_steps double, p_reach_exit double, pagerank double, visits double, "
    "entropy double, hhi double, top_p double, effective_choices double, out_degree long, top_to string, error string"
)


def flow(edges: DataFrame, keys: Keys = (), damping: float = 0.85, exit_within: Sequence[int] = ()) -> DataFrame:
    """Everything about each screen that needs its whole chain, in one pass; a chain that cannot be solved gives one row with ``error``."""
    more = "".join(f", p_exit_within_{k} double" for k in exit_within)

    def solve(chain: Chain) -> pd.DataFrame:
        try:
            if not len(chain.screens):
                raise ValueError("no screen in this chain")
            kept, reach = chain.absorption()
            reach_of = dict(zip(kept, reach[:, 0], strict=True))
            e = chain.at[C.EXIT]
            out = pd.DataFrame({
                "state": chain.names, "exit_prob": chain.p[chain.screens, e], "pi": chain.stationary(), "expected_steps": chain.expected_steps(),
                "p_reach_exit": [reach_of[s] for s in chain.names], "pagerank": chain.pagerank(damping), "visits": chain.counts[chain.screens].sum(axis=1),
                **chain.next_steps(), "error": None,
            })
            for k in exit_within:
                out[f"p_exit_within_{k}"] = chain.exit_within(k)
            return out
        except (ValueError, KeyError) as why:
            return pd.DataFrame([dict.fromkeys(part.split()[0] for part in (FLOW + more).split(", ")) | {"error": f"{type(why).__name__}: {why}"}])

    return per_chain(edges, keys, solve, FLOW + more)


def hit_curve(edges: DataFrame, source: str, target: str, most: int, keys: Keys = ()) -> DataFrame:
    def solve(chain: Chain) -> pd.DataFrame:
        try:
            p = chain.hits(source, target, most)
            return pd.DataFrame({"k": np.arange(1, most + 1), "p_hit_within": p, "error": None})
        except KeyError as why:
            return pd.DataFrame([{"k": 0, "p_hit_within": np.nan, "error": f"KeyError: {why}"}])

    return per_chain(edges, keys, solve, "k int, p_hit_within double, error string")
