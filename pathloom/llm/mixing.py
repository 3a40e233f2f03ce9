r"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells by source, language and topic.  The cells' token
weights are raked: scaled in turn to the target shares of sources, of languages
and of topics.  As documents are not repeated, no cell can weigh more than its
tokens, and weights are cut there in every step.  Raking goes on until each
group's share is met within ``NEAR`` of all; if ``ROUNDS`` do not get there the
share of tokens to keep is made smaller by ``STEP``, as long as some cell is cut
at its tokens.  With ``keep`` None the first share tried is the largest that every
group by itself can give.

Calibrated probabilities.  A document has a number from 0 to 1, the hash of its
id, and is drawn if that is below its cell's probability.  The probability is the
one of ``BINS`` steps at which the tokens drawn come nearest to the cell's weight,
found from the tokens by cell and step, so that the sample itself has the shares,
not only its expectation.

Target shares are given (``targets``: for each axis the share of each group, those
that are left out get none) or made from the data: a group's share of tokens to
the axis's power in ``POWERS``.  The topic is a column's value, or by default the
first of the patterns ``TOPICS`` that the text holds.

Cells are counted on the cluster (combined before the shuffle).  Up to
``MOST_CELLS`` of them are raked on the driver; more are raked as a table, by the
same steps, with the same results.

Defined cases: a null source, language or topic is the group ``none``; a null text
has no words; documents without words are drawn as their cell is, and always if
it has no words at all; equal ids have one fate, a null id has that of its text;
of equally near probabilities the larger one is taken; a very long text is one
document of many tokens; an empty table gives an empty one; shares made from the
data that contradict one another (each source has one language, say) are met as
far as raking goes, the last axis best; given ones that no sample has raise
ValueError, with the largest share that can be kept if there is one; other columns, whatever their names, are ignored by ``probabilities`` and kept by
``draw``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST_CELLS = 100_000
#: Rounds for a share of the tokens, deviation of a group's share that ends them, ratio of the next share, shares tried.
ROUNDS = 60
NEAR = 1e-4
STEP = 0.98
TRIES = 300
BINS = 1024
AXES = ("source", "lang", "topic")
#: Target share of a group: its share of tokens to this power, made to sum to 1.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
WORD = r"[^\x20\x09-\x0D]+"
#: The first pattern that a text holds names its topic.
TOPICS = (("legal", "[Ll]icense|LICENSE|[Cc]opyright|COPYRIGHT"), ("web", "@|https?://|www\\."), ("figures", "[0-9]{3}"))
REST = "prose"
NONE = "none"
Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    out = F.lit(REST)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def uniform(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1, below 1, from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def _marked(docs: DataFrame, topic: str | None, *more: Column) -> DataFrame:
    """source, lang, topic, tokens, u and ``more`` for every row of ``docs``."""
    group = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.select(
        group(docs["source"]).alias("source"), group(docs["lang"]).alias("lang"), (group(docs[topic]) if topic else topic_of(docs["text"])).alias("topic"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), uniform(docs["doc_id"], docs["text"]).alias("u"), *more,
    )


def _shares(totals: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    """The target share of each group; all add up to 1."""
    if given is not None:
        unmet = [k for k, v in given.items() if v > 0 and not totals.get(k)]
        if unmet:
            raise ValueError(f"no sample has the target shares: no tokens of {', '.join(sorted(unmet))}")
    raised = {k: float(given.get(k, 0.0)) if given is not None else v**power if v else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def _tries(largest: float, keep: float | None):
    """Shares of the tokens to try one after another."""
    if keep is None:
        return (largest * STEP**k for k in range(TRIES))
    if keep > largest * (1 + 1e-9):
        raise ValueError(f"a sample of {keep:.6g} of the tokens does not have the target shares; none larger than {largest:.6g} has")
    return (min(keep, largest),)


def _unmet(keep: float | None, given: bool, cut: bool) -> None:
    """What raking leaves is refused, but for shares made from the data that contradict one another."""
    if cut and keep is not None:
        raise ValueError(f"a sample of {keep:.6g} of the tokens does not have the target shares; try a smaller one")
    if given or cut:
        raise ValueError("no share of the tokens has the target shares")


def rake(tokens: np.ndarray, groups: list[np.ndarray], shares: list[np.ndarray], keep: float | None = None, given: bool = True) -> np.ndarray:
    """Cell weights of at most the cell's tokens that have the shares of each grouping (cells hold group numbers).

    Not ``given``: the shares are made from the data.
    """
    total = tokens.sum()
    if not total:
        return tokens.astype(float)
    held = [np.bincount(g, tokens, minlength=len(s)) for g, s in zip(groups, shares, strict=True)]
    largest = min(float((h[s > 0] / s[s > 0]).min()) for h, s in zip(held, shares, strict=True)) / total
    for kept in _tries(largest, keep):
        w = tokens * kept
        for _ in range(ROUNDS):
            off = 0.0
            for g, share in zip(groups, shares, strict=True):
                now = np.bincount(g, w, minlength=len(share))
                off = max(off, np.abs(now - share * kept * total).max() / (kept * total))
                w = np.minimum(tokens, w * np.where(now[g] > 0, share[g] * kept * total / np.where(now[g] > 0, now[g], 1), 0))
            if off <= NEAR:
                return w
        cut = bool((w >= tokens)[tokens > 0].any())
        if not cut:
            break
    _unmet(keep, given, cut)
    return w


def _weights(counted: DataFrame, keep: float | None, targets: Targets, most_cells: int) -> tuple[DataFrame, bool]:
    """source, lang, topic, tokens, weight of every cell; whether that is a small table."""
    if counted.count() > most_cells:
        return _raked_table(counted, keep, targets), False
    rows = counted.orderBy(*AXES).collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    groups, shares = [], []
    for axis in AXES:
        names = sorted({r[axis] for r in rows})
        at = {k: i for i, k in enumerate(names)}
        g = np.array([at[r[axis]] for r in rows], np.int64)
        share = _shares(dict(zip(names, np.bincount(g, tokens, minlength=len(names)).tolist(), strict=True)), targets.get(axis), POWERS[axis])
        groups.append(g)
        shares.append(np.array([share[k] for k in names]))
    out = [(*(r[a] for a in AXES), r["tokens"], float(x)) for r, x in zip(rows, rake(tokens, groups, shares, keep, bool(targets)), strict=True)]
    return counted.sparkSession.createDataFrame(out, "source string, lang string, topic string, tokens long, weight double").coalesce(1), True


def _raked_table(counted: DataFrame, keep: float | None, targets: Targets) -> DataFrame:
    """The steps of ``rake`` over a table of cells: marginals are aggregated and joined back, once a step."""
    total = float(counted.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return counted.withColumn("weight", F.lit(0.0))
    aims, largest = {}, np.inf
    for axis in AXES:
        held = counted.groupBy(axis).agg(F.sum("tokens").cast("double").alias("held"))
        if axis in targets:
            wanted = counted.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[axis].items()], f"{axis} string, raised double")
            unmet = [r[axis] for r in wanted.where("raised > 0").join(held.where("held > 0"), axis, "left_anti").collect()]
            if unmet:
                raise ValueError(f"no sample has the target shares: no tokens of {', '.join(sorted(unmet))}")
            held = held.join(wanted, axis, "left").select(axis, "held", F.coalesce("raised", F.lit(0.0)).alias("raised"))
        else:
            held = held.withColumn("raised", F.when(F.col("held") > 0, F.pow("held", F.lit(POWERS[axis]))).otherwise(0.0))
        held = common.stored(held, "mix-aims")
        whole = held.agg(F.sum("raised")).first()[0] or 1.0
        aims[axis] = held.select(axis, "held", (F.col("raised") / whole * total).alias("aim"))
        largest = min(largest, aims[axis].agg(F.min(F.when(F.col("aim") > 0, F.col("held") / F.col("aim")))).first()[0])
    for kept in _tries(largest, keep):
        w = counted.withColumn("weight", F.col("tokens") * F.lit(kept))
        for _ in range(ROUNDS):
            off = 0.0
            for a in AXES:
                aim = F.col("aim") * F.lit(kept)
                now = common.stored(w.groupBy(a).agg(F.sum("weight").alias("now")).join(aims[a], a).select(a, (F.col("now") - aim).alias("off"), F.when(F.col("now") > 0, aim / F.col("now")).otherwise(0.0).alias("scale")), "mix-scale")
                off = max(off, now.agg(F.max(F.abs("off"))).first()[0] / (kept * total))
                w = w.join(now, a).withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("scale"))).select(*AXES, "tokens", "weight")
            w = common.stored(w, "mix-weights")
            if off <= NEAR:
                return w
        cut = not w.where("tokens > 0 and weight >= tokens").isEmpty()
        if not cut:
            break
    _unmet(keep, bool(targets), cut)
    return w


def cell_probabilities(marked: DataFrame, keep: float | None = None, targets: Targets | None = None, most_cells: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """source, lang, topic, tokens, weight and p for every cell of marked documents; whether the table is small."""
    step = F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1)).cast("int")
    bins = common.stored(marked.groupBy(*AXES, step.alias("step")).agg(F.sum("tokens").alias("tokens")), "mix-bins")
    counted = common.stored(bins.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    weights, small = _weights(counted, keep, targets or {}, most_cells)
    # A cell has BINS rows at most: probabilities and the tokens that they draw; none and all besides.
    upto = F.sum("tokens").over(Window.partitionBy(*AXES).orderBy("step"))
    drawn = bins.select(*AXES, ((F.col("step") + 1) / F.lit(float(BINS))).alias("p"), upto.alias("drawn"))
    ends = counted.select(*AXES, F.explode(F.array(F.struct(F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("drawn")), F.struct(F.lit(1.0).alias("p"), F.col("tokens").alias("drawn")))).alias("x")).select(*AXES, "x.p", "x.drawn")
    nearest = F.min(F.struct(F.abs(F.col("drawn") - F.col("weight")).alias("off"), (-F.col("p")).alias("less"))).alias("best")
    chosen = (
        drawn.unionByName(ends).join(F.broadcast(weights) if small else weights, list(AXES)).groupBy(*AXES, "tokens", "weight").agg(nearest)
        .select(*AXES, "tokens", "weight", F.when(F.col("tokens") > 0, -F.col("best.less")).otherwise(1.0).alias("p"))
    )
    return common.stored(chosen, "mix-chosen"), small


def _with_p(marked: DataFrame, keep: float | None, targets: Targets | None, most_cells: int) -> DataFrame:
    table, small = cell_probabilities(marked, keep, targets, most_cells)
    p = table.select(*AXES, "p")
    return marked.join(F.broadcast(p) if small else p, list(AXES))


def probabilities(docs: DataFrame, keep: float | None = None, targets: Targets | None = None, topic: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p and sampled for every document."""
    marked = common.stored(_marked(docs, topic, docs["doc_id"]), "mix-marked")
    return _with_p(marked, keep, targets, most_cells).select("doc_id", *AXES, F.col("tokens").alias("n_tokens"), "p", (F.col("u") < F.col("p")).alias("sampled"))


def draw(docs: DataFrame, keep: float | None = None, targets: Targets | None = None, topic: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows of ``docs`` that are drawn; all columns as they are."""
    # The row is one column, so that its names are its own; stored, so that texts are searched once.
    marked = common.stored(_marked(docs, topic, F.struct(*[docs[c] for c in docs.columns]).alias("row")), "mix-marked")
    return _with_p(marked, keep, targets, most_cells).where(F.col("u") < F.col("p")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
