import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import mixing

from .conftest import long_text


def corpus(docs, n=400, **more):
    rng = np.random.default_rng(2)
    src = rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])
    lang = rng.choice(["en", "de"], n, p=[0.8, 0.2])
    return docs(*[(i, long_text(int(rng.integers(5, 60)), i) + (" see http://x" if i % 3 == 0 else ""), str(lang[i]), str(src[i])) for i in range(n)], **more)


def test_raking_meets_the_shares():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 100, 24).astype(float)
    g = [np.arange(24) % 3, np.arange(24) // 3 % 4, np.arange(24) // 12]
    shares = [np.array([0.5, 0.3, 0.2]), np.full(4, 0.25), np.array([0.6, 0.4])]
    w = mixing.rake(t, g, shares)
    assert (w <= t).all()
    for k, s in zip(g, shares, strict=True):
        assert np.bincount(k, w) / w.sum() == pytest.approx(s, abs=2 * mixing.NEAR)
    # Without a bound that is reached, plain proportional fitting: weights over tokens are a product of one factor for each group.
    small = mixing.rake(t, g, shares, keep=0.05)
    assert (small < t).all() and small.sum() == pytest.approx(0.05 * t.sum(), rel=1e-3)
    design = np.column_stack([np.eye(n)[k] for k, n in zip(g, (3, 4, 2), strict=True)])
    y = np.log(small / t)
    assert design @ np.linalg.lstsq(design, y, rcond=None)[0] == pytest.approx(y, abs=1e-9)
    with pytest.raises(ValueError, match="none larger than"):
        mixing.rake(t, g, shares, keep=0.99)


def marks(df, topic=None):
    return mixing._marked(df, topic, df["doc_id"])


def shares_of(rows, weight="tokens"):
    """For each axis: each group's share of ``weight`` in rows of (axes, weight)."""
    out = {}
    for a in mixing.AXES:
        sums = {}
        for r in rows:
            sums[r[a]] = sums.get(r[a], 0) + r[weight]
        whole = sum(sums.values())
        out[a] = {k: v / whole for k, v in sums.items()}
    return out


def aims_of(rows, weight="tokens"):
    out = {}
    for a, held in shares_of(rows, weight).items():
        raised = {k: v ** mixing.POWERS[a] for k, v in held.items()}
        out[a] = {k: v / sum(raised.values()) for k, v in raised.items()}
    return out


def test_driver_and_table_rake_alike(docs):
    df = marks(corpus(docs)).cache()
    got = {}
    for most in (mixing.MOST_CELLS, 0):
        table, small = mixing.cell_probabilities(df, most_cells=most)
        assert small == bool(most)
        rows = table.collect()
        for a, aim in aims_of(rows).items():
            assert shares_of(rows, "weight")[a] == pytest.approx(aim, abs=2 * mixing.NEAR)
        assert all(0 <= r["p"] <= 1 and r["weight"] <= r["tokens"] for r in rows)
        got[most] = {tuple(r[a] for a in mixing.AXES): (r["weight"], r["p"]) for r in rows}
    small, large = got.values()
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k], rel=1e-9) for k in small)


def test_the_sample_has_the_target_shares_on_all_of_the_documents(spark):
    rows = mixing.probabilities(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    assert len(rows) == 10_000
    drawn = shares_of([r for r in rows if r["sampled"]], "n_tokens")
    for a, aim in aims_of(rows, "n_tokens").items():
        assert drawn[a] == pytest.approx(aim, abs=0.01), a
    kept, whole = (sum(r["n_tokens"] for r in x) for x in ([r for r in rows if r["sampled"]], rows))
    assert kept / whole > 0.15


def test_the_pipeline_draws_by_the_shares(docs):
    df = corpus(docs, 3000)
    drawn = shares_of(marks(corpus_pipeline.mix_sources(df.sparkSession, df, "")).collect())
    for a, aim in aims_of(marks(df).collect()).items():
        assert drawn[a] == pytest.approx(aim, abs=0.01)


def test_given_targets_and_topics(docs):
    df = corpus(docs, 2000).withColumn("kind", F.when(F.col("doc_id") % 4 == 0, "x").when(F.col("doc_id") % 4 == 1, "y"))
    targets = {"source": {"a": 1, "b": 1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.3, "y": 0.3, "none": 0.4}}
    rows = mixing.probabilities(df, targets=targets, topic="kind", keep=0.1).collect()
    drawn = [r for r in rows if r["sampled"]]
    got = shares_of(drawn, "n_tokens")
    assert got["source"] == pytest.approx({"a": 0.5, "b": 0.5}, abs=0.02) and got["lang"] == pytest.approx(targets["lang"], abs=0.02) and got["topic"] == pytest.approx(targets["topic"], abs=0.02)
    assert sum(r["n_tokens"] for r in drawn) / sum(r["n_tokens"] for r in rows) == pytest.approx(0.1, abs=0.01)
    for most in (mixing.MOST_CELLS, 0):
        with pytest.raises(ValueError, match="none larger than"):
            mixing.probabilities(df, targets=targets, topic="kind", keep=0.9, most_cells=most)
        with pytest.raises(ValueError, match="no tokens of zz"):
            mixing.probabilities(df, targets={"lang": {"zz": 1.0}}, most_cells=most)


def test_odd_documents(odd, odd_clashing, docs):
    a = sorted(mixing.probabilities(odd).collect(), key=str)
    assert a == sorted(mixing.probabilities(odd_clashing).collect(), key=str) and len(a) == odd.count()
    assert {(r["source"], r["lang"]) for r in a if r["doc_id"] == 7} == {("none", "none")}
    assert all(0 <= r["p"] <= 1 for r in a)
    assert mixing.probabilities(docs().limit(0)).count() == 0 and mixing.draw(docs().limit(0)).count() == 0
    blank = docs((1, None), (2, " "))
    assert {(r["p"], r["sampled"]) for r in mixing.probabilities(blank).collect()} == {(1.0, True)}


def test_drawn_rows_are_as_they_were(docs):
    names = ("__source", "__lang", "__topic", "__tokens", "__p", "topic", "tokens", "u", "p", "row", "weight", "step", "sampled")
    df = corpus(docs, 300).withColumns({c: F.concat(F.lit("mine "), F.col("doc_id")) for c in names})
    out = mixing.draw(df)
    assert out.columns == df.columns and 0 < out.count() < 300
    assert out.subtract(df).count() == 0
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in mixing.probabilities(df).where("sampled").collect()}


def test_a_long_text(docs):
    df = docs((1, long_text(300_000), "en", "a"), *[(i, long_text(50, i), "en", "b") for i in range(2, 40)])
    rows = {r["doc_id"]: r for r in mixing.probabilities(df).collect()}
    assert rows[1]["n_tokens"] == 300_000 and len(rows) == 39


def test_topics(docs):
    rows = docs((1, "Licensed under a License"), (2, "mail a@b"), (3, "the year 1999"), (4, "plain"), (5, None))
    assert {r["doc_id"]: r["topic"] for r in mixing.probabilities(rows).collect()} == {1: "legal", 2: "web", 3: "figures", 4: "prose", 5: "prose"}
