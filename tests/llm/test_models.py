"""Classifiers: odd inputs, held-out accuracy, what the methods promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import common, langid, quality, queries, toxicity

from .conftest import long_text

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    return {r["doc_id"]: r for r in common.table(spark, DATA, "labels").collect()}, {r["doc_id"]: r["lang"] for r in common.table(spark, DATA, "documents").select("doc_id", "lang").collect()}


def test_language_held_out(spark, truth):
    rows = queries.language_id(spark, DATA).where("held_out").collect()
    assert len(rows) > 300 and np.mean([r["lang_pred"] == truth[1][r["doc_id"]] for r in rows]) > 0.97


def test_toxicity_held_out(spark, truth):
    rows = [r for r in queries.toxicity_lexicon(spark, DATA).where("held_out").collect() if r["doc_id"] in truth[0]]
    y = [truth[0][r["doc_id"]]["toxic"] for r in rows]
    assert np.mean([r["predicted"] == t for r, t in zip(rows, y, strict=True)]) > 0.9


def test_quality_held_out(spark, truth):
    rows = [r for r in queries.quality_pairs(spark, DATA).where("held_out").collect() if r["doc_id"] in truth[0]]
    assert np.mean([r["predicted"] == truth[0][r["doc_id"]]["quality"] for r in rows]) > 0.95


@pytest.fixture
def tongues(docs):
    rng = random.Random(0)
    words = {"aa": "ka lo mi tu".split(), "bb": "ze xi qu wy".split()}
    return docs(*[(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "web") for i, k in enumerate(["aa", "bb"] * 20)])


def test_language_of_odd_documents(tongues, odd, odd_clashing, docs):
    model = langid.fit(tongues)
    for df in (odd, odd_clashing):
        got = langid.predict(df, model).collect()
        assert len(got) == df.count()
        und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
        assert und == {1, 2, 3, 4} and all(0 <= r["score"] <= 1 for r in got)
        kept = langid.keep_identified(df, model, 0.0)
        assert kept.columns == df.columns and kept.count() == df.count() - 4
    assert langid.predict(docs().limit(0), model).count() == 0
    nothing = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.fit(odd.where("lang is null")).langs == []


def test_blocks_change_no_score(tongues, monkeypatch):
    model = langid.fit(tongues)
    texts = [("ka ze lo " * 300), "ze", "mi tu qu"]
    whole = langid.score_texts(model, texts)
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = langid.score_texts(model, texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_scores_are_those_of_the_counts(tongues):
    """One text by hand: prior plus the log-probability of each n-gram."""
    model = langid.fit(tongues)
    text = "ka zeb"
    codes = langid._codes(text)
    total = model.prior.copy()
    for n in range(1, model.max_n + 1):
        for h in langid._hashes(codes, n, model.bits):
            total += model.logp[h]
    p = np.exp(total - total.max())
    lang, score = langid.score_texts(model, [text])
    assert lang[0] == model.langs[p.argmax()] and score[0] == pytest.approx(p.max() / p.sum())


# ---------------------------------------------------------------- toxicity


@pytest.mark.parametrize(("text", "want"), [
    ("An IDIOT!", " an idiot "), ("1d10t and id10ts", " idiot and idiots "), ("ідіоt", " iдiot "[:0] + " iдiot "), ("ｉｄｉｏｔ", " idiot "), ("a​b", " ab "), ("tr@sh $cum lo$er", " trash cum loser "), ("  ", "  "), ("12 45.7", "  "), ("naïve café", " naive cafe "), ("i\u0301di\u0323ot", " idiot "), ("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", " idiot "), ("Straße ﬁne", " straße fine "),
])
def test_folding(text, want):
    assert toxicity.fold(text) == want


def test_longest_entry_and_exceptions():
    lex = toxicity.Lexicon({" bad": 2.0, " badger ": 5.0, " ugly ": 1.0}, frozenset({" not bad ", " ugly duckling "}))
    find = lambda t: sorted(e for _, _, e in lex.matches(toxicity.fold(t)))
    assert find("badly badger") == [" bad", " badger "]
    assert find("not bad, ugly duckling") == [] and find("bad ugly") == [" bad", " ugly "]
    assert toxicity.Lexicon({}).matches(" x ") == []


@pytest.fixture
def rude(docs):
    rng = random.Random(1)
    words = [long_text(1, s) for s in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(40)]
        t = i % 5 == 0
        if t:
            for k in rng.sample(range(40), 4):
                w[k] = rng.choice(["snark", "snarkish", "boo"])
        elif i % 5 == 1:
            w[3:5] = ["hunting", "snark"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(t)))
    return docs(*rows), labels


def test_learned_lexicon(rude, spark, odd, odd_clashing):
    docs, labels = rude
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.fit(docs, lab)
    assert " hunting snark " in lex.phrases and any(e.startswith(" boo") for e in lex.entries)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lex).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in labels]) > 0.98
    for df in (odd, odd_clashing):
        rows = toxicity.score(df, lex).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] < 0.5 for r in rows)
    # Disguise does not help; length dilutes.
    assert lex.score(["you b00 snаrk 5nark boo"])[0] > 0.5
    plain, padded = lex.score(["boo snark", "boo snark " + "calm " * 3000])
    assert padded < plain


def test_labels_of_one_class_or_none(docs, spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for fit, score in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        assert {r["score"] for r in score(odd, fit(odd, none)).collect()} == {0.0}
        assert {r["score"] for r in score(odd, fit(odd, one)).collect()} == {1.0}


# ---------------------------------------------------------------- quality


def test_pairs_rank(spark, docs, odd, odd_clashing):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        text = long_text(60, i)
        if i % 4 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    df = docs(*rows)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert all((got[i] >= quality.THRESHOLD) == bool(q) for i, q in labels)
    for d in (odd, odd_clashing):
        out = quality.score(d, model).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)
    x = rng.normal(size=(200, 3))
    w = quality.bradley_terry(np.column_stack([x, np.ones(200)]), x[:, 0] > 0, 2000)
    assert w[0] > 0 and abs(w[1]) < w[0] / 3 and w[3] == 0


def test_features_have_one_width():
    for t in (None, b"", b" ", "é".encode(), long_text(500).encode(), b"\n\n", b"\xff"):
        x = quality.features(t)
        assert len(x) == quality.WIDTH and np.isfinite(x).all()


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert spark.range(1).select(common.fold_of(F.lit(None).cast("long"), 3)).first()[0] == 0


def test_samples_are_bounded(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    one = common.bounded_sample(df, "k", 100)
    assert {(r["k"], r["count"]) for r in one.groupBy("k").count().collect()} == {(0, 100), (1, 100), (2, 100)}
    # The ids with the least hashes, however often a row is there.
    again = common.bounded_sample(df.unionByName(df.where("doc_id < 10000")).unionByName(spark.range(5).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("k"))), "k", 100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    few = common.bounded_sample(df.where("doc_id < 20"), "k", 100)
    assert few.count() == 20


def test_every_language_stays(docs, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 40 * 4 * 1024)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i:03}", "web") for i in range(40)]
    model = langid.fit(docs(*rows))
    assert len(model.langs) == 40 and model.bits == 10 and model.logp.nbytes <= langid.MODEL_BYTES
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(*rows), model).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) >= 36


def test_language_counts_by_brute_force(spark, tongues):
    """The model's probabilities from counts made one n-gram at a time."""
    model = langid.fit(tongues, bits=12)
    assert model.langs == ["aa", "bb"]
    seen = {k: np.zeros(1 << 12) for k in model.langs}
    for r in tongues.collect():
        text = f" {r['text'].lower()} "
        for n in (1, 2, 3):
            for k in range(len(text) - n + 1):
                seen[r["lang"]][langid._hashes(np.frombuffer(text[k : k + n].encode("utf-32-le"), np.uint32), n, 12)[0]] += 1
    for k, lang in enumerate(model.langs):
        want = np.log((seen[lang] + 0.5) / (seen[lang].sum() + 0.5 * (1 << 12)))
        assert model.logp[:, k] == pytest.approx(want, abs=1e-5)
    assert model.prior == pytest.approx(np.log([0.5, 0.5]))


def test_lexicon_by_brute_force(rude, spark):
    """Scores from the lexicon without an automaton: each word's longest entry, but for words that a phrase covers."""
    docs, labels = rude
    lex = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lex).collect()}
    for r in docs.collect():
        words = toxicity.fold(r["text"]).split()
        covered = {j for k in range(len(words) - 1) if f" {words[k]} {words[k + 1]} " in lex.phrases for j in (k, k + 1)}
        found = []
        for k, w in enumerate(words):
            fits = [e for e in lex.entries if f" {w} ".startswith(e)]
            if fits and k not in covered:
                found.append(max(fits, key=len))
        total = sum(lex.entries[e] for e in found)
        x = np.array([np.log1p(total), np.log1p(100 * total / max(1, len(words))), np.log1p(len(set(found))), 1.0]) if found else np.array([0, 0, 0, 1.0])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-x @ lex.model)), abs=1e-9)


def test_weights_by_brute_force(rude, spark):
    """Entries and weights from occurrences counted one by one."""
    docs, labels = rude
    lex = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic = dict(labels)
    rows = [(toxicity.fold(r["text"]), toxic[r["doc_id"]]) for r in docs.collect()]
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    for entry, weight in lex.entries.items():
        c, t = (sum(min(5, sum(f" {w} ".startswith(entry) for w in text.split())) for text, y in rows if y == k) for k in (0, 1))
        assert weight == pytest.approx(np.log((t + 0.5) / (n[1] + 1)) - np.log((c + 0.5) / (n[0] + 1)))


def test_matching_goes_with_the_length():
    """Twice as many phrases and words in a text take about twice as long, not four times."""
    import time

    lex = toxicity.Lexicon({" bad": 2.0}, frozenset({" not bad "}))
    text = toxicity.fold("not bad " * 200_000)
    began = time.process_time()
    assert lex.matches(text) == []
    assert time.process_time() - began < 5


def test_pairs_by_brute_force():
    """Weights of the pairwise loss found by plain gradient descent."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(60, 3)), np.ones(60)])
    good = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=60) > 0
    w = quality.bradley_terry(x, good, 500, l2=1.0)
    rng = np.random.default_rng(7)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    n = min(500, 20 * max(len(a), len(b)))
    z = (x[:, :3] - x[:, :3].mean(axis=0)) / x[:, :3].std(axis=0)
    d = z[rng.choice(a, n)] - z[rng.choice(b, n)]
    v = np.zeros(3)
    for _ in range(20_000):
        v -= 0.001 * (-(2 * d.T @ (1 / (1 + np.exp(d @ v)))) + v)
    assert w[:3] * x[:, :3].std(axis=0) == pytest.approx(v, abs=1e-4)


def test_long_texts_and_empty_tables(rude, tongues, spark, docs):
    df, labels = rude
    tox = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    good = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    lang = langid.fit(tongues)
    long = docs((1, long_text(200_000) + " snark boo snarkish" * 2000), (2, "ka lo mi " * 300_000))
    for score, model in ((toxicity.score, tox), (quality.score, good), (langid.predict, lang)):
        assert {r["doc_id"] for r in score(long, model).collect()} == {1, 2}
        assert score(docs().limit(0), model).count() == 0
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(long, lang).collect()}[2] == "aa"


def test_rows_of_one_id_are_learned_from_once(docs, spark):
    rows = [(5, "some text of one id")] * 300 + [(i, f"text {i}") for i in range(6, 20)]
    sample = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, label int")
    assert sorted(map(tuple, common.sample_texts(docs(*rows), sample, "label").collect())) == [("some text of one id", 1), ("text 6", 0)]


def test_slopes_of_all_pairs_by_brute_force():
    """Gradient and curvature from moments by cell, against a list of all pairs."""
    rng = np.random.default_rng(3)
    z, v = rng.normal(size=(300, 5)), np.array([3.0, -2.0, 0.5, 0.0, 9.0])
    z[0] *= 100
    side = ({}, {})
    label = (rng.random(300) < 0.4).astype(int)
    for k in (0, 1):
        # Two batches meet in a cell.
        for at in (slice(0, 140), slice(140, 300)):
            some = z[at][label[at] == k]
            for c, m in quality.moments(some, some @ v):
                side[k][c] = side[k].get(c, 0) + m
    got = quality.pair_slopes(side[1], side[0], 5)
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, 5)
    p = 1 / (1 + np.exp(d @ v))
    assert got[0] == pytest.approx(-(p @ d), rel=1e-9, abs=1e-7)
    assert got[1] == pytest.approx((d * (p * (1 - p))[:, None]).T @ d, rel=1e-9, abs=1e-7)


def test_quality_learns_from_every_pair(docs, spark):
    """Weights and cut of a fit against those of all pairs, listed; labels overlap, so that each pair tells."""
    rng = random.Random(4)
    rows = [(i, long_text(rng.randint(5, 60), i).upper()[: rng.randint(0, 90)] + long_text(rng.randint(5, 60), i + 1000)) for i in range(120)]
    labels = [(i, int(rng.random() < (0.8 if t[:1].islower() or i % 3 else 0.3))) for i, t in rows]
    model = quality.fit(docs(*rows), spark.createDataFrame([*labels, *labels[:7], (999, 1)], "doc_id long, quality int"))
    x = np.array([quality.features(t.encode()) for _, t in rows])
    good = np.array([k for _, k in labels]) > 0
    spread = x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = (x - x.mean(axis=0)) / spread
    d = (z[good][:, None] - z[~good][None]).reshape(-1, quality.WIDTH)
    weight, v = 2 * min(60_000, 20 * max(good.sum(), (~good).sum())) / len(d), np.zeros(quality.WIDTH)
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ v))
        v -= np.linalg.solve(weight * (d * (p * (1 - p))[:, None]).T @ d + np.eye(len(v)), v - weight * (p @ d)) * 0.7
    assert model.weights * np.where(np.isinf(spread), 0, spread) == pytest.approx(v, abs=1e-6)
    s, bad = np.sort(x @ model.weights), int((~good).sum())
    assert model.cut == pytest.approx((s[bad - 1] + s[bad]) / 2, abs=1e-9)


def test_quality_cut_counts_every_document(spark):
    """More labels than any sample held: as many documents fall below the cut as are labelled bad."""
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.substring(F.sha2(F.col("id").cast("string"), 512), 1, (20 + F.col("id") % 97).cast("int")), F.upper(F.sha2((F.col("id") + 7).cast("string"), 256))).alias("text"))
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(100)) < 20 + 60 * (F.col("doc_id") % 97 > 40).cast("int")).cast("int").alias("quality"))
    got = quality.score(docs, quality.fit(docs, labels))
    assert got.where(F.col("score") < quality.THRESHOLD).count() == labels.where("quality = 0").count()


def test_middle_of_scores(spark):
    rng = np.random.default_rng(6)
    s = np.concatenate([rng.normal(size=40) * 10.0 ** rng.integers(-9, 9, 40), [0.0, -0.0, 0.5, 0.5, 0.5, 3.0]])
    rows = spark.createDataFrame([([float(v)], 0) for v in s], "x array<double>, label int")
    scored = quality._scored(rows, np.ones(1)).cache()
    s = np.sort(s)
    for n in range(1, len(s)):
        if n % 5 == 0 or s[n] == 0.5 or s[n] == 0:
            assert quality.middle(scored, n) == (s[n - 1] + s[n]) / 2
    scored.unpersist()


def test_newton_settles(spark):
    """The slope of scores that stand apart is found to the end; a step that would overshoot for ever is halved."""
    rows = spark.range(4000).select((F.col("id") / 100 - 20 + F.when(F.col("id") < 2000, -0.2).otherwise(0.2)).alias("s"), (F.col("id") >= 2000).cast("int").alias("label"))
    t, y = np.array(rows.collect()).T
    w = np.zeros(2)
    x = np.column_stack([t - 0.005, np.ones(4000)])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w -= 0.3 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6]), x.T @ (p - y) + np.array([1e-3, 1e-6]) * w)
    assert quality._slope(rows, 0.005) == pytest.approx(w[0], rel=1e-6)
    # Newton's own steps from 0 to 7 would land ever farther off on the other side.
    assert quality.newton(1, lambda v: ((v - 7) / np.sqrt(1 + (v - 7) ** 2), np.diag((1 + (v - 7) ** 2) ** -1.5))) == pytest.approx(7)
