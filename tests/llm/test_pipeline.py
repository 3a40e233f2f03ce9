"""The whole pipeline against a plain version of every stage, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pathloom.llm import mixing, queries

from .conftest import CLASHING, ODD, SCHEMA
from .test_decontam import words
from .test_simhash import plain_components, plain_fingerprint

ITEMS = [(1, "ka lo mi tu pa ne ro si va do ke"), (2, "zu zu"), (None, "ka"), (4, None)]
TONGUES = {"aa": "ka lo mi tu pa ne ro si va do ke".split(), "bb": "zex xiq quw wyz zuq exu qix uwy yzu xeq".split()}


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(1, 121):
        lang = ("aa", "bb")[i % 3 == 0]
        text = " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(8, 40)))
        text += (" 123", " www.x", "", "", "")[i % 5]
        rows.append((i, text, lang, f"s{i % 4}"))
    copies = [(200 + k, rows[k % 7][1], rows[k % 7][2], "s0") for k in range(30)]
    near = [(300 + k, rows[20 + k][1] + " " + TONGUES["aa"][k], rows[20 + k][2], None) for k in range(6)]
    leaks = [(400 + k, f"mi mi {ITEMS[0][1].upper()} lo {k}", "aa", "s1") for k in range(3)] + [(410, "Zu, ZU zex quw", "bb", "s2"), (411, "zu lo zu mi pa", "aa", "s2")]
    others = [(500, None, "aa", "s0"), (501, "", None, None), (502, "12 34 !!", "aa", "s1"), (None, "ka lo mi ne without an id", None, "s3"), (1, rows[0][1], rows[0][2], "s1"), (600, "ka lo " * 10_000, "aa", "s3")]
    return rows + copies + near + leaks + others


def plain_languages(rows):
    counts, n_docs = defaultdict(Counter), Counter()
    grams = lambda t: [(n, f" {t.lower()} "[k : k + n]) for n in (1, 2, 3) for k in range(len(t) + 3 - n)]
    texts = {}
    for i, t, lang, _ in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            texts[i] = min(texts.get(i, (t, lang)), (t, lang))
    for t, lang in texts.values():
        if any(c.isalpha() for c in t):
            counts[lang].update(grams(t))
            n_docs[lang] += 1

    size = {a: math.log(c.total() + 0.5 * 65536) for a, c in counts.items()}

    def keep(t):
        if t is None or not any(c.isalpha() for c in t):
            return False
        g = Counter(grams(t))
        scores = sorted(math.log(n_docs[a]) + sum(n * (math.log(c[x] + 0.5) - size[a]) for x, n in g.items()) for a, c in counts.items())
        return 1 / sum(math.exp(s - scores[-1]) for s in scores) >= 0.5

    return [r for r in rows if keep(r[1])]


def plain_survivors(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    least = {}
    root = plain_components(prints)
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    out, seen = [], set()
    for r, c in zip(rows, root, strict=True):
        if r[0] is None or (least[c] == r[0] and r[0] not in seen):
            seen.add(r[0])
            out.append(r)
    return out


def plain_clean(rows):
    def leaks(t):
        ws = words(t)
        for name, text in ITEMS:
            iw = words(text) if name is not None else []
            n = min(10, len(iw))
            if n and any(ws[b] == iw[a] and ws[b : b + n] == iw[a : a + n] for a in range(len(iw) - n + 1) for b in range(len(ws) - n + 1)):
                return True
        return False

    return [r for r in rows if not leaks(r[1])]


def plain_sample(rows):
    def topic(t):
        return "legal" if any(x in t for x in ("License", "license", "LICENSE", "opyright", "COPYRIGHT")) else "web" if "@" in t or "http" in t or "www." in t else "figures" if any(t[k : k + 3].isdigit() for k in range(len(t) - 2)) else "prose"

    cells = defaultdict(list)
    for r in rows:
        name = str(r[0]) if r[0] is not None else r[1]
        cells[r[3] or "none", r[2] or "none", topic(r[1])].append((int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32, len(r[1].split()), r))
    tokens = {c: sum(n for _, n, _ in x) for c, x in cells.items()}
    total = sum(tokens.values())
    aims = []
    for k, axis in enumerate(mixing.AXES):
        held = Counter()
        for c, n in tokens.items():
            held[c[k]] += n
        raised = {g: n ** mixing.POWERS[axis] for g, n in held.items()}
        aims.append({g: x / sum(raised.values()) for g, x in raised.items()})
        aims[-1]["held"] = held
    kept = min(n / a[g] for a in aims for g, n in a["held"].items()) / total
    while True:
        w = {c: n * kept for c, n in tokens.items()}
        for _ in range(mixing.ROUNDS):
            off = 0.0
            for k, a in enumerate(aims):
                now = Counter()
                for c in w:
                    now[c[k]] += w[c]
                off = max(off, *(abs(now[g] - a[g] * kept * total) / (kept * total) for g in a["held"]))
                w = {c: min(tokens[c], x * a[c[k]] * kept * total / now[c[k]]) for c, x in w.items()}
            if off <= mixing.NEAR:
                break
        if off <= mixing.NEAR or not any(w[c] >= tokens[c] for c in w):
            break
        kept *= mixing.STEP
    out = []
    for c, docs in cells.items():
        p = min([k / mixing.BINS for k in range(mixing.BINS + 1)], key=lambda p: (abs(sum(n for u, n, _ in docs if u < p) - w[c]), -p))
        out += [r for u, _, r in docs if u < p]
    return out


def plain_ids(rows):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    out, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, items=ITEMS, more=()):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
        df.withColumns({c: F.lit("mine") for c in more}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def result(spark, at):
    return sorted((tuple(r) for r in corpus_pipeline.run(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_every_stage_by_brute_force(spark, folder):
    rows = corpus()
    at = folder(rows)
    docs = queries.table(spark, at, "documents")
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], (plain_languages, plain_survivors, plain_clean, plain_sample), strict=True):
        docs = corpus_pipeline.common.stored(stage(spark, docs, at), "stage")
        before, rows = rows, by_hand(rows)
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted((r[:2] for r in rows), key=str), name
        assert 0 < len(rows) < len(before), name
    assert result(spark, at) == plain_ids(rows)


def test_odd_rows_and_clashing_names(spark, folder):
    rows = [(i, t, *((more or ["aa", "s1"])[:2])) for i, t, *more in ODD] + corpus()[:60]
    at = folder(rows, more=CLASHING)
    docs = queries.table(spark, at, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.stored(stage(spark, docs, at), "stage")
        assert out.columns == docs.columns and out.count() > 0, name
        assert out.where(" or ".join(f"`{c}` is distinct from 'mine'" for c in CLASHING)).isEmpty(), name
        assert out.subtract(docs).isEmpty(), name
        docs = out


def test_no_documents_and_no_benchmark(spark, folder):
    assert result(spark, folder([], [])) == []


def test_rows_of_one_id_with_other_texts(spark, docs):
    """Which of them stays does not depend on how the rows are dealt out."""
    rows = [(7, f"text number {k} of an id that several rows have {k * k}") for k in range(12)] + [(8, "something else altogether, and by itself")]
    for parts in (1, 3, 8):
        kept = queries.simhash.keep_one(docs(*rows).repartition(parts))
        assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(7, min(t for i, t in rows if i == 7)), rows[-1]}
