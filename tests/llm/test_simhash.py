import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import components, simhash

from .conftest import long_text


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aA bB\n\tÉé x", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    s = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == np.array([xxhash.xxh64_intdigest(s, 42)], np.uint64).view(np.int64)[0]


def plain_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def clustered(n, near, seed):
    rng = np.random.default_rng(seed)
    out = set()
    for b in rng.integers(0, 2**64, n, dtype=np.uint64):
        out.add(int(b))
        for _ in range(near):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(3))
def test_trie_join(seed):
    v = clustered(6, 40, seed)
    forest = simhash.Forest(len(v))
    simhash.trie_join(v, np.array([[0, len(v), 0, len(v)]]), forest)
    assert forest.root.tolist() == plain_components(v)


@pytest.mark.parametrize("size", [8192, 8])
def test_links_lose_nothing_whatever_the_cut(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "NODE_SIZE", size)
    v = clustered(10, 60, 5)
    signed = v.view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: i for i, x in enumerate(signed)}
    forest = simhash.Forest(len(v))
    forest.join(np.array([at[r["a"]] for r in got]), np.array([at[r["b"]] for r in got]))
    assert forest.root.tolist() == plain_components(v)
    assert len(got) <= 3 * len(v) * (1 if size == 8192 else 80)


def test_components_of_a_long_path_and_a_star(spark):
    n = 60
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 40)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert {out[i] for i in range(n + 1)} == {0} and {out[1000 + i] for i in range(40)} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_odd_documents(odd, odd_clashing):
    for df in (odd, odd_clashing):
        got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
        assert {i: c for (i, f), c in got.items() if f == 0} == {1: 1, 2: 1, 3: 1}
        assert [c for (i, _), c in got.items() if i is None] == [None]
        assert simhash.near_duplicates(df).count() == df.count()
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_empty_table_and_long_text(docs, spark):
    assert simhash.near_duplicates(docs().limit(0)).count() == 0
    assert simhash.keep_one(docs().limit(0)).count() == 0
    text = long_text(120_000)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_hex():
    assert f"{simhash.fingerprint(b'a b c d'):016x}" == f"{plain_fingerprint('a b c d'):016x}"
