import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pathloom.llm import linededup
from pathloom.llm.linededup import Cuckoo, LineState


def plain(rows):
    """Brute force over (doc_id, text)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(docs):
    state = LineState.empty(docs.sparkSession).insert(docs)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup(docs, state).collect()), key=str)


ROWS = [
    (3, "Shared line here\nown line of three\nShared line here"), (1, " shared LINE here \t\nx"), (2, "short\nshort\nSHARED line here"), (4, "ÄÖÜ äöü ß ü\nother"), (5, "ÄÖÜ äöü ß ü"),
    (6, "éééééééééé"), (7, "éééééééééé\n"), (8, None), (9, ""), (None, "shared line here"), (1, " shared LINE here \t\nx"),
]


def test_against_brute_force(docs):
    assert run(docs(*ROWS)) == plain(ROWS)
    assert run(docs(*ROWS, clash=True)) == plain(ROWS)


def test_counts_are_documents(docs):
    """The exact counts and least documents, repeated rows and rows of one id included."""
    rows = [*ROWS, (2, "another line of two\nShared line here"), (2, "another line of two")]
    state = LineState.empty(docs().sparkSession).insert(docs(*rows))
    holders = {}
    for i, text in rows:
        for key in linededup.line_keys((text or "").encode()):
            if key and i is not None:
                holders.setdefault(tuple(np.frombuffer(linededup.key_hash(key), "<i8").tolist()), set()).add(i)
    assert {(r["h1"], r["h2"]): (r["refs"], r["least"]) for r in state.counts.collect()} == {k: (len(v), min(v)) for k, v in holders.items()}
    assert state.refs.count() == sum(map(len, holders.values()))
    assert run(docs(*rows)) == plain(rows)


@pytest.mark.parametrize("kind", ["string", "int", "smallint"])
def test_ids_of_other_types(docs, kind):
    rows = [(i, t) for i, t in ROWS]
    df = docs(*rows).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    state = LineState.empty(df.sparkSession, id_type=kind).insert(df)
    got = linededup.dedup(df, state)
    assert dict(got.dtypes)["doc_id"] == kind
    as_text = (lambda i: i if i is None else str(i)) if kind == "string" else (lambda i: i)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()), key=str) == plain([(as_text(i), t) for i, t in rows])


def test_hot_lines_are_split(docs, monkeypatch):
    """One line in every document: its shard's references come in many parts."""
    monkeypatch.setattr(linededup, "PART_REFS", 16)
    rows = [(i, f"the line of everybody\nown line number {i}\nline of pairs {i // 2}") for i in range(200)]
    assert run(docs(*rows)) == plain(rows)
    asked = LineState.empty(docs().sparkSession).insert(docs(*rows)).maybe_shared().count()
    assert 400 <= asked < 420  # own lines are turned away


def test_long_texts(docs):
    long = "\n".join(f"line number {k}" for k in range(60_000))
    rows = [(1, long), (2, long + "\nand one more line"), (3, "x" * 3_000_000)]
    assert run(docs(*rows)) == plain(rows)


def test_many_shards(docs, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    rows = [(i, f"a line of number {i // 2}\nanother line {i // 3}") for i in range(60)]
    assert run(docs(*rows)) == plain(rows)


@given(st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="aB \n\té", max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_keys(rows):
    for _, t in rows:
        got = linededup.line_keys(t.encode())
        want = [k if len(k) >= 10 else "" for k in ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))]
        assert [k.decode() for k in got] == want


def test_deletion_brings_lines_back(docs, spark):
    all_rows = [(1, "first shared line\nown"), (2, "first shared line\nsecond shared line"), (3, "second shared line")]
    df = docs(*all_rows)
    state = LineState.empty(spark).insert(df)
    gone = state.delete(spark.createDataFrame([(1,)], "doc_id long"))
    left = [r for r in all_rows if r[0] != 1]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup(docs(*left), gone).collect()), key=str)
    assert got == plain(left)
    # The same as never having been there, to the last count.
    never = LineState.empty(spark).insert(docs(*left))
    for a, b in ((gone.counts, never.counts), (gone.refs, never.refs)):
        cols = sorted(a.columns)
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    back = gone.insert(docs(all_rows[0]))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup(df, back).collect()), key=str)
    assert got == plain(all_rows)


@given(st.lists(st.tuples(st.booleans(), st.sets(st.integers(0, 7), min_size=1, max_size=4)), min_size=1, max_size=4))
@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_order_of_changes(spark, steps):
    """After insertions and deletions in any order the state is that of inserting what is left."""
    text = {i: "\n".join(f"a shared line {i % k}" for k in (1, 2, 3)) for i in range(8)}
    frame = lambda ids: spark.createDataFrame([(i, text[i]) for i in sorted(ids)], "doc_id long, text string")
    state, there = LineState.empty(spark), set()
    for add, ids in steps:
        state = state.insert(frame(ids)) if add else state.delete(frame(ids))
        there = there | ids if add else there - ids
    never = LineState.empty(spark).insert(frame(there))
    for a, b in ((state.counts, never.counts), (state.refs, never.refs)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, state.maybe_shared().join(state.counts.where("refs >= 2"), ["h1", "h2"]).collect())) == sorted(map(tuple, never.maybe_shared().join(never.counts.where("refs >= 2"), ["h1", "h2"]).collect()))


def test_inserting_twice_changes_nothing(docs, spark):
    df = docs((1, "some longer line"), (2, "some longer line"))
    once = LineState.empty(spark).insert(df)
    twice = once.insert(df)
    assert sorted(map(tuple, once.counts.collect())) == sorted(map(tuple, twice.counts.collect()))


def test_empty_table(docs):
    assert run(docs().limit(0)) == []


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_filter(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-(2**63), 2**63, n), rng.integers(-(2**63), 2**63, n)
    f = Cuckoo.sized(n)
    f.insert(h1, h2)
    assert f.contains(h1, h2).all()
    f = Cuckoo.load(f.dump())
    half = n // 2
    f.delete(h1[:half], h2[:half])
    assert f.contains(h1[half:], h2[half:]).all()
    if half:
        assert f.contains(h1[:half], h2[:half]).mean() < 0.05
        assert f.contains(rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)).mean() < 0.01


def test_an_overfull_filter_still_holds_all():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(2**63), 2**63, 300), rng.integers(-(2**63), 2**63, 300)
    f = Cuckoo(16)
    f.insert(h1, h2)
    assert f.extra and f.contains(h1, h2).all() and Cuckoo.load(f.dump()).contains(h1, h2).all()
    f.delete(h1, h2)
    assert not f.extra and not f.table.any()
