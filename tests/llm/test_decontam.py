import random
import re

import numpy as np
import pytest

from pathloom.llm import decontam

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for name, text in items:
            iw = words(text)
            if not iw or name is None:
                continue
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1):
                for b in range(len(ws) - n + 1):
                    if ws[b : b + n] == iw[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(name)
        out.append((i, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(docs, items):
    got = decontam.hits(docs, items)
    return sorted(((r["doc_id"], r["n_words"], sum(e - b for b, e in zip(r["begins"], r["ends"], strict=True)), sorted(r["items"])) for r in got.collect()), key=str)


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id long, text string")


LONG = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, None), (2, ""), (3, "x " + LONG.upper() + " y"), (4, "one, two; three four five six seven eight nine eleven"), (5, "alpha beta! alpha-beta gamma"), (6, "Élan vital"), (7, "..., !!"),
    (8, "two three four five six seven eight nine ten eleven two three four five six seven eight nine ten eleven"), (None, LONG), (3, "x " + LONG.upper() + " y"),
]
ITEMS = [(10, LONG), (11, "alpha beta"), (12, None), (13, " .. "), (None, "gamma"), (14, "élan VITAL"), (15, "Élan vital"), (11, "alpha beta"), (11, "gamma")]


def test_against_brute_force(docs, items):
    assert run(docs(*ROWS), items(*ITEMS)) == plain(ROWS, ITEMS)
    assert run(docs(*ROWS, clash=True), items(*ITEMS)) == plain(ROWS, ITEMS)


def test_random_texts(docs, items):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, make(rng.randint(0, 60))) for i in range(40)]
    its = [(i, make(rng.choice((1, 2, 3, 5, 11, 14)))) for i in range(12)]
    its.append((99, rows[3][1][2:40]))
    assert run(docs(*rows), items(*its)) == plain(rows, its)


def test_several_blocks(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    its = [*ITEMS, (16, "four five six"), (17, "nine ten eleven")]
    assert run(docs(*ROWS), items(*its)) == plain(ROWS, its)
    clean = sorted(str(r["doc_id"]) for r in decontam.clean_only(docs(*ROWS), items(*its)).collect())
    assert clean == sorted(str(i) for i, _, n, _ in plain(ROWS, its) if not n)


@pytest.mark.parametrize("block", [60, 8 << 20])
def test_long_texts_and_items(docs, items, monkeypatch, block):
    """Texts over many pieces, an item longer than a block, a word longer than a piece."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "_PIECE", 64)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(400)) + " " + " ".join(item[i : i + 14])) for i in range(20)]
    rows += [(50, "x" * 500 + " " + " ".join(item[:9])), (51, "Y" * 500 + " y " + "  ".join(item)), (52, ("z" * 70 + " ") * 11)]
    its = [(1, " ".join(item)), (2, "y" * 500), (3, " ".join(["z" * 70] * 10))]
    assert run(docs(*rows), items(*its)) == plain(rows, its)


def test_a_large_vocabulary(docs, items):
    """Two million different words in one item."""
    text = " ".join(f"{k:x}" for k in range(2_000_000))
    rows = [(1, " ".join(f"{k:x}" for k in range(1_999_980, 2_000_000))), (2, "ffffe 1 2"), (3, text)]
    got = {r["doc_id"]: r for r in decontam.report(decontam.hits(docs(*rows), items((7, text)))).collect()}
    assert (got[1]["n_hit"], got[2]["n_hit"], got[3]["n_hit"]) == (20, 0, 2_000_000)


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(10,0)"])
def test_item_ids_of_any_type(docs, items, kind):
    named = items(*ITEMS).selectExpr(f"cast({'date_add(date 2020-01-01, cast(item_id as int))'.replace('2020-01-01', chr(39) + '2020-01-01' + chr(39)) if kind == 'date' else 'item_id'} as {kind}) as item_id", "text")
    got = {(r["doc_id"], r["n_items"]) for r in decontam.report(decontam.hits(docs(*ROWS), named)).collect()}
    assert got == {(i, len(found)) for i, _, _, found in plain(ROWS, ITEMS)}


def test_equal_hashes_are_no_match(docs, items, monkeypatch):
    """The words themselves decide: with hashes that are all equal, results stay the same."""
    monkeypatch.setattr(decontam, "_stirred", lambda h: h * np.uint64(0) + np.uint64(5))
    rows = [r for r in ROWS if r[0] is not None]
    t = decontam._windows([(i, t.encode()) for i, t in ITEMS if i and t], {n: np.zeros(1 << decontam.RARITY_BITS, np.int64) for n in (1, 2, 3)})
    _, doc, _, win = decontam._find(t, [t and t.encode() for _, t in rows])
    got = [sorted(t.items_of(win[doc == d])) if (doc == d).any() else [] for d in range(len(rows))]
    assert got == [next(f for i, n, _, f in plain([r], ITEMS)) for r in rows]


def test_several_blocks_report_every_row(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    rows = [*ROWS, (None, "four five six and more"), (None, None)]
    its = [*ITEMS, (16, "four five six"), (17, "nine ten eleven")]
    assert run(docs(*rows), items(*its)) == plain(rows, its)
    assert run(docs(*rows, clash=True), items(*its)) == plain(rows, its)


def test_the_stage_keeps_rows_as_they_are(docs, items):
    df = docs(*ROWS, clash=True)
    out = decontam.clean_only(df, items(*ITEMS))
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "4", "7"]


def test_empty_tables(docs, items):
    assert run(docs().limit(0), items(*ITEMS)) == []
    assert run(docs(*ROWS), items().limit(0)) == plain(ROWS, [])
    assert decontam.clean_only(docs(*ROWS), items().limit(0)).count() == len(ROWS)
