import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import queries, repair, tokenids

from .conftest import ODD, long_text

PATH = queries.tokenizer_path()


#: Nothing set on it: what the plain call gives.
UNTOUCHED = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return tokenids.encoder(PATH)


def check(enc, texts, tokenizer=UNTOUCHED):
    got, n = enc.encode(pa.array(texts, pa.string()), 0)
    for part, t in zip(np.split(got, np.cumsum(n)[:-1]), texts, strict=True):
        assert part[-1] == 0
        assert part[:-1].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


STRANGE = [
    "a  b", " x", "x ", "\n \n a", "a \x1c b", "a\x85 b 　 c", "", "  ", None, "don't 's it's  's", "a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|> <|endoftext|>\nx <|endoftex", "x\n y", "​a​ b", "é 12 3 $$ $$%", "tab\t x \t y", " \xa0 x",
    "é’s l’été a_b. x’s a's. _x áb. ²x x² a.b.c! x..\n y\nz. q\n\nr s\n", ". a", ".\nb c", "x_ y__z _a_ b-c. -d- e.... f! g?! h%%% i### (j) [k].", "no spaces" * 50, "日本語 のテキスト。 と", "1,000.5% of 'it'",
]


def test_pieces_give_the_tokenizers_own_ids(enc):
    check(enc, STRANGE)
    check(enc, STRANGE[::-1])


@given(st.lists(st.text(alphabet="aZé ß.,'’\n\t ́#1²_-|\x1c", max_size=40), min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_any_text(texts):
    check(tokenids.encoder(PATH), texts)


@given(st.lists(st.text(alphabet="aZéÿжśҁ×÷҂ \xa0\u2003\u3000\u180e\u200b\x85\x1c\n\t\r.,'’“1²_語", max_size=30), min_size=1, max_size=5), st.booleans())
@settings(max_examples=300, deadline=None)
def test_texts_around_cuts(texts, wide):
    enc = tokenids.encoder(PATH)
    check(enc, texts)
    part = pa.array(["x ", *texts, " y"], pa.large_string() if wide else pa.string()).slice(1, len(texts))
    got, n = enc.encode(part)
    assert [p.tolist() for p in np.split(got, np.cumsum(n)[:-1])] == [UNTOUCHED.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_learned_once_whatever_stands_beside_it():
    """Else every word goes through the tokenizer again with each mark, line end and word of the next line."""
    fresh = tokenids.Encoder(PATH)
    words = ["sternwoge", "été", "bożek", "слово", "a"]
    texts = [f"so {w}{mark}{then}" for w in words for mark in ["", ".", ",", "&&&", "'s", "1", "\n"] for then in ["", " ", "\nNext", *(f"\n{x}" for x in words), *(f" {x}" for x in words)]]
    check(fresh, texts)
    # Words after a space and at the start of a line, marks, line ends.
    assert len(fresh.known) < 40
    seen = len(fresh.known)
    check(fresh, [t.replace("so ", "so so ") for t in texts])
    assert len(fresh.known) <= seen + 1


def test_long_pieces_are_not_kept():
    fresh = tokenids.Encoder(PATH)
    texts = ["a " + "x" * 100 + " b", "y" * 70 + ". c\td e", "f " + "z" * 65, "g"]
    for _ in range(2):
        check(fresh, texts)
        assert max(map(len, fresh.known)) <= tokenids.LONG
        assert sorted(fresh.known.values()) == list(range(len(fresh.start))) and len(fresh.size) == len(fresh.start)
        assert len(fresh.pool) == fresh.size.sum()


def test_a_full_table(enc, monkeypatch):
    monkeypatch.setattr(tokenids, "KEPT_PIECES", 10)
    fresh = tokenids.Encoder(PATH)
    for seed in range(12):
        check(fresh, [long_text(60, seed), long_text(60, seed)])


def test_another_tokenizer_gives_its_own_ids(tmp_path):
    steps = json.loads(UNTOUCHED.to_str())
    assert tokenids.cuts_at_spaces(steps)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (path := tmp_path / "t.json").write_text(json.dumps(steps | change))
        assert not tokenids.cuts_at_spaces(steps | change)
        other = Tokenizer.from_file(str(path))
        texts = [*STRANGE, "Some WORDS here", "x  y"]
        check(tokenids.Encoder(str(path)), texts, other)
        assert any(other.encode(t or "").ids != UNTOUCHED.encode(t or "").ids for t in texts)


def shard_of(parts, vocab=300, **more):
    x = np.concatenate([np.array(p, np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)
    return repair.Shard(repair.compress(x, np.array([len(p) for p in parts], np.int64), vocab, **more))


@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.sampled_from([300, 70_000]), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_grammar_round_trip(parts, vocab, rounds):
    s = shard_of(parts, vocab, rounds=rounds, least=2)
    assert s.tokens().tolist() == [x for p in parts for x in p]
    for k, p in enumerate(parts):
        assert s.tokens(k).tolist() == p


def test_grammar_compresses_repeats():
    part = list(range(50)) * 40
    s = shard_of([part] * 5)
    assert len(s.symbols) < len(part) and len(s.rules) > 10
    assert (s.rule_size >= 2).all()


def pairs_left(s):
    """How often the most frequent pair of symbols is met inside documents, hits that overlap not counted."""
    ends = np.append(s.where[1:, 0], len(s.symbols))[: len(s.where)]
    seen = Counter()
    for a, b in zip(s.where[:, 0].tolist(), ends.tolist(), strict=True):
        last = None
        for k in range(a, b - 1):
            pair = (int(s.symbols[k]), int(s.symbols[k + 1]))
            if last == (k - 1, pair):  # the second of a, a, a
                last = None
                continue
            last = (k, pair)
            seen[pair] += 1
    return max(seen.values(), default=0)


@given(st.lists(st.lists(st.integers(0, 3), max_size=80), max_size=6), st.integers(2, 6))
@settings(max_examples=200, deadline=None)
def test_no_frequent_pair_is_left(parts, least):
    s = shard_of(parts, 10, least=least)
    assert s.tokens().tolist() == [x for p in parts for x in p]
    assert pairs_left(s) < least


def test_the_grammar_goes_on_to_the_end():
    rng = np.random.default_rng(3)
    passage = rng.permutation(200).tolist()
    parts = [[*rng.integers(0, 300, 5).tolist(), *passage, *rng.integers(0, 300, 5).tolist()] for _ in range(400)]
    for least in (2, repair.LEAST):
        s = shard_of(parts, least=least)
        assert s.tokens().tolist() == [x for p in parts for x in p]
        # The passage is one symbol, or a few where its ends differ.
        assert s.rule_size.max() > 100 and len(s.symbols) < 400 * 14
        assert pairs_left(s) < least


@pytest.mark.parametrize("vocab", [65_000, 65_534, 65_536, 200_000])
def test_rules_beyond_16_bits(vocab):
    """As many rules as without that bound, in symbols of a few bits more."""
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 60, 500).tolist() for _ in range(60)]
    few, many = shard_of(parts, 60, least=2), shard_of(parts, vocab, least=2)
    assert len(many.rules) == len(few.rules) > 2000 and len(many.symbols) == len(few.symbols) and pairs_left(many) < 2
    assert many.tokens().tolist() == [x for p in parts for x in p] and many.tokens(7).tolist() == parts[7]


def test_of_pairs_with_one_slot_the_less_frequent_waits():
    slots = {}
    for a in range(1, 1000):
        for b in range(a + 1, 1000):
            slot = int((np.array([a << 32 | b], np.uint64) * repair._MIX)[0] >> np.uint64(64 - repair._TABLE_BITS))
            if slot in slots and not {a, b} & set(slots[slot]):
                break
            slots[slot] = (a, b)
        else:
            continue
        break
    low, high = slots[slot], (a, b)
    for many, few in ((low, high), (high, low)):
        assert shard_of([many] * 60 + [few] * 20, 1000, rounds=1).rules.tolist() == [list(many)]
        assert shard_of([many] * 60 + [few] * 20, 1000).rules.tolist() == [list(many), list(few)]


def test_a_run_of_one_id_and_the_largest_id():
    part = [65_535] * 1001 + [7]
    s = shard_of([part, [], part], 65_536, least=2)
    assert s.tokens(2).tolist() == part and s.tokens(1).tolist() == []


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 40)
    good = repair.compress(np.array([1, 2], np.uint16), np.array([2]), 10)
    with pytest.raises(ValueError):
        repair.Shard(good + b"x")


def index(df, **more):
    return [tuple(r) for r in tokenids.read_index(tokenids.write_shards(df, PATH, **more)).orderBy("start").collect()]


def plain(enc, rows):
    out, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_shards(enc, odd, odd_clashing, docs):
    assert index(odd) == index(odd_clashing) == plain(enc, ODD)
    assert index(docs().limit(0)) == []
    rows = [(int(i), long_text(30 + int(i), int(i))) for i in np.random.default_rng(0).permutation(80)]
    assert index(docs(*rows).repartition(7), shard_tokens=200) == plain(enc, rows)
    big = [(1, long_text(150_000)), (2, "x")]
    assert index(docs(*big)) == plain(enc, big)
