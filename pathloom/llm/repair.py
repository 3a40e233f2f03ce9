"""Re-Pair grammar compression of token ids, for one shard.

Re-Pair replaces a frequent pair of neighbouring symbols by a new nonterminal
and repeats this on the result until no pair is frequent.  Here each round takes
all pairs that are met ``least`` times, and replaces them in numpy; where two of
them overlap the more frequent one has its way.  A pair that is not frequent never
becomes so again, so later rounds look only at places where a rule was made or
put off.  No rule crosses the end of a document, so every document is a run of
symbols of its own: with its first symbol's place and its token count it is
decoded alone.

Frequent means that a rule saves bytes: n uses save n symbols and cost a rule of
two symbols and its expansion length, so the least n that pays is ``LEAST``.
With ``least=2`` the grammar goes on until no pair is met twice.  There may be
any number of rules: symbols take as many bits as their number needs, 16 at
least.

Shard format (little-endian): magic ``RPR2``, u32 bits of a symbol, vocab, rules,
symbols, documents; rules as pairs of symbols; u32 expansion length of each rule;
symbols; for each document u64 first symbol and u64 tokens.  Symbols are stored
as their low 16 bits and then, bit by bit, planes of one bit of each symbol.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np

MAGIC = b"RPR2"
#: A symbol of 16 bits or some more; a rule of two symbols and 32 bits: four uses save what the rule costs, five save more.
LEAST = 5
_head = struct.Struct("<4s5I")
_TABLE_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def _doubled(near: np.ndarray) -> np.ndarray:
    """Every second one of some places in a row; ``near`` tells for all but the last whether the next one follows."""
    order = np.arange(len(near) + 1)
    row = np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), order, 0))
    return (order - row) & 1 == 1


def _after(place: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """The next symbol that is there."""
    to = place + 1
    gone = np.flatnonzero(dead[to])
    while len(gone):
        to[gone] += 1
        gone = gone[dead[to[gone]]]
    return to


def _before(place: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """The symbol before that is there, where there is one."""
    to = place - 1
    gone = np.flatnonzero((to >= 0) & dead[to])
    while len(gone):
        to[gone] -= 1
        gone = gone[(to[gone] >= 0) & dead[to[gone]]]
    return to[to >= 0]


def _frequent(code: np.ndarray, least: int) -> np.ndarray:
    """The pairs met ``least`` times or more, in ascending order of frequency."""
    code = np.sort(code)
    if not len(code):
        return code
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    n = np.diff(np.append(first, len(code)))
    keep = np.flatnonzero(n >= least)
    return code[first[keep[np.argsort(n[keep], kind="stable")]]]


def _winners(near: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the hits are replaced: no two that overlap (``near``: with the next one), the more frequent before the other."""
    won = np.zeros(len(rank), bool)
    left = np.arange(len(rank), dtype=np.int32)
    near = np.append(near, False)
    while len(left):
        # Ties go to the left one.
        first = rank[:-1] >= rank[1:]
        over = near[:-1]
        best = np.ones(len(left), bool)
        best[1:] &= ~(over & first)
        best[:-1] &= first | ~over
        won[left[best]] = True
        rest = ~best
        rest[1:] &= ~(over & best[:-1])
        rest[:-1] &= ~(over & best[1:])
        rest = np.flatnonzero(rest)
        # Who follows whom among the rest: only direct neighbours still overlap.
        near = near[rest] & np.append(np.diff(rest) == 1, False)
        left, rank = left[rest], rank[rest]
    return won


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    parts = [symbols.astype("<u2").tobytes()]
    parts += [np.packbits((symbols >> np.uint32(k) & np.uint32(1)).astype(bool)).tobytes() for k in range(16, bits)]
    return b"".join(parts)


def _unpacked(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """``n`` symbols and where they end."""
    out = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for k in range(16, bits):
        plane = np.frombuffer(data, np.uint8, -(-n // 8), at)
        out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
        at += len(plane)
    return out, at


def compress(tokens: np.ndarray, lengths: np.ndarray, vocab: int, rounds: int | None = None, least: int = LEAST) -> bytes:
    """A shard of documents, given as one array of ids and the number of ids of each document.

    Without ``rounds``, until no pair inside a document is met ``least`` times.
    """
    vocab = max(vocab, int(tokens.max()) + 1 if len(tokens) else 0)
    x = tokens.astype(np.uint32)
    # The last symbol of each document.
    end = np.zeros(len(x), bool)
    end[np.cumsum(lengths, dtype=np.int64)[lengths > 0] - 1] = True
    #: Symbols that went into the one before.
    dead = np.zeros(len(x), bool)
    holes = 0
    made: list[np.ndarray] = []
    size = np.ones(vocab, np.int64)
    #: Where a pair begins that may be frequent, and its second symbol.
    place = np.flatnonzero(~end)
    to = place + 1
    alone = False
    for _ in itertools.count() if rounds is None else range(rounds):
        a, b = x[place], x[to]
        code = a.astype(np.uint64) << _HALF | b
        # In a row of one symbol every second pair counts.
        free = np.ones(len(place), bool)
        twin = np.flatnonzero(a == b)
        if len(twin):
            free[twin[_doubled(to[twin[:-1]] == place[twin[1:]])]] = False
        pairs = _frequent(code[free], least)
        if not len(pairs):
            break
        if alone:
            pairs = pairs[-1:]
        # Which rule stands at each place: one look into a hashed table.  Of pairs with one slot the last, the most frequent, stays; the others wait for the next round.
        down = np.uint64(64 - _TABLE_BITS)
        rule_at = np.full(1 << _TABLE_BITS, -1, np.int32)
        rule_at[(pairs * _MIX) >> down] = np.arange(len(pairs))
        rule = rule_at[(code * _MIX) >> down]
        wait = np.flatnonzero(rule >= 0)
        hit = wait[(pairs[rule[wait]] == code[wait]) & free[wait]]
        at, goes, rule = place[hit], to[hit], rule[hit]
        won = _winners(goes[:-1] == at[1:], rule)
        # Overlaps may leave a pair fewer uses than it takes; it may have enough again later.
        uses = np.bincount(rule[won], minlength=len(pairs))
        used = np.flatnonzero(uses >= least)
        if not len(used):
            # The most frequent pair: without rivals it keeps all its uses.
            alone = True
            continue
        won = np.flatnonzero(won & (uses[rule] >= least))
        at, goes, rule = at[won], goes[won], rule[won]
        number = np.zeros(len(pairs), np.uint32)
        number[used] = np.arange(len(size), len(size) + len(used))
        new = np.column_stack([pairs[used] >> _HALF, pairs[used] & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        made.append(new)
        size = np.append(size, size[new].sum(axis=1))
        x[at] = number[rule]
        end[at] = end[goes]
        dead[goes] = True
        holes += len(goes)
        open_ = np.zeros(len(x), bool)
        open_[place if alone else place[wait]] = True
        open_[at] = True
        open_[_before(at, dead)] = True
        open_ &= ~(dead | end)
        alone = False
        if 4 * holes > len(x):
            stay = np.flatnonzero(~dead)
            x, end, open_ = x[stay], end[stay], open_[stay]
            dead, holes = np.zeros(len(x), bool), 0
        place = np.flatnonzero(open_)
        to = _after(place, dead)
    x, end = x[~dead], end[~dead]
    rules = np.concatenate(made) if made else np.empty((0, 2), np.uint32)
    # Documents without ids have no symbol.
    last = np.flatnonzero(end)
    counts = np.zeros(len(lengths), np.int64)
    counts[lengths > 0] = np.diff(np.append(-1, last))
    where = np.column_stack([np.cumsum(counts) - counts, lengths]).astype("<u8")
    bits = max(16, (len(size) - 1).bit_length())
    return b"".join((
        _head.pack(MAGIC, bits, vocab, len(rules), len(x), len(lengths)), _packed(rules.ravel(), bits), size[vocab:].astype("<u4").tobytes(), _packed(x, bits), where.tobytes(),
    ))


class Shard:
    """Reads a shard: all of it or one document."""

    def __init__(self, data: bytes):
        magic, bits, self.vocab, rules, symbols, docs = _head.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no shard of token ids")
        flat, at = _unpacked(data, _head.size, 2 * rules, bits)
        self.rules = flat.reshape(rules, 2)
        self.rule_size = np.frombuffer(data, "<u4", rules, at)
        self.symbols, at = _unpacked(data, at + self.rule_size.nbytes, symbols, bits)
        self.where = np.frombuffer(data, "<u8", 2 * docs, at).reshape(docs, 2).astype(np.int64)
        if at + self.where.nbytes != len(data):
            raise ValueError("shard of the wrong length")
        # Expansions one after another; rules only use earlier symbols.
        self.size = np.concatenate([np.ones(self.vocab, np.int64), self.rule_size.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size
        flat = np.empty(int(self.size.sum()), np.uint32)
        flat[: self.vocab] = np.arange(self.vocab)
        done = self.vocab
        total = self.vocab + rules
        while done < total:
            # All rules whose parts are expanded: those before the first that needs one of them.
            part = self.rules[done - self.vocab :].astype(np.int64)
            late = np.flatnonzero(part.max(axis=1) >= done)
            upto = done + (int(late[0]) if len(late) else len(part))
            flat[self.start[done] : self.start[upto - 1] + self.size[upto - 1]] = self._spread(part[: upto - done].ravel(), flat)
            done = upto
        self.flat = flat

    def _spread(self, symbols: np.ndarray, flat: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        index += np.repeat(self.start[symbols] - (ends - n), n)
        return flat[index]

    def tokens(self, doc: int | None = None) -> np.ndarray:
        """Ids (unsigned 32-bit) of the document at place ``doc``, or of all."""
        if doc is None:
            return self._spread(self.symbols, self.flat)
        first = self.where[doc, 0]
        end = self.where[doc + 1, 0] if doc + 1 < len(self.where) else len(self.symbols)
        return self._spread(self.symbols[first:end], self.flat)
