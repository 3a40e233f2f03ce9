r"""Benchmark decontamination: a prefix-filtered containment join.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.  A window
is ``WINDOW`` consecutive words of a benchmark item, or all of a shorter one.  A
document is contaminated where it holds all words of a window in order.

The join.  A window is a set of shingles (``SHINGLE`` words, with their places).
Containment asks for every shingle, so by the prefix filter one necessary
shingle is enough to find all candidates: the rarest in the whole corpus.  Equal
windows are one, with the list of their items.  Windows are joined to documents
on the prefix shingle; the length bound and the positional bound (the window must
begin and end inside the document) drop candidates; the rest are verified over
the window, by the words' hashes and then byte by byte.

Words are hashed in numpy, many texts at once: sums of bytes times powers of one
number, differences of which give any word's value.  Rarity is counted in one scan
of all documents, however large the benchmark is, in a table of ``2**RARITY_BITS``
buckets of shingles, of which only those of the benchmark are added up; shingles
that share a bucket share a count, which may make a prefix less rare and never
loses a match.

The benchmark's windows are sent to the executors in blocks of at most
``BLOCK_BYTES`` of text; longer items are cut into pieces that overlap by a window
less one word.  Each block takes a scan of the documents, which are numbered and
stored for that if there are several, and whose hits are united by number.
Nothing is shuffled for a single block.

Defined cases: a null or empty text has no words; items with a null id or no
word are left out; equal item ids count once; ties of rarity go to the first
shingle; repeated rows of a document are each reported; very long texts are
hashed by pieces and joined as a whole; with an empty table of documents there is
no row, with an empty benchmark nothing is hit; ids may be of any plain type;
other columns, whatever their names, are ignored by ``hits`` and kept by
``clean_only``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

WINDOW = 10
SHINGLE = 3
#: Text bytes of the items in a block.
BLOCK_BYTES = 8 << 20
RARITY_BITS = 18
#: Blocks whose windows follow one another in one stage of ``clean_only``.
CHAINED = 4
#: Bytes hashed at a time, candidates verified at a time.
_PIECE, _CANDIDATES = 1 << 19, 1 << 19
#: Word bytes become themselves in lower case, all others a space: the pattern's class byte by byte in UTF-8.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = 0x9E3779B97F4A7C15
_JOIN = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64."""
    n = max(n, _PIECE)
    if n not in _powers:
        up, down = (np.full(n, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers.clear()
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Text:
    """Words of many texts: hash, first byte and end of each in ``data``; of each text its first word and number of words."""

    data: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    n_words: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Text:
        data = b" ".join([t or b"" for t in texts]).translate(_WORDS)
        size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        found = []
        at = 0
        while at < len(data):
            to = len(data)
            if at + _PIECE < to:
                to = data.rfind(b" ", at, at + _PIECE) + 1 or data.find(b" ", at + _PIECE) + 1 or to
            x = np.frombuffer(data, np.uint8, to - at, at)
            word = np.zeros(len(x) + 2, np.int8)
            word[1:-1] = x != 32
            edge = np.diff(word)
            a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            up, down = _power_tables(len(x))
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * down[: len(x)], out=sums[1:])
            found.append((_stirred((sums[b] - sums[a]) * up[a]), a + at, b + at))
            at = to
        hashes, begin, end = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        edges = np.searchsorted(begin, np.append(0, np.cumsum(size + 1)))
        return cls(data, hashes, begin, end, edges[:-1], np.diff(edges))

    def shingles(self, n: int) -> np.ndarray:
        """A number for each n words in a row, over the ends of texts too."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        code = self.hashes[:m].copy()
        for k in range(1, n):
            code *= _JOIN
            code += self.hashes[k : m + k]
        return _stirred(code)

    def inside(self, n: int) -> np.ndarray:
        """For each n words in a row whether they are of one text."""
        of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        m = max(0, len(of) - n + 1)
        return of[:m] == of[n - 1 :]

    def words(self, first: int, n: int) -> list[bytes]:
        return self.data[self.begin[first] : self.end[first + n - 1]].split()


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


@dataclass
class Windows:
    """A block of items and its distinct windows."""

    text: Text
    items: list
    #: of each window: its first word in ``text``, its length, where its items begin in ``held_by``
    start: np.ndarray
    length: np.ndarray
    at: np.ndarray
    held_by: np.ndarray
    #: prefix shingles by shingle length, ascending: code, window, offset in the window; and the buckets they fall in
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def items_of(self, windows: np.ndarray) -> list:
        held = np.unique(np.concatenate([self.held_by[self.at[w] : self.at[w + 1]] for w in np.unique(windows)]))
        return sorted({self.items[k] for k in held.tolist()})


def _windows(rows: list[tuple], rarity: dict[int, np.ndarray]) -> Windows:
    text = Text.of([t for _, t in rows])
    n = text.n_words
    per = np.where(n > 0, n - np.minimum(n, WINDOW) + 1, 0)
    item = np.repeat(np.arange(len(rows)), per)
    start = text.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(n, WINDOW)[item]
    same = np.arange(len(start))
    for m in np.unique(length).tolist():
        own = np.flatnonzero(length == m)
        code = text.shingles(m)[start[own]]
        order = np.argsort(code, kind="stable")
        fresh = np.concatenate(([True], code[order][1:] != code[order][:-1]))
        lead = own[order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]]
        for w, first in zip(own[order[~fresh]].tolist(), lead[~fresh].tolist(), strict=True):
            if text.words(start[w], m) == text.words(start[first], m):
                same[w] = first
    kept, number = np.unique(same, return_inverse=True)
    pairs = np.unique(np.column_stack([number, item]), axis=0) if len(item) else np.empty((0, 2), np.int64)
    w = Windows(text, [name for name, _ in rows], start[kept], length[kept], np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), pairs[:, 1])
    found: dict[int, list] = {}
    for m in np.unique(w.length).tolist():
        own = np.flatnonzero(w.length == m)
        k = min(m, SHINGLE)
        code = text.shingles(k)
        places = w.start[own][:, None] + np.arange(m - k + 1)
        rarest = np.argmin(rarity[k][_bucket(code[places])], axis=1)
        found.setdefault(k, []).append((code[w.start[own] + rarest], own, rarest))
    for k, parts in found.items():
        code, own, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        there = np.zeros(1 << RARITY_BITS, bool)
        there[_bucket(code)] = True
        w.prefix[k] = code[order], own[order], offset[order], there
    return w


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()


def _pieces(name, text: bytes) -> Iterator[tuple]:
    """A long item as pieces that hold each of its windows."""
    if len(text) <= BLOCK_BYTES:
        yield name, text
        return
    t = Text.of([text])
    at, n = 0, len(t.begin)
    while at < n:
        to = max(at + 2 * WINDOW, int(np.searchsorted(t.end, t.begin[at] + BLOCK_BYTES, side="right")))
        to = n if n - to < WINDOW else to
        yield name, t.data[t.begin[at] : t.end[to - 1]]
        at = n if to == n else to - WINDOW + 1


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of at most BLOCK_BYTES (a piece at least), one of them on the driver at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        for piece in _pieces(r["item_id"], bytes(r["text"])):
            if held and size + len(piece[1]) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append(piece)
            size += len(piece[1])
    if held:
        yield held


def _rarity(docs: DataFrame, items: DataFrame) -> dict[int, np.ndarray]:
    """By shingle length: how often the shingles of each bucket occur in all documents, for buckets of the benchmark's windows."""

    def buckets(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in common.text_chunks(batch, ["text"]):
                t = Text.of(part.column(0).to_pylist())
                for n in range(1, SHINGLE + 1):
                    # Shingles shorter than SHINGLE serve only items that are as short.
                    least = np.repeat(t.n_words, t.n_words)[: max(0, len(t.hashes) - n + 1)]
                    ok = t.inside(n) & ((least == n) if n < SHINGLE else True)
                    seen.update((n, b) for b in np.unique(_bucket(t.shingles(n)[ok])).tolist())
        rows = sorted(seen)
        yield pa.RecordBatch.from_pydict({"n": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int64())})

    wanted = {}
    for r in common.small_batches(items).select("text").mapInArrow(buckets, "n int, bucket long").distinct().collect():
        wanted.setdefault(r["n"], np.zeros(1 << RARITY_BITS, bool))[r["bucket"]] = True
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        sums = {n: np.zeros(1 << RARITY_BITS, np.int64) for n in sent.value}
        for batch in batches:
            for part in common.text_chunks(batch, ["text"]):
                t = Text.of(part.column(0).cast(pa.binary()).to_pylist())
                for n, there in sent.value.items():
                    b = _bucket(t.shingles(n))
                    b = b[there[b] & t.inside(n)]
                    sums[n] += np.bincount(b, minlength=1 << RARITY_BITS)
        for n, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"n": np.full(len(at), n, np.int32), "bucket": at, "seen": c[at]})

    out = {n: np.zeros(1 << RARITY_BITS, np.int64) for n in wanted}
    if wanted:
        got = common.small_batches(docs).select("text").mapInArrow(count, "n int, bucket long, seen long").groupBy("n", "bucket").agg(F.sum("seen").alias("seen")).toPandas()
        for n, part in got.groupby("n"):
            out[int(n)][part["bucket"].to_numpy()] = part["seen"].to_numpy()
    return out


def _find(w: Windows, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; document, first word and window of every occurrence."""
    t = Text.of(texts)
    last = t.first + t.n_words
    found = []
    for n, (code, window, offset, there) in w.prefix.items():
        got = t.shingles(n)
        place = np.flatnonzero(there[_bucket(got)])
        lo, hi = (np.searchsorted(code, got[place], side) for side in ("left", "right"))
        place, lo, many = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.cumsum(many)
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _CANDIDATES, side="right")))
            k = many[a:b]
            row = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[a:b], k)
            at = np.repeat(place[a:b], k)
            win, begin = window[row], at - offset[row]
            # Length and positional bounds: the window lies inside the same text.
            doc = np.searchsorted(t.first, at, "right") - 1
            ok = (begin >= t.first[doc]) & (begin + w.length[win] <= last[doc])
            win, begin, doc = win[ok], begin[ok], doc[ok]
            for k in range(WINDOW):
                part = w.length[win] > k
                ok = np.ones(len(win), bool)
                ok[part] = t.hashes[begin[part] + k] == w.text.hashes[w.start[win[part]] + k]
                win, begin, doc = win[ok], begin[ok], doc[ok]
            ok = np.fromiter((_equal(t, i, w.text, j, m) for i, j, m in zip(begin.tolist(), w.start[win].tolist(), w.length[win].tolist(), strict=True)), bool, len(win))
            found.append((doc[ok], begin[ok] - t.first[doc[ok]], win[ok]))
            a = b
    doc, begin, win = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
    return t.n_words, doc, begin, win


def _equal(a: Text, i: int, b: Text, j: int, n: int) -> bool:
    """Whether n words are the same, whatever stands between them."""
    return a.data[a.begin[i] : a.end[i + n - 1]] == b.data[b.begin[j] : b.end[j + n - 1]] or a.words(i, n) == b.words(j, n)


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """United spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, begins, ends (spans of hit words) and items (ids found) of every row of ``docs``.

    With several blocks of items what they find is united row by row, whatever
    the keys.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    docs, items = docs.select(key, "text"), _items(benchmark)
    rarity = _rarity(docs, items)
    blocks = _blocks(items)
    begun = list(itertools.islice(blocks, 2))
    several = len(begun) > 1
    schema = f"{key} {kind}, n_words long, begins array<long>, ends array<long>, items array<{item_kind}>"
    if several:
        # Stored once, so that every block meets the same numbers.
        docs = common.stored(docs.select(key, "text", F.monotonically_increasing_id().alias("__row")), "decontam-rows")
        schema = f"__row long, {schema}"
    found = []
    for k, rows in enumerate(itertools.chain(begun or [[]], blocks)):
        sent = spark.sparkContext.broadcast(_windows(rows, rarity))

        def run(batch, sent=sent, all_rows=k == 0):
            w = sent.value
            n_words, doc, begin, win = _find(w, batch.column(1).cast(pa.binary()).to_pylist())
            begins, ends, items = ([[] for _ in n_words] for _ in range(3))
            order = np.argsort(doc, kind="stable")
            doc, begin, win = doc[order], begin[order], win[order]
            with_hits = np.unique(doc)
            for d in with_hits.tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                begins[d], ends[d] = _spans(begin[a:b], begin[a:b] + w.length[win[a:b]])
                items[d] = w.items_of(win[a:b])
            longs = pa.list_(pa.int64())
            out = {"__row": batch.column(2)} if several else {}
            out |= {key: batch.column(0), "n_words": pa.array(n_words, pa.int64()), "begins": pa.array(begins, longs), "ends": pa.array(ends, longs), "items": pa.array(items, pa.list_(item_type))}
            # Every row is told once, by the first block.
            return out if all_rows else {c: x.take(pa.array(with_hits)) for c, x in out.items()}

        found.append(common.map_texts(docs, [key, "text", *["__row"] * several], run, schema))
    if not several:
        return found[0]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    both = rows.groupBy("__row").agg(F.first(key).alias(key), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"))
    # Spans of several blocks may overlap: unite them in order.
    united = F.expr(
        "aggregate(array_sort(arrays_zip(begins, ends)), named_struct('b', cast(array() as array<bigint>), 'e', cast(array() as array<bigint>)), "
        "(s, x) -> if(size(s.e) > 0 and x.begins <= element_at(s.e, -1), "
        "named_struct('b', s.b, 'e', concat(slice(s.e, 1, size(s.e) - 1), array(greatest(element_at(s.e, -1), x.ends)))), "
        "named_struct('b', concat(s.b, array(x.begins)), 'e', concat(s.e, array(x.ends)))))"
    )
    return both.withColumn("s", united).select(key, "n_words", F.col("s.b").alias("begins"), F.col("s.e").alias("ends"), F.array_distinct("items").alias("items"))


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of item ids from ``hits``."""
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    n_hit = F.expr("aggregate(zip_with(ends, begins, (e, b) -> e - b), cast(0 as bigint), (s, x) -> s + x)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; all columns as they are."""
    columns = docs.columns
    at = columns.index("text")
    items = _items(benchmark)
    rarity = _rarity(docs, items)
    out = docs
    for k, rows in enumerate(_blocks(items)):
        if k and k % CHAINED == 0:
            out = common.stored(out, "decontam-clean")
        sent = docs.sparkSession.sparkContext.broadcast(_windows(rows, rarity))

        def run(batches, sent=sent):
            for batch in batches:
                for part in common.text_chunks(batch, columns):
                    _, doc, _, _ = _find(sent.value, part.column(at).cast(pa.binary()).to_pylist())
                    keep = np.ones(part.num_rows, bool)
                    keep[doc] = False
                    if keep.any():
                        yield part if keep.all() else part.filter(pa.array(keep))

        out = common.small_batches(out).mapInArrow(run, docs.schema)
    return out
