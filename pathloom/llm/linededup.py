r"""Line dedup that can be taken back: cuckoo filters over exact reference counts.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in
lower case; keys of at least ``MIN_CHARS`` code points count.  Keys are held as
128-bit hashes.  State, all on shared storage:

``refs``     one row for each (key, document): the exact references
``counts``   for each key the number of documents that hold it and the least of them
``filters``  for each shard of keys a cuckoo filter over the keys that several
             documents hold

``insert`` adds the counts of new documents to those there are, ``delete`` takes
counts away; only where the least document of a key goes is the next one looked up
among the references.  A key enters its shard's filter when its count reaches two
and leaves it when the count falls below.  After a deletion the state is that of
never having inserted, so lines come back.

``dedup`` asks the filters first, which turns away nearly all references to lines
that nobody shares, and then the exact counts, which decide.  No filter is sent to
all executors: references and filters are dealt out by shard and meet there, one
filter in memory at a time.

Hot lines: counts are combined before the shuffle; a shard with more than
``PART_REFS`` references is split, with a copy of its filter for each part; the
join with the counts has stored tables on both sides, so that adaptive execution
can split it.

Defined cases: a null or empty text is one empty line; rows with a null doc_id
keep all lines and hold none; repeated rows of a document are the same document,
and rows of one id with different texts hold the lines of all of them; ids may be
of any type that has an order; a very long text is one row of work, read as a
whole; an empty table gives no row; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS = 10
#: Keys a filter shard is made for.
SHARD_KEYS = 1 << 16
#: References that meet a copy of their shard's filter in one piece.
PART_REFS = 1 << 18
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLOTS = 4


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; 0 is an empty slot.

    What finds no slot after many moves is kept in a list beside the table, so
    that an insertion never fails.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, extra: list[tuple[int, int]] | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table
        self.extra = extra or []

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.85))))))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys (their two 64-bit halves)."""
        a, b = h1.view(np.uint64), h2.view(np.uint64)
        fp = (b >> np.uint64(48)).astype(np.int64)
        fp[fp == 0] = 1
        i = (a & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask
        return fp, i, i ^ self._jump(fp)

    def _jump(self, fp):
        return (fp * 0x5BD1E995 >> 7) & self.mask

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        table = self.table
        for fp, i, j in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            for at in (i, j):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = fp
                    break
            else:
                at = j
                for move in range(200):
                    slot = (fp + move) % _SLOTS
                    fp, table[at, slot] = int(table[at, slot]), fp
                    at ^= self._jump(fp)
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = fp
                        break
                else:
                    self.extra.append((fp, at))

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        for fp, i, j in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            for at in (i, j):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
                if (fp, at) in self.extra:
                    self.extra.remove((fp, at))
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, i, j = self._places(h1, h2)
        got = ((self.table[i] == fp[:, None]) | (self.table[j] == fp[:, None])).any(axis=1)
        for f, at in self.extra:
            got |= (fp == f) & ((i == at) | (j == at))
        return got

    def dump(self) -> bytes:
        return np.array([self.mask + 1, len(self.extra)], "<i8").tobytes() + np.array(self.extra, "<i8").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        buckets, extra = np.frombuffer(data, "<i8", 2).tolist()
        pairs = np.frombuffer(data, "<i8", 2 * extra, 16).reshape(-1, 2).tolist()
        return cls(buckets, np.frombuffer(data, "<u2", offset=16 + 16 * extra).reshape(buckets, _SLOTS).copy(), [tuple(p) for p in pairs])


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, or an empty one if it has fewer than MIN_CHARS code points."""
    out = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        n = len(key)
        if n < MIN_CHARS or (n < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
            key = b""
        out.append(key)
    return out


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return x[:, 0].copy(), x[:, 1].copy()


def references(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id: the keys of each row's text, each once for a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        rows, digests, counts = [], [], []
        for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            if not text or not batch.column(0)[k].is_valid:
                continue
            keys = set(line_keys(text))
            keys.discard(b"")
            digests += map(key_hash, keys)
            rows.append(k)
            counts.append(len(keys))
        h1, h2 = _halves(digests)
        return {"h1": pa.array(h1), "h2": pa.array(h2), "doc_id": batch.column(0).take(pa.array(np.repeat(np.array(rows, np.int64), counts)))}

    return common.map_texts(docs, ["doc_id", "text"], run, f"h1 long, h2 long, doc_id {kind}")


def _once(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """``refs`` with each (key, document) once: only ids of several rows can repeat one."""
    several = common.stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "line-repeated-ids")
    if several.isEmpty():
        return refs
    once = refs.join(several, "doc_id", "left_anti").unionByName(refs.join(several, "doc_id", "left_semi").distinct())
    return common.stored(once.select("h1", "h2", "doc_id"), "line-refs")


_KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 1, id_type: str = "bigint") -> LineState:
        """No documents; their ids will be of ``id_type``."""
        schemas = f"h1 long, h2 long, doc_id {id_type}", f"h1 long, h2 long, refs long, least {id_type}", "shard long, filter binary"
        return cls(*[spark.createDataFrame([], T._parse_datatype_string(s)) for s in schemas], shards)

    def insert(self, docs: DataFrame) -> LineState:
        """The state with the documents of ``docs`` as well (of an id that is there already: nothing new)."""
        new = _once(common.stored(references(docs), "line-refs"), docs.select("doc_id"))
        first = self.refs.isEmpty()
        if not first:
            new = common.stored(new.join(self.refs.select("doc_id").distinct(), "doc_id", "left_anti").select("h1", "h2", "doc_id"), "line-refs")
        more = new.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("least"))
        if first:
            counted = more.select(*_KEY, F.lit(0).cast("long").alias("before"), "refs", "least")
        else:
            counted = (
                self.counts.select(*_KEY, F.col("refs").alias("before"), "refs", "least").unionByName(more.select(*_KEY, F.lit(0).cast("long").alias("before"), "refs", "least"))
                .groupBy(*_KEY).agg(F.sum("before").alias("before"), F.sum("refs").alias("refs"), F.min("least").alias("least"))
            )
        return self._with(new if first else self.refs.unionByName(new), common.stored(counted, "line-counts"))

    def delete(self, ids: DataFrame) -> LineState:
        """The state without the documents whose ``doc_id`` is in ``ids``."""
        kind = self.refs.schema["doc_id"].dataType
        gone = common.stored(ids.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct(), "line-gone")
        left = common.stored(self.refs.join(gone, "doc_id", "left_anti").select("h1", "h2", "doc_id"), "line-refs")
        less = self.refs.join(gone, "doc_id", "left_semi").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("less"), F.min("doc_id").alias("went"))
        rest = F.coalesce("less", F.lit(0))
        now = common.stored(
            self.counts.join(less, _KEY, "left").select(*_KEY, F.col("refs").alias("before"), (F.col("refs") - rest).alias("refs"), "least", (F.col("went") <= F.col("least")).alias("orphan")), "line-counts"
        )
        # Keys without their least document: the next one is among the references.
        orphans = now.where("orphan and refs > 0").select(*_KEY)
        heirs = left.join(orphans, _KEY, "left_semi").groupBy(*_KEY).agg(F.min("doc_id").alias("heir"))
        counted = now.join(heirs, _KEY, "left").select(*_KEY, "before", "refs", F.coalesce("heir", "least").alias("least"))
        return self._with(left, common.stored(counted, "line-counts"))

    def _with(self, refs: DataFrame, counted: DataFrame) -> LineState:
        """New filters: each shard's old one with the keys that came to be shared, without those that no longer are."""
        n = counted.where("refs >= 2").count()
        shards = max(self.shards, 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS)))))
        if shards != self.shards or self.filters.isEmpty():
            changes, start = counted.where("refs >= 2").select(*_KEY, F.lit(1).alias("sign")), self.filters.limit(0)
        else:
            changes = counted.where("(before >= 2) != (refs >= 2)").select(*_KEY, F.when(F.col("refs") >= 2, 1).otherwise(-1).alias("sign"))
            start = self.filters
        rows = changes.select(_shard(shards).alias("shard"), *_KEY, "sign", F.lit(None).cast("binary").alias("filter")).unionByName(
            start.select("shard", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).alias("sign"), "filter"))

        def update(pdf):
            held = [x for x in pdf["filter"] if x is not None]
            f = Cuckoo.load(held[0]) if held else Cuckoo.sized(2 * SHARD_KEYS)
            for sign, change in ((-1, f.delete), (1, f.insert)):
                part = pdf[pdf["sign"] == sign]
                change(part["h1"].to_numpy(np.int64), part["h2"].to_numpy(np.int64))
            pdf = pdf.iloc[:1][["shard"]].copy()
            pdf["filter"] = [f.dump()]
            return pdf

        # A group is a shard: the keys that several documents hold, about SHARD_KEYS of them.
        filters = common.stored(rows.groupBy("shard").applyInPandas(update, "shard long, filter binary"), "line-filters")
        return LineState(refs, counted.where("refs > 0").select(*_KEY, "refs", "least"), filters, shards)

    def maybe_shared(self) -> DataFrame:
        """The references whose key a filter holds: all to lines that several documents hold, and few others."""
        kind = self.refs.schema["doc_id"].dataType
        shard = _shard(self.shards)
        # A row for each shard of SHARD_KEYS shared keys.
        parts = self.counts.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("refs") / PART_REFS).cast("int").alias("parts"))
        parts = common.stored(parts, "line-parts")
        refs = self.refs.withColumn("shard", shard).join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), *_KEY, "doc_id", F.lit(None).cast("binary").alias("filter"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("doc_id", kind))]
        filters = self.filters.join(parts, "shard").select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), *none, "filter")
        dealt = refs.unionByName(filters).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

        def run(batches):
            held, at = None, None
            for batch in batches:
                shards, part, h1, h2 = (batch.column(k).fill_null(0).to_numpy() for k in range(4))
                is_filter = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
                keep = np.zeros(batch.num_rows, bool)
                cuts = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (part[1:] != part[:-1]) | is_filter[1:])))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                    if is_filter[a]:
                        held, at = Cuckoo.load(batch.column(5)[a].as_py()), shards[a]
                        a += 1
                    # A shard without a filter has no shared key.
                    if a < b and at == shards[a]:
                        keep[a:b] = held.contains(h1[a:b], h2[a:b])
                if keep.any():
                    yield batch.select([2, 3, 4]).filter(pa.array(keep))

        return common.small_batches(dealt).mapInArrow(run, f"h1 long, h2 long, doc_id {kind.simpleString()}")

    def drops(self) -> DataFrame:
        """doc_id, keys: for each document the hashes of the lines it loses."""
        shared = self.counts.where("refs >= 2").select(*_KEY, "least")
        rows = common.stored(self.maybe_shared(), "line-maybe-shared").join(shared, _KEY).where("doc_id > least")
        return rows.groupBy("doc_id").agg(F.collect_set(F.struct(*_KEY)).alias("keys"))


def _shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards).cast("long"))


def dedup(docs: DataFrame, state: LineState) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without lines that an earlier document holds)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    drops = state.drops().select(F.col("doc_id").alias("__id"), F.expr("transform(keys, k -> k.h1)").alias("__h1"), F.expr("transform(keys, k -> k.h2)").alias("__h2"))
    joined = docs.select("doc_id", "text").join(drops, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__h1", "__h2")

    def run(batch):
        n_lines, n_dropped, kept = [], [], []
        h1, h2 = batch.column(2), batch.column(3)
        for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            text = text or b""
            if not h1[k].is_valid:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            lose = set(zip(h1[k].as_py(), h2[k].as_py(), strict=True))
            lines, stay = text.split(b"\n"), []
            a, b = _halves([key_hash(key) for key in line_keys(text)])
            for line, key in zip(lines, zip(a.tolist(), b.tolist(), strict=True), strict=True):
                if key not in lose:
                    stay.append(line)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return {"doc_id": batch.column(0), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return common.map_texts(joined, ["doc_id", "text", "__h1", "__h2"], run, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
