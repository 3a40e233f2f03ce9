"""Token ids as binary shards: tokenize, compress by Re-Pair, read back.

Documents are dealt out by ranges of doc_id, so that shards follow one another
in ascending order of id.  A shard closes with the slice of texts in which it
reaches ``SHARD_TOKENS`` ids.  Its bytes (``repair``) are one row of a Parquet
table on shared storage, together with its document ids, so that any executor can
write and read them.  The place of a document among all ids is its place in the
shard plus the tokens of the shards before: one number for each shard, summed on
the cluster.

Tokenizing gives the ids of the plain call of the library on the whole text.  The
first step of a byte-level BPE cuts a text where a letter is followed by anything
else, before the last character of white space in front of something else, and
after it if it is no space; ids never reach over such a cut, and what follows is
encoded as it would be alone.  Pieces between these cuts are found in the bytes of
many texts at once and looked up in a bounded table, and only new pieces go
through the tokenizer, many in one call.  Texts that hold one of the vocabulary's
own added strings go through whole, and so does every text if the tokenizer's
steps are not those that this rests on (``cuts_at_spaces``).

Defined cases: a null text is an empty one and gives the end id only; strings
that the tokenizer takes for special tokens become those tokens, as in the plain
call; rows with a null doc_id come first, equal ids and repeated rows are ordered
by text; very long texts are encoded whole, one at a time; an empty table gives no
shard; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, repair

END_ID = 0
SHARD_TOKENS = 1 << 20
#: Pieces kept by a worker; about 200 MB.
KEPT_PIECES = 700_000
#: Documents of a partition at least.
RANGE_DOCS = 2000
#: Shards whose starts are sent to all executors; more are joined.
SENT_SHARDS = 100_000
#: Text bytes encoded at a time.
CHUNK_BYTES = 4 << 20
#: Longer ones are not kept.
LONG = 64
_white = re.compile(r"[\s\x1c-\x1f\x85\u180e]")
#: A piece that can go through with others.
_plain = re.compile(r" ?[^\s\x1c-\x1f\x85\u180e]+")
#: What a byte may be: a letter; another character of one byte; white space, or what some take for it; the first byte of what may be white space; the first of a letter of two bytes.
_LETTER, _OTHER, _WHITE, _DOUBT, _LEAD = 1, 2, 4, 8, 16
_KINDS = np.zeros(256, np.uint8)
_KINDS[:0x80] = _OTHER
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] |= _WHITE
_KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = _DOUBT
#: Latin to U+017F but for two signs (bytes 0x97 and 0xB7 after 0xC3), Cyrillic to U+047F.
_KINDS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = _LEAD


class _Table(dict):
    """Numbers of pieces (bytes); a piece that is not there gets the next number and is noted."""

    def __init__(self):
        self.asked: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.asked.append(piece)
        return n


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 bytes of texts, one after another; ``starts`` are those of the texts that are not empty."""
    kind = _KINDS[data]
    letter = (kind & _LETTER).astype(bool)
    # The second byte of a letter of two.
    letter[1:] |= (kind[:-1] & _LEAD).astype(bool) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    np.logical_and(letter[:-1], kind[1:] & _OTHER, out=cut[1:])
    white = (data == 0x20) | (data == 0x0A)
    # White space at the end of a text is one step with what is before it.
    white[starts[1:] - 1] = False
    white[-1:] = False
    white = np.flatnonzero(white)
    after = kind[white + 1]
    apart = (after & _WHITE) == 0
    for k in np.flatnonzero(after & _DOUBT).tolist():
        at = int(white[k]) + 1
        apart[k] = not _white.match(data[at : at + (2 if data[at] == 0xC2 else 3)].tobytes().decode())
    white = white[apart]
    cut[white] = True
    cut[white[data[white] == 0x0A] + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut)


def cuts_at_spaces(steps: dict) -> bool:
    """Whether the steps of a tokenizer (its file) let pieces between cuts be encoded apart.

    So it is for a byte-level BPE with the usual pattern and nothing before or after it.
    """
    first, model = steps.get("pre_tokenizer") or {}, steps["model"]
    return (
        first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(steps.get(k) for k in ("normalizer", "truncation", "padding")) and not any(_white.search(t["content"]) for t in steps.get("added_tokens") or ())
    )


class Encoder:
    """Ids of texts as bytes (unsigned 16-bit, or 32-bit for larger vocabularies)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.pieces = cuts_at_spaces(steps)
        #: Strings that the tokenizer finds before all its steps.
        self.added = [t["content"] for t in steps.get("added_tokens") or () if t["content"]]
        self.vocab = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        self.newline = self.ids("\n")
        self._renew()

    def _renew(self) -> None:
        self.known = _Table()
        # Number 0 is the end of a text.
        self.known[b""] = 0
        self.start = np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)
        self.pool = np.zeros(1, self.kind)
        self.missed = 0

    def _whole(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        tail = [] if end_id is None else [end_id]
        parts = [np.array([*e.ids, *tail], self.kind) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(parts) if parts else np.empty(0, self.kind), np.fromiter(map(len, parts), np.int64, len(parts))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where each piece's begin and how many they are; many pieces go through in one text, parted by newlines."""
        words = [p.decode() for p in pieces]
        plain = np.fromiter((_plain.fullmatch(w) is not None for w in words), bool, len(words)) & (len(self.newline) == 1)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = np.count_nonzero(plain)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for at in range(0, n_plain, 1000):
            part = [words[k] for k in order[at : min(at + 1000, n_plain)].tolist()]
            got = np.array(self.tokenizer.encode_batch_fast(["\n".join([*part, ""])], add_special_tokens=False)[0].ids, self.kind)
            ends = got == self.newline[0]
            if np.count_nonzero(ends) == len(part):
                ids.append(got[~ends])
                sizes.append(np.diff(np.flatnonzero(ends), prepend=-1) - 1)
            else:
                alone = [self.ids(w) for w in part]
                ids += alone
                sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        alone = [self.ids(words[k]) for k in order[n_plain:].tolist()]
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        size, start = np.empty((2, len(words)), np.int64)
        size[order] = np.concatenate(sizes)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(ids + alone), start, size

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, and each text's number of ids; ``end_id`` follows each text.

        Pieces are numbered by a dictionary over all texts, so that each distinct
        piece is looked up once; the ids are then gathered in numpy.
        """
        texts = pc.fill_null(texts, "")
        if not self.pieces:
            return self._whole(texts, end_id)
        n_texts = len(texts)
        bounds = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy(zero_copy_only=False)), dtype=np.int64)
        _, offsets, held = texts.buffers()
        wide = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        first = int(np.frombuffer(offsets, wide, 1, texts.offset * wide.itemsize)[0]) if n_texts else 0
        data = np.frombuffer(held, np.uint8, int(bounds[-1]), first) if bounds[-1] else np.empty(0, np.uint8)
        cuts = _cuts(data, bounds[:-1][bounds[1:] > bounds[:-1]])
        edges = pa.py_buffer(np.append(cuts, len(data)).astype(wide))
        numbered = pa.Array.from_buffers(pa.large_binary() if wide.itemsize == 8 else pa.binary(), len(cuts), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        start, size, pool = self.start, self.size, self.pool
        if known.asked:
            ids, new, sizes = self._learn(known.asked)
            start, size, pool = np.append(start, len(pool) + new), np.append(size, sizes), np.append(pool, ids)
            self._keep(start, size, pool)
        # The pieces of each text, and its end.
        code = number[numbered.indices.to_numpy()]
        closing = np.searchsorted(cuts, bounds[1:])
        if end_id is not None:
            code = np.insert(code, closing, 0)
            closing += np.arange(1, n_texts + 1)
        n = size[code]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0)
        index += np.repeat(start[code] - (ends - n), n)
        out, upto = pool[index], np.append(0, ends)[closing]
        if end_id is not None:
            out[upto - 1] = end_id
        lengths = np.diff(upto, prepend=0)
        strange = np.zeros(n_texts, bool)
        for t in self.added:
            strange |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if strange.any():
            # Those texts go through whole.
            parts = np.split(out, upto[:-1])
            tail = [] if end_id is None else [end_id]
            for k in np.flatnonzero(strange).tolist():
                parts[k] = np.append(self.ids(texts[k].as_py()), np.array(tail, self.kind))
            out, lengths = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n_texts)
        return out, lengths

    def _keep(self, start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Takes over what was learned, given with all from before: pieces that are not long, while there is room."""
        known, old = self.known, len(self.start)
        asked, known.asked = known.asked, []
        room = old < KEPT_PIECES
        stay = [k for k, p in enumerate(asked) if len(p) <= LONG] if room else []
        if len(stay) == len(asked):
            self.start, self.size, self.pool = start, size, pool
            return
        for p in asked:
            del known[p]
        if room:
            known.update((asked[k], old + j) for j, k in enumerate(stay))
            took = old + np.array(stay, np.int64)
            kept = size[took]
            ends = np.cumsum(kept)
            self.start = np.append(self.start, len(self.pool) + ends - kept)
            self.pool = np.append(self.pool, pool[np.arange(int(kept.sum())) + np.repeat(start[took] - (ends - kept), kept)])
            self.size = np.append(self.size, kept)
            return
        # A full table serves on; it begins anew once it has missed several times its size.
        self.missed += len(asked)
        if self.missed > 8 * KEPT_PIECES:
            self._renew()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _by_ranges(rows: DataFrame, most: int) -> DataFrame:
    """Ascending ranges of doc_id, one a partition, of ``RANGE_DOCS`` documents or more.

    Bounds are quantiles of the id column, read without the texts.
    """
    if rows.schema["doc_id"].dataType.simpleString() not in ("bigint", "int"):
        return rows.repartitionByRange(most, "doc_id")
    grid = 1024
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(k / grid) for k in range(1, grid)]), F.lit(20 * grid))
    got = rows.agg(F.count(F.lit(1)).alias("n"), cuts.alias("b")).first()
    n = min(most, max(rows.sparkSession.sparkContext.defaultParallelism, -(-got["n"] // RANGE_DOCS)))
    if n > grid:
        return rows.repartitionByRange(n, "doc_id")
    bounds = sorted({got["b"][round(k * grid / n) - 1] for k in range(1, n)}) if got["b"] else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    return rows.repartitionById(n, F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int"))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, name: str = "token-shards") -> DataFrame:
    """Shards of whole texts in ascending order of doc_id: doc_ids, n_tokens, data, with part and place giving the order."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = _by_ranges(rows, common.shuffle_partitions(spark)).sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        enc = encoder(tokenizer_path)
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []
        place, part_no, tokens = 0, 0, 0

        def shard():
            data, counts = np.concatenate(held), np.concatenate(lengths)
            names = pa.concat_arrays(ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part_no], pa.int32()), pa.array([place], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                 pa.array([len(data)], pa.int64()), pa.array([repair.compress(data, counts, enc.vocab)], pa.binary())],
                names=["part", "place", "doc_ids", "n_tokens", "data"],
            )
            for x in (held, lengths, ids):
                x.clear()
            return out

        for batch in batches:
            if batch.num_rows:
                part_no = batch.column(2)[0].as_py()
            for rows in common.text_chunks(batch, ["doc_id", "text"], most=CHUNK_BYTES):
                got, n = enc.encode(rows.column(1), end_id)
                held.append(got)
                lengths.append(n)
                ids.append(rows.column(0))
                tokens += len(got)
                if tokens >= shard_tokens:
                    yield shard()
                    place, tokens = place + 1, 0
        if held:
            yield shard()

    made = common.small_batches(dealt).mapInArrow(run, f"part int, place int, doc_ids array<{kind}>, n_tokens long, data binary")
    return common.stored(made, name)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, place and ``shard_start``: tokens of all shards before.

    One number a shard (a million tokens each) is summed in two steps: within
    the part, and over the parts' totals.
    """
    sizes = shards.select("part", "place", "n_tokens")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    summed = sizes.select("part", "place", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("w"))
    return summed.join(before, "part").select("part", "place", (F.col("base") + F.col("w")).alias("shard_start"))


def read_index(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the shards where they are."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        # Whatever this worker has encoded before, its table is of no use here.
        _encoders.clear()
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0).slice(k, 1).flatten()
                shard = repair.Shard(batch.column(1)[k].as_py())
                data = shard.tokens().astype("<u4").tobytes()
                n = shard.where[:, 1]
                ends = np.cumsum(n)
                crc = [zlib.crc32(data[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                part, place = (pa.array(np.full(len(n), batch.column(c)[k].as_py(), np.int32)) for c in (2, 3))
                yield pa.RecordBatch.from_arrays(
                    [part, place, ids, pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "place", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("doc_ids", "data", "part", "place").mapInArrow(run, f"part int, place int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    starts = shard_starts(shards)
    if shards.select("part").count() <= SENT_SHARDS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["part", "place"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
