"""Language identification: multinomial naive Bayes over hashed character n-grams.

Model: for every language the smoothed log-probability of each hash bucket, over
character n-grams of one to ``max_n`` code points of the lower-cased text.  There
are ``2**bits`` buckets, fewer only if the languages times buckets would pass
``MODEL_BYTES``: so every language stays and the matrix can be broadcast.

Scoring is done in numpy over sparse counts: the n-grams of many texts are hashed
at once and counted by text and bucket; each count that occurs is multiplied with
its bucket's row of the matrix and summed by text, in blocks of bounded length,
whatever the length of a text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
training rows with a null language, text or id are left out, one text is learned
from for each id; with no training row at all every document is ``und``, and
``keep_identified`` keeps none; of equally likely languages the first by name is
taken; repeated rows are each predicted; an empty table gives no row; other
columns, whatever their names, are ignored by ``predict`` and kept by
``keep_identified``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points hashed at a time.
BLOCK = 1 << 19
#: Of the matrix: 256 languages with 65,536 buckets.
MODEL_BYTES = 64 << 20
UND = "und"
_letter = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: buckets x languages, float32
    logp: np.ndarray
    prior: np.ndarray
    max_n: int

    @property
    def bits(self) -> int:
        return int(self.logp.shape[0]).bit_length() - 1


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point but the last n - 1."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    h = codes[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
    for k in range(1, n):
        h ^= h >> np.uint32(15)
        h = (h + codes[k : m + k]) * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def _blocks(codes: np.ndarray, overlap: int):
    """Pieces of a long text; n-grams that begin in a piece end in it."""
    for at in range(0, max(1, len(codes)), BLOCK):
        yield codes[at : at + BLOCK + overlap], min(BLOCK, len(codes) - at)


def fit(docs: DataFrame, per_lang: int = 4000, max_n: int = 3, bits: int = 16, alpha: float = 0.5) -> Model:
    """Counts over a sample of at most ``per_lang`` documents of each language.

    ``docs`` holds the rows that may be learned from (doc_id, text, lang).  The
    counts are summed by task, so that what comes back is one vector for each
    language and no text.
    """
    sample = common.bounded_sample(docs.where("text is not null"), "lang", per_lang)
    rows = common.stored(common.sample_texts(docs, sample, "lang"), "lang-sample")
    n_langs = rows.select("lang").distinct().count()
    while bits > 1 and (n_langs << bits) * 4 > MODEL_BYTES:
        bits -= 1
    size = 1 << bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or lang is None or not _letter.search(text):
                    continue
                got = sums.setdefault(lang, np.zeros(size, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for piece, fresh in _blocks(_codes(text), max_n - 1):
                    for n in range(1, max_n + 1):
                        got += np.bincount(_hashes(piece, n, bits)[:fresh], minlength=size)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": got[at], "docs": np.where(np.arange(len(at)) == 0, seen[lang], 0)})

    counted = (
        common.small_batches(rows).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long, docs long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    )
    langs = sorted(counted["lang"].unique())
    dense = np.zeros((size, len(langs)))
    docs_of = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        part = counted[counted["lang"] == lang]
        dense[part["bucket"].to_numpy(), k] = part["n"].to_numpy()
        docs_of[k] = part["docs"].sum()
    logp = np.log(dense + alpha) - np.log(dense.sum(axis=0) + alpha * size) if langs else dense
    return Model(langs, np.ascontiguousarray(logp.astype(np.float32)), np.log(docs_of / docs_of.sum()) if langs else docs_of, max_n)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    out, scores = [UND] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t is not None and model.langs and _letter.search(t)]
    total = np.zeros((len(rows), len(model.langs)))
    held: list[np.ndarray] = []
    fresh: list[int] = []
    of: list[int] = []

    def flush():
        if not held:
            return
        codes = np.concatenate(held)
        starts = np.cumsum([0, *map(len, held)])[:-1]
        ends = np.append(starts[1:], len(codes))
        row = np.repeat(np.array(of, np.uint64) << np.uint64(model.bits), np.diff(np.append(starts, len(codes))))
        keys = []
        for n in range(1, model.max_n + 1):
            h = _hashes(codes, n, model.bits)
            # An n-gram counts once, for the piece in which it begins, if it ends in the same text.
            counts = np.zeros(len(codes) + 1, np.int8)
            lo = np.minimum(starts, len(h))
            hi = np.minimum(np.maximum(np.minimum(starts + fresh, ends - n + 1), starts), len(h))
            np.add.at(counts, lo, 1)
            np.add.at(counts, hi, -1)
            inside = np.cumsum(counts[: len(h)], dtype=np.int8).astype(bool)
            keys.append((row[: len(h)] | h)[inside])
        # The sparse counts: texts and buckets that occur, and how often.
        key = np.sort(np.concatenate(keys))
        held.clear()
        fresh.clear()
        of.clear()
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(first, len(key)))
        key = key[first]
        text = (key >> np.uint64(model.bits)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        weighed = model.logp[(key & np.uint64((1 << model.bits) - 1)).astype(np.int64)] * many[:, None]
        total[text[new]] += np.add.reduceat(weighed, new, axis=0, dtype=np.float64)

    room = 0
    for r, i in enumerate(rows):
        for piece, new in _blocks(_codes(texts[i]), model.max_n - 1):
            held.append(piece)
            fresh.append(new)
            of.append(r)
            room += len(piece)
            if room >= BLOCK:
                flush()
                room = 0
    flush()
    if rows:
        total += model.prior
        best = total.argmax(axis=1)
        p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for r, i in enumerate(rows):
            out[i], scores[i] = model.langs[best[r]], p[r]
    return out, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``; whole texts are read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        lang, p = score_texts(held.value, batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(p, pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs, ["doc_id", "text"], score, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a probability of ``least``; all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            for part in common.text_chunks(batch, columns):
                lang, p = score_texts(held.value, part.column(at).to_pylist())
                keep = (p >= least) & (np.array(lang, dtype=object) != UND)
                if keep.any():
                    yield part if keep.all() else part.filter(pa.array(keep))

    return common.small_batches(docs).mapInArrow(run, docs.schema)
