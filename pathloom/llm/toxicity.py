"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding: lower case; letters that Unicode writes as another letter's form
(mathematical, fullwidth, with marks) become that letter, marks over letters and
invisible characters go; look-alike letters of other scripts and marks used as
letters become the Latin letter; digits that stand for letters beside a letter
become those letters; all that is no letter becomes one space.

Lexicon: word beginnings of ``SHORTEST`` to ``LONGEST`` letters and whole words
that a toxic document holds far more often than a clean one (in learning, at most
``MOST_A_DOC`` occurrences in a document count, so that one document makes no
entry), each with the log of that ratio as weight.  A beginning stands for a family
of word forms; longer entries are kept only where they say more than a shorter one.
Exception phrases are pairs of neighbouring words that hold an entry and occur in
clean documents only: an entry covered by one does not count.

Score: a logistic model of the summed weight, of the weight for each hundred
words (the normalisation by length) and of the number of different entries.

The lexicon is fitted on a sample bounded by ``per_class``; the model is bounded
by ``MAX_ENTRIES`` entries (those of most weight) and ``MAX_PHRASES`` phrases (the
most frequent), so the automaton can be broadcast.  A text is matched whole, in one
pass whose time goes with its length and its matches.

Defined cases: null and empty texts are scored as texts without an entry; with
labels of one class only the score is that class's share; equal weights are put in
the order of the entries; repeated rows are each scored, and one text is learned
from for each id; an empty table of documents gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHORTEST, LONGEST = 3, 12
MAX_ENTRIES, MAX_PHRASES = 20_000, 20_000
#: Occurrences in a document that count.
MOST_A_DOC = 5
#: Least log ratio of an entry, and how much more a longer entry must say.
LEAST_WEIGHT, MORE = 1.5, 0.7

# Look-alikes of Latin letters (Cyrillic, Greek) and marks used as letters.
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
_MARKS = {"@": "a", "$": "s"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Marks that stand over or under letters, and invisible characters.
_gone = re.compile("[̀-ͯ⃐-⃿­​-‏⁠﻿]")
_digit_in_word = re.compile(r"[013457]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+")
_mark_in_word = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_no_letter = re.compile(r"[\W\d_]+")


_FOLD = {ord(k): v for k, v in _LOOKALIKE.items()}
_as_letters = str.maketrans(_DIGITS)
_marks = str.maketrans(_MARKS)


def fold(text: str) -> str:
    """Folded words with one space before, between and after."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = _gone.sub("", text).lower().translate(_FOLD)
    text = text.lower()
    if "@" in text or "$" in text:
        text = _mark_in_word.sub(lambda m: m[0].translate(_marks), text)
    text = _digit_in_word.sub(lambda m: m[0].translate(_as_letters), text)
    return f" {_no_letter.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries begin with a space; one that ends with a space is a whole word."""

    entries: dict[str, float]
    phrases: frozenset[str] = frozenset()
    model: np.ndarray | None = None
    base_rate: float = 0.0
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    def automaton(self):
        if self._auto is None:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for k, w in self.entries.items():
                auto.add_word(k, (len(k), w, k))
            for p in self.phrases:
                auto.add_word(p, (len(p), None, p))
            if len(auto):
                auto.make_automaton()
            self._auto = auto
        return self._auto

    def matches(self, folded: str) -> list[tuple[int, float, str]]:
        """Start, weight and entry at each word: its longest entry, unless an exception phrase covers the word."""
        if not self.entries:
            return []
        best: dict[int, tuple[int, float, str]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, weight, entry) in self.automaton().iter(folded):
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            elif start not in best or size > best[start][0]:
                best[start] = (size, weight, entry)
        starts = sorted(best)
        if covered and starts:
            # Phrases overlap by a word at most a few times: one walk over words and phrases in order.
            covered.sort()
            free, k, upto = [], 0, -1
            for s in starts:
                while k < len(covered) and covered[k][0] <= s:
                    upto = max(upto, covered[k][1])
                    k += 1
                if s >= upto:
                    free.append(s)
            starts = free
        return [(s, best[s][1], best[s][2]) for s in starts]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Rows of log summed weight, log weight a hundred words, log different entries, 1."""
        x = np.zeros((len(texts), 4))
        x[:, 3] = 1
        for k, text in enumerate(texts):
            if not text:
                continue
            folded = fold(text)
            found = self.matches(folded)
            if found:
                total = sum(w for _, w, _ in found)
                x[k, :3] = np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1)), np.log1p(len({e for _, _, e in found}))
        return x

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.base_rate)
        return common.sigmoid(self.features(texts) @ self.model)


def _beginnings(words: list[str]) -> dict[str, int]:
    """Entries that a document's words allow, with their occurrences up to MOST_A_DOC."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[f" {w[:k]}"] += n
        if len(w) >= 2:
            out[f" {w} "] += n
    return {e: min(n, MOST_A_DOC) for e, n in out.items()}


def _least(toxic: int) -> int:
    """Occurrences in toxic documents below which a candidate is left to chance."""
    return max(4, round(0.008 * toxic))


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries from (candidate, occurrences in toxic documents, in clean ones)."""
    least = _least(toxic)
    weight = {}
    for entry, t, c in counts:
        if t >= least:
            w = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
            if w >= LEAST_WEIGHT:
                weight[entry] = float(w)
    kept: dict[str, float] = {}
    for entry in sorted(weight, key=lambda e: (len(e), e)):
        if all(kept.get(entry[:n], -9.0) < weight[entry] - MORE for n in range(SHORTEST + 1, len(entry))):
            kept[entry] = weight[entry]
    top = sorted(kept, key=lambda e: (-kept[e], e))[:MAX_ENTRIES]
    return {e: kept[e] for e in top}


def _count(rows: DataFrame, candidates, schema_name: str) -> DataFrame:
    """Counts of candidates in the documents of each class: summed in each task, then on the cluster."""

    def run(batches):
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    sums[1 if toxic else 0].update(candidates(fold(text)))
        for k, c in enumerate(sums):
            names = list(c)
            for at in range(0, len(names), 1 << 16):
                part = names[at : at + (1 << 16)]
                n = [c[x] for x in part]
                zero = [0] * len(part)
                yield pa.RecordBatch.from_pydict({schema_name: part, "t": n if k else zero, "c": zero if k else n})

    return common.small_batches(rows).select("text", "label").mapInArrow(run, f"{schema_name} string, t long, c long").groupBy(schema_name).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000) -> Lexicon:
    """Lexicon and model from labelled documents: ``labels`` (doc_id and the label) holds the rows to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    share = {int(r[0]): r["n"] for r in known.groupBy((F.col(label) > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        return Lexicon({}, base_rate=share.get(1, 0) / total if total else 0.0)
    sample = common.bounded_sample(known.select("doc_id", (F.col(label) > 0).cast("int").alias("label")), "label", per_class)
    rows = common.stored(common.sample_texts(docs, sample, "label"), "toxic-sample")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return Lexicon({}, base_rate=share[1] / total)

    counts = _count(rows, lambda folded: _beginnings(folded.split()), "entry").where(F.col("t") >= _least(size[1]))
    entries = _lexicon([(r["entry"], r["t"], r["c"]) for r in counts.toLocalIterator()], size[1], size[0])
    lexicon = Lexicon(entries)

    def phrases(folded: str) -> set[str]:
        out = set()
        for start, _, _ in lexicon.matches(folded):
            end = folded.index(" ", start + 1)
            nxt = folded.find(" ", end + 1)
            if nxt > 0:
                out.add(folded[start : nxt + 1])
            prev = folded.rfind(" ", 0, start)
            if prev >= 0:
                out.add(folded[prev : end + 1])
        return out

    ratio = np.log((size[0] + 1) / (size[1] + 1))
    found = _count(rows, phrases, "phrase").where(F.col("c") >= 3).where(F.log((F.col("c") + 0.5) / (F.col("t") + 0.5)) - F.lit(float(ratio)) > 1.0)
    lexicon.phrases = frozenset(r["phrase"] for r in found.orderBy(F.desc("c"), "t", "phrase").limit(MAX_PHRASES).collect())
    lexicon._auto = None

    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches):
        for batch in batches:
            x = sent.value.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k].copy()) for k in range(4)), batch.column(1)], names=["a", "b", "c", "d", "label"])

    got = common.small_batches(rows).mapInArrow(features, "a double, b double, c double, d double, label int").toPandas()
    x, y = got[["a", "b", "c", "d"]].to_numpy(), got["label"].to_numpy().astype(float)
    weight = np.where(y > 0, share[1] / size[1], share[0] / size[0])
    lexicon.model = common.logistic_fit(x, y, weight / weight.mean())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch):
        return {"doc_id": batch.column(0), "score": pa.array(sent.value.score(batch.column(1).to_pylist()), pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs, ["doc_id", "text"], run, f"doc_id {kind}, score double")
