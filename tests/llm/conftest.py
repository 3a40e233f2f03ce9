from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; a table may have them too.
CLASHING = ("score", "fp", "fingerprint", "component_id", "tokens", "p", "topic", "rows", "__id", "part", "place", "data", "h1", "start", "label", "item_id", "id", "row", "u", "shard", "filter", "__source", "__lang", "__topic", "__tokens", "__p", "__rows", "__row", "__label", "__share")


@pytest.fixture
def docs(spark):
    def make(*rows, clash=False):
        full = [(i, t, *(more or ("en", "web"))[:2], len(t or "")) for i, t, *more in ((r[0], r[1], *r[2:]) for r in rows) for more in [tuple(more)]]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("mine") for c in CLASHING})
        return df

    return make


#: Null and empty texts, white space, no letters, strange characters, repeated rows, a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (5, "the cat sat on the mat and looked at the moon"), (5, "the cat sat on the mat and looked at the moon"),
    (6, "a b \x1c c d ퟿ \U0001f600 é"), (None, "no id but a text of its own"), (7, "line one is long\nline two is long\n\nline one is long", None, None),
]


@pytest.fixture
def odd(docs):
    return docs(*ODD)


@pytest.fixture
def odd_clashing(docs):
    return docs(*ODD, clash=True)


def long_text(words: int, seed: int = 1) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(words))
