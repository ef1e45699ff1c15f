"""Small corpora with the odd rows every operator must take."""

import random

import pytest

WORDS = ["stone", "river", "lamp", "cloud", "quick", "amber", "seven", "north", "paper", "glass", "fern", "maple", "orbit",
         "candle", "meadow", "silver", "harbor", "thunder", "velvet", "willow"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, size long, text_key string, "
          "key string, unit string, score double, members string")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows_of(texts, ids=None, sources=("a", "b", None)):
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), "r", 1, "k", "x", "u", 0.5, "m")
            for k, (i, t) in enumerate(zip(ids, texts))]


def odd_texts():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:30] + prose(9, 90).split())
    long = prose(5, 6000)
    return [base, base, near, far, None, "", "   \n\t ", "one two three", "One two THREE", prose(2, 80), prose(2, 80) + " ",
            long, long + " tail", "ünïcode größe Ça va 日本語 テキスト", "x" * 500, prose(3, 40), prose(4, 5), None]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, a repeated row, a NULL id and clashing column names."""
    texts = odd_texts() + [odd_texts()[9], prose(8, 30)]
    ids = [*range(18), 9, None]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
