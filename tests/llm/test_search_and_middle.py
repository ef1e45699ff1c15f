"""Fill-in-the-middle and lexical search against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelake.llm import fill_middle, lexical_search
from tests.llm.conftest import SCHEMA, odd_texts, prose, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_middle(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def mixed(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["ab", "Z", " ", "é", "日本", "😀", "\n", "7", "<", "P>", "ß", "<S", "x" * 5000]) for _ in range(n))


def test_middle_equals_plain(spark, odd):
    texts = [mixed(k, k * 7) for k in range(40)] + ["a<P>b", "<", "<M", "é", "😀😀", "\x00\x01", None, ""]
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts, range(100, 100 + len(texts))), SCHEMA))
    out = fill_middle.fill_in_middle(docs).withColumn("again", fill_middle.restored()).collect()
    want = Counter((r.doc_id, *plain_middle(r.doc_id, r.text), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert set(out[0].row.asDict()) == set(docs.columns) - {"text"}


def test_middle_of_a_very_long_text(spark):
    text = ("word é " * 400_000) + "end"
    docs = spark.createDataFrame([(k, text) for k in (4, 5)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, text)


def test_cuts_in_bytes_and_code_points():
    for seed in range(30):
        text = mixed(seed, 60)
        units = fill_middle.Units(text.encode())
        at = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert [units.chars(b) for b in at] == list(range(len(text) + 1))
        assert [units.bytes_of(k) for k in range(len(text) + 1)] == at


def test_middle_of_nothing(spark, none):
    assert fill_middle.fill_in_middle(none).collect() == []
    awkward = spark.createDataFrame([(1, "some text", 2)], "doc_id long, text string, `a b.c` int")
    assert fill_middle.fill_in_middle(awkward).first().row["a b.c"] == 2


def plain_search(docs, items, top=10):
    terms = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_docs, total = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t in items if t is not None}:
        asked = TERM.findall(text.translate(FOLD))
        ranked = []
        for d, c, n in terms:
            m = 100 - 75 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in asked if c[t])
            if score > 0:
                ranked.append((-score, d is None, d or 0, d))
        out.update((item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(ranked, key=lambda x: x[:3])[:top]))
    return out


def found(docs, items, **options):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(docs, items, **options).collect())


@pytest.fixture(scope="module")
def items(spark):
    texts = [odd_texts()[0], "stone river stone1", "Größe. ÜNÏCODE größe", "nothing_known_here", "", None, "日本語 テキスト",
             prose(2, 80), prose(2, 80), "one two THREE one", prose(2, 80)]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, None]
    return spark.createDataFrame([(i, t, 0, 0) for i, t in zip(ids, texts)], "item_id long, text string, doc_id int, score int")


def test_search_equals_plain(spark, odd, items):
    many = [prose(100 + k, 5 + k % 40) + " stone stone, Stone-river" * (k % 3) for k in range(150)]
    docs = odd.unionByName(spark.createDataFrame(rows_of(many, range(100, 250)), SCHEMA)).repartition(5)
    plain_docs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_search(plain_docs, [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    # Small slices mean more scans and the same rows.
    assert found(docs, items, slice_bytes=300) == want


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k % 15, "lamp cloud") for k in range(30)] + [(None, "lamp cloud"), (99, "fern")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "lamp lamp"), (2, "fern")], "item_id long, text string")
    assert found(docs, items) == plain_search([tuple(r) for r in docs.collect()], [(1, "lamp lamp"), (2, "fern")])
    assert [r.doc_id for r in lexical_search.search(docs, items).where("item_id = 1").orderBy("rank").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_search_of_nothing(spark, odd, none, items):
    assert found(none, items) == Counter()
    assert found(odd, items.where("false")) == Counter()
    assert found(odd.withColumn("text", F.lit(None).cast("string")), items) == Counter()


def test_words_are_guarded():
    scanner = lexical_search.Scanner([(1, "a ab b"), (2, "")])
    for text in ["a a a", "ab,a-b", "aab ba", "Ab\nA", "", "éa é a", "a" * 50]:
        want = Counter(t for t in TERM.findall(text.translate(FOLD)) if t in ("a", "b", "ab"))
        folded = lexical_search.guarded(text.encode())
        names = {k: t for t, k in scanner.terms.items()}
        assert Counter({names[k]: n for k, n in scanner.count(folded).items()}) == want
        assert lexical_search.count_terms(folded) == len(TERM.findall(text))
    assert np.array_equal(lexical_search.Scanner([(1, "")]).scores(Counter(), 30, []), [0])
