"""Toxicity, quality and URL filters: marginals by enumeration, held-out labels, rules and odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelake.llm import quality, toxicity, url_filter
from tests.llm.conftest import SCHEMA, prose, rows_of


def labelled(spark, texts, marks, column):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    other = {"toxic": "quality", "quality": "toxic"}[column]
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], f"doc_id long, {column} int, {other} int")
    return docs, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    weights = np.array([-1.0, 0.5, 1.0, 2.0, 3.0])
    chain = toxicity.Chain({}, weights, rng.normal(size=(2, 2)), np.zeros(4))
    for _ in range(30):
        n = int(rng.integers(1, 9))
        levels = [int(x) for x in rng.integers(0, 3, n)]
        total, on = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(weights[x] * s for x, s in zip(levels, states))
                         + sum(chain.move[a, b] for a, b in zip(states, states[1:])))
            total += w
            on += w * np.array(states)
        places = [i for i, x in enumerate(levels) if x]
        got = chain.marginals(places, [levels[i] for i in places], n)
        assert np.allclose(got, (on / total)[places], atol=1e-9)


@pytest.fixture(scope="module")
def toxic_data(spark):
    r = random.Random(3)
    texts, marks = [], []
    for k in range(240):
        words = prose(k + 500, 60).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["blorgy", "snarvish", "gritzle"]))
        texts.append(" ".join(words))
        marks.append(int(k % 3 == 0))
    return labelled(spark, texts, marks, "toxic") + (texts, marks)


def test_toxicity_on_held_out(spark, toxic_data, odd):
    docs, labels, texts, marks = toxic_data
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    right = sum((out[k].score >= 0.5) == bool(m) for k, m in enumerate(marks))
    assert right >= 0.98 * len(marks)
    spans = {texts[k].lower()[s.start:s.end] for k in out for s in out[k].spans}
    assert spans == {"blorgy", "snarvish", "gritzle"}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in out.values())
    rows = toxicity.toxicity(odd, labels.where("doc_id > 100")).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)


def test_labels_missing_or_of_one_kind(spark, odd, none, toxic_data):
    _, labels, _, _ = toxic_data
    assert all(r.score == 0 for r in toxicity.toxicity(odd, labels.limit(0)).collect())
    assert all(r.score == 0 for r in toxicity.toxicity(odd, labels.where("toxic = 0")).collect())
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


def test_quality_on_held_out(spark, odd, none):
    texts = [prose(k, 60) if k % 2 else " ".join(w.upper() + "$$$ ***" for w in prose(k, 40).split()) for k in range(200)]
    docs, labels = labelled(spark, texts, [k % 2 for k in range(200)], "quality")
    out = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert all((out[k] >= 0.3) == bool(k % 2) for k in range(200))
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in quality.quality(odd, labels.limit(0)).collect())
    assert all(r.score > 0.99 for r in quality.quality(odd, labels.where("quality = 1")).collect())
    assert quality.quality(none, labels).count() == 0


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1?x=/fr/#y", "https://www.example.com/en/2", "http://net/es/", "http://x.net/fr",
            "http://x.net/fr/é", "http://example.com", "http://com/", "http://xcom/", "ftp://u@h.com:80/p", "a://b://c/d", "http://x.org/?q",
            "http://x.org#f/g"]
    urls += [f"http://good{k}.example.com/de/{k}" for k in range(30)] + [f"http://bad{k}.spam.net/es/{k}" for k in range(30)]
    urls += ["http://good7.example.org/de/5", "http://bad7.spam.biz/es/5", "http://x.net/fr/é"]
    pages = spark.createDataFrame([(i, u, "h", 1.0, "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string, score double, gram string")
    out = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(out) == len(urls)
    for k, url in enumerate(urls):
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (out[k].host, out[k].path) == (host, path)
        assert out[k].rule == (max(fits)[1] if fits else None)
        if fits:
            assert out[k].verdict == max(fits)[2]
        assert out[k].verdict in ("allow", "block")
    assert out[75].verdict == "allow" and out[76].verdict == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_scores_equal_a_plain_model(spark):
    urls = [f"http://a{k}.x.com/p{k % 7}" for k in range(25)] + [f"http://b{k}.y.net/fr/{k % 5}" for k in range(25)] + ["http://z.org/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.judge(pages).collect()}
    import zlib
    order, counts = url_filter.ORDER, {"allow": {}, "block": {}}
    for k, url in enumerate(urls[:50]):
        if zlib.crc32(str(k).encode()) % 5:
            text = url_filter.START * order + url
            for i in range(order, len(text)):
                for n in range(order + 1):
                    own = counts["allow" if k < 25 else "block"].setdefault(text[i - n:i], {})
                    own[text[i]] = own.get(text[i], 0) + 1

    def chance(kind, context, char):
        shorter = chance(kind, context[1:], char) if context else 1.0 / url_filter.ALPHABET
        own = counts[kind].get(context)
        return (own.get(char, 0) + len(own) * shorter) / (sum(own.values()) + len(own)) if own else shorter

    for k, url in enumerate(urls):
        text = url_filter.START * order + url
        ratios = [math.log(chance("allow", text[i - order:i], text[i]) / chance("block", text[i - order:i], text[i]))
                  for i in range(order, len(text))]
        assert got[k] == pytest.approx(sum(ratios) / len(ratios), abs=1e-6)


def test_toxicity_takes_clashing_names_and_repeated_ids(spark, toxic_data):
    docs, labels = toxic_data[:2]
    want = {(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, labels).collect()}
    clash = docs.withColumns({c: F.lit(1) for c in ("_id", "_y", "t", "_text", "_score", "toxic")})
    marks = labels.withColumns({c: F.lit("x") for c in ("_id", "_y", "t", "_text")})
    assert {(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(clash, marks).collect()} == want
    assert set(toxicity.drop_toxic(clash, marks).columns) == set(clash.columns)
    other = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" zz"))))
    first, again = (sorted(toxicity.labelled_sample(d, labels)) for d in (other, other.repartition(7)))
    assert first == again


def test_spans_are_offsets_into_the_text():
    chain = toxicity.Chain({"=vile": 6.0, "vil": 6.0}, np.array([-3.0, 1, 1, 1, 4.0]), np.zeros((2, 2)), np.array([0.0, 1, 0, 0]))
    text = "İİİ some VILE word"
    assert [text[a:b] for a, b in chain.judge(text)[1]] == ["VILE"]
