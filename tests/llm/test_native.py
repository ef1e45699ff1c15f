"""Mixing, exact deduplication, sharding and licence scans against plain computations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from farelake.llm import exact_dedup, licences, mixing, queries, sharding
from tests.llm.conftest import SCHEMA, prose, rows_of
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    message, rows, _ = compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert message is None and rows > 0


def test_exact_groups(odd):
    data = odd.collect()
    groups = defaultdict(list)
    for r in data:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()
        groups[digest].append(r)
    out = exact_dedup.exact_groups(odd, carry=("row", "size")).collect()
    assert len(out) == len(data)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(groups.keys())
    for r in out:
        own = groups[r.text_sha256]
        best = min(own, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.keep_id, r.group_size) == (best.doc_id, len(own))


def test_hot_digest_is_split_off(spark):
    texts = ["same text"] * 400 + [prose(k, 6) for k in range(200)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(7)
    out = exact_dedup.exact_groups(docs).collect()
    assert sum(r.kept for r in out) == 201
    assert {r.group_size for r in out} == {400, 1}


def test_targets_and_cut(odd):
    out = mixing.mix(odd, carry=()).collect()
    by_source = defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by_source.items()}
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, caps, left = {}, dict.fromkeys(order, False), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if not caps[s]]
        total = sum(weights[s] for s in open_)
        budget = left - sum(2.0 * sizes[s] for s in order if caps[s])
        over = [s for s in open_ if budget * weights[s] / total > 2.0 * sizes[s]]
        if not over:
            break
        caps.update(dict.fromkeys(over, True))
    for s in order:
        want[s] = 2.0 * sizes[s] if caps[s] else budget * weights[s] / total
        assert by_source[s][0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in by_source[s]) - want[s]) <= 0.5 + len(by_source[s])
    again = mixing.mix(odd.repartition(5), carry=()).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_mixed_documents_keep_columns(odd):
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns
    assert max(Counter(r.text for r in out.collect() if r.text and r.doc_id not in (0, 1, 9)).values()) <= 2


def test_shards(odd):
    data = Counter((r.doc_id, r.text) for r in odd.collect())
    rows = sharding.shard_documents(odd, shards=5, carry=None).collect()
    assert Counter((r.doc_id, r.row.text) for r in rows) == data
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    homes = defaultdict(set)
    for r in rows:
        text = (r.row.text or "").encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        homes[text].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())


def test_capacity_is_smallest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 30, rng.integers(1, 12))
        shards = int(rng.integers(1, 5))
        prefix = np.concatenate([[0], np.cumsum(sizes)])

        def runs(capacity):
            count, fill = 1, 0
            for s in sizes:
                if fill + s > capacity:
                    count, fill = count + 1, 0
                fill += s
            return count

        best = next(c for c in range(int(sizes.max()), int(sizes.sum()) + 1) if runs(c) <= shards)
        assert sharding.smallest_capacity(prefix, 0, shards) == best
        cut = sharding.cut_units(sizes, shards)
        assert (np.diff(cut) >= 0).all() and cut.max() < shards
        assert max(sizes[cut == k].sum() for k in range(shards)) == best


@pytest.mark.parametrize("docs,shards,copies", [(3000, 7, 0), (400, 40, 0), (900, 5, 700), (30, 40, 0), (250, 12, 90)])
def test_capacity_is_smallest_over_groups(spark, docs, shards, copies, monkeypatch):
    """The largest shard is as large as a search over all ordered groups makes it, also where ranges hold many groups."""
    monkeypatch.setattr(sharding, "UNIT_DIGITS", 1)
    texts = [prose(n, 1 + n * n % 61) for n in range(docs)] + [prose(1, 20)] * copies + [None, "", ""]
    rows = sharding.shard_documents(spark.createDataFrame(rows_of(texts), SCHEMA), shards=shards).collect()
    assert len(rows) == len(texts)
    size, home, load = Counter(), defaultdict(set), Counter()
    for r in rows:
        digest = hashlib.md5((texts[r.doc_id] or "").encode()).hexdigest()
        size[digest] += r["size"]
        home[digest].add(r.shard)
        load[r.shard] += r["size"]
    total = sum(size.values())
    order = sorted(size, key=lambda d: (size[d] * shards <= total, d))
    prefix = np.concatenate([[0], np.cumsum([size[d] for d in order])])
    assert max(load.values()) == sharding.smallest_capacity(prefix, 0, shards)
    homes = [next(iter(home[d])) for d in order]
    assert all(len(h) == 1 for h in home.values()) and homes == sorted(homes) and homes[-1] < shards
    for shard in load:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_licences(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "x All rights reserved. ALL RIGHTS RESERVED", None, "", "all the rights reserved",
             "This work is licensed under the GNU General Public License, version 3.", "cc by", "general public", "ccby cc  by",
             "Released under the MIT License.", "a license of sorts", "ÀCC BY", prose(1, 50), "İ publİc Kelvin license"]
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows_of(texts), SCHEMA), carry=("row",)).collect()}
    for k, text in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in licences.BASE:
            own = phrase.split()
            here = [i for i in range(len(words)) if words[i:i + len(own)] == own]
            places += here
            labels |= {label} if here else set()
        r = out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == sorted(labels) and labels <= set(r.labels) and 0 <= r.score <= 1
    assert out[0].labels == ["cc-by", "cc-by-nc"] and out[5].labels == ["gpl"] and out[9].labels == ["mit"]
    assert out[12].labels == [] and out[10].labels == []


@pytest.mark.parametrize("run", [
    exact_dedup.exact_groups, mixing.mix, mixing.mix_documents, sharding.shard_documents, licences.scan])
def test_no_rows(none, run):
    assert run(none).count() == 0


def plain_labels(text, weight, least=licences.LEAST_SCORE):
    """The method's labels and the best score of a text, by looking at every start."""
    words = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    labels, best = set(), 0.0
    for label, template, key in licences.TEMPLATES:
        t, k = template.split(), key.split()
        offset = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
        needed = [(i, w) for i, w in enumerate(k) if w in licences.VOCABULARY]
        for start in range(-len(t), len(words)):
            at = lambda i: words[start + i] if 0 <= start + i < len(words) else None
            if all(at(offset + i) == w for i, w in needed):
                mine = [(i, w) for i, w in enumerate(t) if w in weight]
                score = sum(weight[w] for i, w in mine if at(i) == w) / sum(weight[w] for _, w in mine)
                best = max(best, score)
                if score >= least:
                    labels.add(label)
    return labels, best


def test_licence_labels_equal_plain(spark):
    r = __import__("random").Random(4)
    texts = []
    for n in range(120):
        parts = [prose(700 + n, r.randrange(0, 12))]
        for _ in range(r.randrange(0, 4)):
            t = r.choice(licences.TEMPLATES)[1].split()
            if r.random() < 0.4:
                t[r.randrange(len(t))] = "lamp"
            parts += [" ".join(t).upper() if r.random() < 0.3 else " ".join(t), prose(900 + n, r.randrange(0, 5))]
        texts.append(r.choice([" ", ", ", "\n"]).join(parts))
    texts += ["License mit", "MIT license. Mozilla public license; " * 3, None, ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    weight = licences.word_weights(licences.licence_words(docs))
    for row in licences.scan(docs).collect():
        labels, best = plain_labels(texts[row.doc_id], weight)
        assert set(row.labels) - set(row.base_labels) == labels - set(row.base_labels), texts[row.doc_id]
        assert row.base_labels or abs(row.score - (best if best >= licences.LEAST_SCORE else 0.0)) < 1e-9


def test_joined_licences_keep_their_labels_and_long_ones_end(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Released under the MIT license."
    mpl = "This file is subject to the terms of the Mozilla Public License, with source and binary forms, without modification."
    long = "licensed under the mit license " * 40_000
    docs = spark.createDataFrame(rows_of([mit, mpl, mit + " " + mpl, long]), SCHEMA)
    out = {r.doc_id: set(r.labels) for r in licences.scan(docs).collect()}
    assert "mit" in out[0] and "mpl" in out[1] and out[2] >= out[0] | out[1] and out[3] == {"mit"}
