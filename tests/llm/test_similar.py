"""Near copies, repeated strings and benchmark leaks against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from farelake.llm import decontaminate, near_dedup, partenum, suffix_dedup, suffix_groups
from farelake.llm.components import components
from tests.llm.conftest import SCHEMA, prose, rows_of


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)])


def brute_components(rows):
    sets = [shingles(r.text) for r in rows]
    home = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = home[a], home[b]
                home = [new if h == old else h for h in home]
    ids = {}
    for k, h in enumerate(home):
        if rows[k].doc_id is not None:
            ids[h] = min(ids.get(h, rows[k].doc_id), rows[k].doc_id)
    return Counter((rows[k].doc_id, len(sets[k]), ids.get(h)) for k, h in enumerate(home))


def variants(seed, n, words=90):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(r.randrange(0, 8)):
            own[r.randrange(len(own))] = f"edit{r.randrange(1000)}"
        out.append(" ".join(own))
    return out


def test_near_groups(spark, odd):
    assert Counter(map(tuple, near_dedup.near_groups(odd).select("doc_id", "n_shingles", "component_id").collect())) == \
        brute_components(odd.collect())
    line = " ".join(prose(77, 60).split())
    texts = variants(11, 40) + variants(12, 25, 20) + [prose(k + 100, 30) + " " + line for k in range(30)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = near_dedup.near_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(docs.collect())


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for size in (3, 4, 7, 8, 9, 20, 21, 50, 130, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            cut = int(rng.integers(0, size // 4 + 1))
            more = int(rng.integers(0, size // 4 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))
                x, y = near_dedup.sketch(a), near_dedup.sketch(b)
                n = min(len(x), len(y))
                differ = np.abs(near_dedup._folded(x, n) - near_dedup._folded(y, n)).sum()
                assert differ <= len(np.setxor1d(a, b)) and near_dedup._may_link(len(a), len(b), differ, 75)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (200, 201)]
    out = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {
        **{i: 0 for i in range(61)}, 100: 100, 105: 100, 103: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(odd):
    rows = odd.collect()
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    bare = [r for r in rows if not shingles(r.text)]
    groups = {c for _, n, c in brute_components(rows) if n}
    assert len(left) == len(groups) + len(bare)


def test_suffix_array():
    r = random.Random(4)
    for _ in range(500):
        text = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randrange(0, 25))]
        order = suffix_groups.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        longest = suffix_groups.neighbour_overlaps(text, order)
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                h = 0
                while i != j and max(i, j) + h < len(text) and text[i + h] == text[j + h]:
                    h += 1
                best = max(best, h)
            assert longest[i] == best


def brute_cut(texts):
    where = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if where[t[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check_cut(docs):
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_cut([(r.text or "").encode() for r in rows])))
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    got = Counter()
    for r in suffix_dedup.remove_repeats(docs).collect():
        kept = text[r.doc_id] if r.kept is None else bytes(r.kept)
        got[(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, kept)] += 1
    assert got == want


def test_repeats(spark, odd, monkeypatch):
    check_cut(odd)
    shared = [prose(k, 45) for k in range(3)]
    texts = []
    for k in range(40):
        part = shared[k % 3].encode()[k:k + 201 + k % 40].decode()
        texts.append(prose(300 + k, 20) + part + prose(400 + k, 15) + (shared[1][:199] if k % 5 == 0 else ""))
    texts += ["ab" * 300, "é" * 150, shared[0][:200], shared[0][:200]]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    check_cut(docs)
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    check_cut(docs)


def test_long_texts_in_stretches(monkeypatch):
    data = np.frombuffer((prose(1, 500) + prose(2, 300) + prose(1, 500)).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, len(data)]))
    starts = {s for f, l in zip(whole[1], whole[2]) for s in range(f, l + 1)}
    assert starts == set(range(len(data) - 199))


ITEMS = [(1, "Who built the old stone bridge over the amber river near willow harbor? The mason Orsolo built it in spring."),
         (2, prose(50, 40) + ". " + prose(51, 10) + "."), (3, None), (4, ""), (5, prose(52, 150))]


def test_leaks(spark, odd):
    texts = [prose(1, 200) + " " + ITEMS[0][1] + " " + prose(2, 100), prose(3, 90) + " " + ITEMS[1][1].upper(), prose(4, 300),
             ITEMS[0][1].split("?")[0], ITEMS[4][1] + " " + prose(6, 20), None, ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(0, 1), (1, 2), (4, 5)}
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6}
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_wand_finds_all_above_threshold():
    r = random.Random(8)
    items = [(k, prose(k % 9, r.randrange(5, 30))) for k in range(60)]
    df = Counter(int(w) for _, t in items for w in np.unique(decontaminate.words_of(t)))
    index = decontaminate.Index(items, df, len(items), 15.0)
    flat = {(s, t): w for t, rows in enumerate(index.postings) for s, w in rows}
    for q in range(40):
        words = decontaminate.words_of(prose(q % 12, 200))
        got = {(s, p): score for s, score, p in index.search(words, 0.4)}
        want = {}
        for p in range(-(-len(words) // index.segment)):
            part = set(np.searchsorted(index.terms, w) for w in words[p * index.segment:(p + 2) * index.segment] if w in index.terms)
            for s in range(len(index.item_ids)):
                score = sum(flat.get((s, t), 0.0) for t in part)
                if score >= 0.4 - decontaminate.ROUNDING:
                    want[(s, p)] = score
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_no_rows(spark, none):
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.drop_near_copies(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def made_items(n: int):
    """Items of 5 to 200 words whose last sentence, the answer, has 1 to 12 words."""
    r = random.Random(77)
    out = []
    for k in range(n):
        size, answer = r.randrange(5, 201), r.randrange(1, 13)
        words = prose(5000 + k, size).split()
        answer = min(answer, size // 2)
        out.append((k, " ".join(words[:size - answer]) + r.choice(["? ", ". ", "?\n"]) + " ".join(words[size - answer:]) + r.choice([".", ""])))
    return out


def test_whole_copies_are_found(spark):
    items = made_items(150)
    r = random.Random(5)
    texts = []
    for k, (_, text) in enumerate(items):
        alone = k % 3 == 0
        texts.append(text.upper() if alone else f"{prose(9000 + k, r.randrange(0, 200))} {text} {prose(9500 + k, r.randrange(0, 90))}")
    clean = [prose(20_000 + k, 150) for k in range(30)]
    docs = spark.createDataFrame(rows_of(texts + clean), SCHEMA)
    found = decontaminate.leaks(docs, spark.createDataFrame(items + items[:20], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(k, k) for k in range(150)}


def test_question_and_answer_are_both_needed(spark):
    items = [(1, prose(61, 20) + "? yes."), (2, prose(62, 20) + ". " + prose(63, 12) + "."), (3, prose(64, 150) + ". " + prose(65, 20) + "."),
             (4, "Why stone? Because."), (5, "word")]
    texts = [prose(61, 20) + " no", prose(61, 20) + " yes", prose(62, 20), prose(62, 20) + " " + prose(63, 12), prose(64, 150),
             prose(64, 150) + " " + prose(65, 20), "why stone because", "because stone why"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1), (3, 2), (5, 3), (6, 4)}


def test_slices_of_items_give_the_same_rows(spark, monkeypatch):
    items = spark.createDataFrame(made_items(40), "item_id long, text string")
    docs = spark.createDataFrame(rows_of([t for _, t in made_items(40)]), SCHEMA)
    whole = {tuple(r) for r in decontaminate.leaks(docs, items).drop("text_key").collect()}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4000)
    assert {tuple(r) for r in decontaminate.leaks(docs, items).drop("text_key").collect()} == whole and len(whole) >= 40


def test_leaks_of_a_very_long_text():
    items = [(k, " ".join(f"{w}{k % 97}" for w in text.split())) for k, text in made_items(300)]
    df = Counter(int(w) for _, t in items for w in np.unique(decontaminate.words_of(t)))
    index = decontaminate.Index(items, df, len(items), 40.0)
    words = np.concatenate([np.random.default_rng(1).choice(np.concatenate([index.terms, np.arange(400_000, dtype=np.uint64)]), 10**6),
                            decontaminate.words_of(items[7][1])])
    tracemalloc.start()
    found = decontaminate.found_in(words, index, decontaminate.THRESHOLD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in found and peak < 200e6
