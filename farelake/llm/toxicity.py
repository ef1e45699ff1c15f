"""Toxicity: a linear-chain conditional random field over a document's words.

Fitting takes a bounded sample of labelled documents, at most ``SAMPLE`` of either
label and none above ``SAMPLE_BYTES``, chosen by hash; the chain's few weights are
fitted on the first ``CHAIN_DOCUMENTS`` of it and at most ``CHAIN_RUNS`` runs of 100 words, the
lexicon and the calibration on all. Labels are per document, so tokens are labelled first: of the
word forms (the word and its first 3 to 6 letters) those that occur in toxic
documents far more often than in others make a lexicon; a token of a toxic
document with such a form is labelled toxic, all others are not. A two-state chain
is then fitted to these labelled tokens by gradient ascent on the conditional
log-likelihood: a weight for each level of evidence and transition weights.

Scoring reads whole texts. Words without evidence share one potential, so a run of
them is one power of a 2 x 2 matrix; forward-backward sums over the few other
words give the exact marginals of the whole chain. Words with a marginal of
at least one half are the offending spans. The marginals' expected count, its
share of the words and the largest marginal give the document's score by a
logistic function fitted on the same sample.

Defined results: a NULL, empty or wordless text has no spans and gets the score of
no evidence. Labels without a document and documents without a label are not
used for fitting; repeated labels count as toxic if any is; of different texts of one id the
smallest is fitted on. A document with label
NULL is unlabelled. With no labelled rows, or one label only, nothing is known to
be toxic and all scores are 0. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.common import held_out, small_batches, table

SAMPLE = 3000
# Longer texts are scored like all others, but not fitted on.
SAMPLE_BYTES = 1 << 15
# Transitions and weights are fitted on the first documents of the sample, and so many runs of their words.
CHAIN_DOCUMENTS = 1500
CHAIN_RUNS = 6000
LEVELS = (1.5, 2.5, 3.5, 5.0)
# A form counts as evidence from so many toxic documents on, and from this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.01
THRESHOLD = 0.5
TOKEN = re.compile(r"[^\W\d_]+")
REMEMBERED_WORDS = 400_000


def forms(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(3, 7) if len(word) > k)]


def level(evidence: float) -> int:
    return sum(evidence >= x for x in LEVELS)


class Chain:
    """Two-state chain: lexicon of word forms, weights by level of evidence, transitions, document calibration."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, move: np.ndarray, calibration: np.ndarray):
        self.lexicon, self.weights, self.move, self.calibration = lexicon, weights, move, calibration
        self._seen: dict[str, int] = {}
        plain = np.exp(np.array([0.0, weights[0]]))
        step = np.exp(move) * plain[None, :]
        values, vectors = np.linalg.eig(step)
        self._values, self._vectors, self._inverse = values.real / values.real.max(), vectors.real, np.linalg.inv(vectors.real)
        self._step = np.exp(move)
        self._plain = plain

    def word_level(self, word: str) -> int:
        known = self._seen.get(word)
        if known is None:
            known = level(max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0))
            if len(self._seen) < REMEMBERED_WORDS:
                self._seen[word] = known
        return known

    def _run(self, n: int) -> np.ndarray:
        """n steps over words without evidence, up to a factor."""
        return (self._vectors * self._values ** n) @ self._inverse

    def marginals(self, places: list[int], levels: list[int], n: int) -> np.ndarray:
        """P(toxic) of the words at ``places`` (sorted), the only ones of n with evidence."""
        m = len(places)
        if not m:
            return np.zeros(0)
        emit = np.array([[1.0, math.exp(self.weights[x])] for x in levels])
        ahead = np.zeros((m, 2))
        state, at = None, -1
        for k in range(m):
            gap = places[k] - at - 1
            if state is None:
                if gap:
                    state = self._plain @ self._run(gap - 1)
                    state = state @ self._step
                else:
                    state = np.ones(2)
            else:
                if gap:
                    state = state @ self._run(gap)
                state = state @ self._step
            state = state * emit[k]
            state = state / state.sum()
            ahead[k] = state
            at = places[k]
        out = np.zeros(m)
        back = self._run(n - 1 - at) @ np.ones(2)
        for k in range(m - 1, -1, -1):
            both = ahead[k] * back
            out[k] = both[1] / both.sum()
            if k:
                back = self._step @ (emit[k] * back)
                gap = places[k] - places[k - 1] - 1
                if gap:
                    back = self._run(gap) @ back
                back = back / back.sum()
        return out

    def evidence(self, text: str) -> tuple[list[tuple[int, int]], list[int], list[int], int]:
        """Character spans, word places and levels of the words with evidence; number of words."""
        spans, places, levels, n = [], [], [], 0
        word_level, seen = self.word_level, self._seen
        for n, match in enumerate(TOKEN.finditer(text), 1):
            word = match.group().lower()
            known = seen.get(word)
            if known is None:
                known = word_level(word)
            if known:
                spans.append(match.span())
                places.append(n - 1)
                levels.append(known)
        return spans, places, levels, n

    def judge(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """Score and offending character spans of a text (offsets into the text)."""
        spans, places, levels, n = self.evidence(text)
        p = self.marginals(places, levels, n)
        score = 1 / (1 + math.exp(-float(np.clip(self.calibration @ document_features(p, n), -50, 50))))
        return score, [s for s, x in zip(spans, p) if x >= 0.5]


def document_features(p: np.ndarray, n: int) -> np.ndarray:
    expected = float(p.sum())
    return np.array([1.0, float(p.max(initial=0.0)), math.log1p(expected), math.sqrt(expected / n) if n else 0.0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(y) / 100
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w * len(y) / 100)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_chain(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights by level and transition weights from (levels, labels) of whole chains, all chains in step."""
    n_levels = len(LEVELS) + 1
    longest = max(len(x) for x, _ in chains)
    levels = np.zeros((len(chains), longest), np.int64)
    labels = np.zeros((len(chains), longest), np.int64)
    real = np.zeros((len(chains), longest), bool)
    for i, (x, y) in enumerate(chains):
        levels[i, :len(x)], labels[i, :len(x)], real[i, :len(x)] = x, y, True
    w, move = np.zeros(n_levels), np.zeros((2, 2))
    w[0] = -2.0
    first, second = [np.zeros(n_levels), np.zeros((2, 2))], [np.zeros(n_levels), np.zeros((2, 2))]
    rows = np.arange(len(chains))
    for t in range(1, steps + 1):
        emit = np.exp(np.stack([np.zeros_like(levels, float), w[levels]], -1))
        step = np.exp(move)
        ahead, scale = np.zeros((len(chains), longest, 2)), np.ones((len(chains), longest))
        state = emit[:, 0]
        for k in range(longest):
            if k:
                state = (state @ step) * emit[:, k]
            scale[:, k] = state.sum(1)
            state = state / scale[:, k][:, None]
            ahead[:, k] = state
        back = np.ones((len(chains), 2))
        g_w, g_move = np.zeros(n_levels), np.zeros((2, 2))
        for k in range(longest - 1, -1, -1):
            back = np.where(real[:, k + 1][:, None], back, 1.0) if k + 1 < longest else back
            p = ahead[:, k] * back
            p /= p.sum(1, keepdims=True)
            on = real[:, k]
            g_w += np.bincount(levels[on, k], weights=labels[on, k] - p[on, 1], minlength=n_levels)
            if k:
                pair = ahead[:, k - 1][:, :, None] * step[None] * (emit[:, k] * back)[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                np.add.at(g_move, (labels[on, k - 1], labels[on, k]), 1.0)
                g_move -= pair[on].sum(0)
                new = (emit[:, k] * back) @ step.T
                back = new / new.sum(1, keepdims=True)
        size = real.sum()
        for i, (value, grad) in enumerate(((w, g_w), (move, g_move))):
            grad = grad / size * 100 - 0.01 * value
            first[i] = 0.8 * first[i] + 0.2 * grad
            second[i] = 0.95 * second[i] + 0.05 * grad ** 2
            value += 0.3 * (first[i] / (1 - 0.8 ** t)) / (np.sqrt(second[i] / (1 - 0.95 ** t)) + 1e-6)
    return w, move


def words_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def fit(sample: list[tuple[str, int]], chain_documents: int = CHAIN_DOCUMENTS, chain_runs: int = CHAIN_RUNS) -> Chain | None:
    """A chain from (text, toxic) documents; None unless both labels occur."""
    sample = list(dict.fromkeys(sample))  # copies are no evidence of their own
    n_toxic = sum(y for _, y in sample)
    n_clean = len(sample) - n_toxic
    if not n_toxic or not n_clean:
        return None
    # Words as numbers, so that the sample is held once and small.
    numbers: dict[str, int] = {}
    documents = [(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(text)), np.int32), y) for text, y in sample]
    del sample
    vocabulary = list(numbers)
    toxic, clean = Counter(), Counter()
    for words, y in documents:
        if y:
            toxic.update({f for w in np.unique(words).tolist() for f in forms(vocabulary[w])})
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    frequent = {f for f, c in toxic.items() if c >= least}
    held = [[f for f in forms(w) if f in frequent] for w in vocabulary]
    for words, y in documents:
        if not y:
            clean.update({f for w in np.unique(words).tolist() for f in held[w]})
    lexicon = {}
    for f in frequent:
        evidence = math.log((toxic[f] + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1))
        if evidence >= LEVELS[0]:
            lexicon[f] = evidence
    del toxic, clean, held
    draft = Chain(lexicon, np.zeros(len(LEVELS) + 1), np.zeros((2, 2)), np.zeros(4))
    level_of = np.array([draft.word_level(w) for w in vocabulary], np.int8)
    chains = []
    for words, y in documents[:chain_documents]:
        x = level_of[words].astype(np.int64)
        # Chains for fitting are runs of 100 words; strong evidence in a toxic document is a toxic token.
        for start in range(0, len(x), 100):
            part = x[start:start + 100]
            if part.any() or start == 0 and len(part):
                chains.append((part, (part >= 2).astype(np.int64) * y))
    if not chains:
        return None
    w, move = _fit_chain(chains[:chain_runs])
    chain = Chain(lexicon, w, move, np.zeros(4))
    rows = []
    for words, y in documents:
        levels = level_of[words]
        places = np.flatnonzero(levels)
        rows.append(document_features(chain.marginals(places.tolist(), levels[places].tolist(), len(words)), len(words)))
    chain.calibration = _logistic(np.array(rows), np.array([y for _, y in documents], float))
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", sample: int = SAMPLE, training_only: bool = True) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts of either label, the first by hash of their id, held-out ids left out."""
    marks = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
             .where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y")))
    if training_only:
        marks = marks.where(~held_out("_id"))
    turn = F.xxhash64(F.col("_id").cast("string"))
    # At most 2 * sample rows of two numbers.
    few = [marks.where(F.col("_y") == y).orderBy(turn, "_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = (texts.where(F.octet_length("_text") <= SAMPLE_BYTES).join(chosen, "_id")
            .groupBy("_id", "_y").agg(F.min("_text").alias("_text")))
    return [(r[0], r[1]) for r in rows.orderBy(turn, "_id").select("_text", "_y").collect()]


def _judge_batches(batches: Iterator[pa.RecordBatch], chain, text_at: int, kept: int, spans: bool) -> Iterator[pa.RecordBatch]:
    """The first ``kept`` columns of the batches with the score of the texts in column ``text_at``."""
    chain = chain.value
    for batch in batches:
        scores, found = [], []
        texts = batch.column(text_at)
        for i in range(batch.num_rows):
            score, own = chain.judge(texts[i].as_py() or "") if chain else (0.0, [])
            scores.append(score)
            found.append([{"start": a, "end": b} for a, b in own])
        columns, names = list(batch.columns[:kept]), batch.schema.names[:kept]
        columns.append(pa.array(scores, pa.float64()))
        names.append("_score")
        if spans:
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names.append("_spans")
        yield pa.RecordBatch.from_arrays(columns, names)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True,
             **sampling) -> DataFrame:
    """Per document (doc_id, score) and, if asked for, ``spans`` of offending characters."""
    small_batches(docs.sparkSession)
    chain = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, id_col, text_col, **sampling)))
    schema = "doc_id long, _score double" + (", _spans array<struct<start: long, end: long>>" if spans else "")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(
        partial(_judge_batches, chain=chain, text_at=1, kept=1, spans=spans), schema)
    return out.withColumnsRenamed({"_score": "score", "_spans": "spans"})


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **sampling) -> DataFrame:
    """``docs`` without the documents that score at least ``threshold``."""
    small_batches(docs.sparkSession)
    chain = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, text_col=text_col, **sampling)))
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields)) + ", _score double"
    # The text goes to Python once, as one of the columns handed on.
    scored = docs.toDF(*names).mapInArrow(
        partial(_judge_batches, chain=chain, text_at=docs.columns.index(text_col), kept=len(names), spans=False), schema)
    return scored.where(F.col("_score") < threshold).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.size("spans").alias("n_spans"))
