"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are column expressions. On a bounded sample of labelled
rows, at most ``SAMPLE``, a forest of shallow trees is grown; every path from a root to
a node is a rule, a conjunction of bounds on statistics. A logistic regression with a
lasso penalty weighs the rules, most of them zero. The rules left are compiled
into one Spark expression, so scoring runs no Python and no model object.

Defined results: a NULL text counts as empty and has statistics 0; it is scored like
any other. Repeated labels count as 1 if any is; a NULL label or id is no label.
With no labelled rows scores are 0.5, with one label only they are that label. Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm.common import WORDS, held_out, table
from farelake.session import durable

SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
PENALTY = 0.001
THRESHOLD = 0.3

# Characters that a statistic counts, as the class that a regular expression removes.
_COUNTED = {
    "upper": r"[^\p{Lu}]+", "letters": r"[^\p{L}]+", "digits": r"[^0-9]+", "marks": r"[^$%&*#@^~=+<>\\]+",
    "bangs": r"[^!?]+", "bars": r"[^|/_{}\[\]]+", "stops": r"[^.,;:]+", "spaces": r"[^\x20\x09-\x0D]+",
}
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper_share", "letter_share", "digit_share", "mark_share", "bang_share",
    "bar_share", "stop_share", "space_share", "distinct_words", "distinct_lines", "line_words", "max_word",
)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    raw = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).alias("chars"),
        *[F.length(F.regexp_replace(text, pattern, "")).alias(name) for name, pattern in _COUNTED.items()],
        words.alias("w"), lines.alias("l"))
    raw = raw.select("doc_id", "chars", *_COUNTED, F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("own_words"),
                     F.size("l").alias("lines"), F.size(F.array_distinct("l")).alias("own_lines"),
                     F.coalesce(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(0)).alias("longest"))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    return raw.select(
        "doc_id", F.log1p("chars").alias("log_chars"), F.log1p("words").alias("log_words"),
        F.coalesce((F.col("chars") - F.col("spaces")) / F.nullif(F.col("words"), F.lit(0)), F.lit(0.0)).alias("word_length"),
        share("upper", "letters").alias("upper_share"), share("letters", "chars").alias("letter_share"),
        share("digits", "chars").alias("digit_share"), share("marks", "chars").alias("mark_share"),
        share("bangs", "chars").alias("bang_share"), share("bars", "chars").alias("bar_share"),
        share("stops", "chars").alias("stop_share"), share("spaces", "chars").alias("space_share"),
        share("own_words", "words").alias("distinct_words"), share("own_lines", "lines").alias("distinct_lines"),
        share("words", "lines").alias("line_words"), F.col("longest").cast("double").alias("max_word"))


def _paths(node, bounds: tuple = ()) -> list[tuple]:
    """Bounds ((statistic, above, threshold), ...) of every path from the root to a node."""
    found = [bounds] if bounds else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, cut = STATISTICS[split.featureIndex()], float(split.threshold())
        found += _paths(node.leftChild(), (*bounds, (name, False, cut)))
        found += _paths(node.rightChild(), (*bounds, (name, True, cut)))
    return found


def rule_column(bounds: tuple) -> Column:
    """1.0 where all bounds hold, else 0.0."""
    holds = F.lit(True)
    for name, above, cut in bounds:
        holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
    return holds.cast("double")


def fit(rows: DataFrame) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, bounds)]) from stored rows (doc_id, statistics, label)."""
    counts = dict(rows.groupBy("label").count().collect())
    if not counts:
        return 0.0, []
    if len(counts) == 1:
        return (30.0 if 1 in counts else -30.0), []
    rows = rows.repartition(4, "doc_id").sortWithinPartitions("doc_id")
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("x", "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)
    rules = sorted({path for tree in forest.trees for path in _paths(tree._java_obj.rootNode())})
    if not rules:
        return 0.0, []
    columns = [rule_column(r).alias(f"r{k}") for k, r in enumerate(rules)]
    marked = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(
        rows.select("label", *columns)).select("x", "label")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60,
                               standardization=False).fit(marked)
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[tuple[float, tuple]]) -> Column:
    total = F.lit(intercept)
    for weight, bounds in rules:
        total = total + F.lit(weight) * rule_column(bounds)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
            sample: int = SAMPLE) -> DataFrame:
    """Per document (doc_id, score, statistics)."""
    stats = durable(statistics(docs, id_col, text_col), "statistics")
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id is not null and label is not null").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")))
    turn = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = marks.orderBy(turn, "doc_id").limit(sample)
    rows = durable(stats.join(F.broadcast(chosen), "doc_id"), "quality-sample")
    intercept, rules = fit(rows)
    return stats.withColumn("score", score_column(intercept, rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
