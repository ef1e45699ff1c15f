"""URL filter: rules first, then a character language-model ratio.

A URL that a rule decides is an example of an accepted or a rejected one. Over
all these examples the characters that follow each context of up to ``ORDER``
characters are counted for both kinds. A smoothed variable-order Markov model
(Witten-Bell: each context backs off to the next shorter one with the weight of
its number of different followers) gives every character of every URL a
probability under both kinds; where a context was never met the shorter one
decides. A URL's score is the mean log ratio over its characters, so long URLs
count no more than short ones. The bar is calibrated on examples with
crc32(id) mod 5 = 0, which the counts leave out: half way between the mean scores of
the two kinds.

The models are tables of counts. They grow with the corpus, are never collected
and meet the URLs' characters by joins on the context; equal URLs are scored once.

Defined results: a NULL URL or one without ``://`` has empty host and path, no rule
fits it and, as there is nothing to score, its score is 0. With one kind of example
only, or none, all scores and the bar are 0. A score at the bar or above is allowed.
Repeated rows each get a row. Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm.common import table
from farelake.session import durable

# Rules (verdict, host, path); each fits the host and all its subdomains.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
ORDER = 4
ALPHABET = 256
START = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), NULL if none fits."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of each URL: the ``order`` characters before it and itself."""
    padded = F.concat(F.lit(START * order), F.col("url"))
    return urls.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("url")), lambda i: F.substring(padded, i, F.lit(order + 1)))))


def _probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log ratio of the last character's probability, accepted over rejected, after the ones before it.

    ``counts`` has (gram, allow, block) of every gram met in any URL, zero where no example has it.
    """
    levels = [counts.select("gram", "allow", "block")]
    for k in range(order, 0, -1):
        shorter = levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        levels.append(shorter)
    probable = None
    for n, level in enumerate(reversed(levels), 1):  # grams of 1, 2, ... characters
        context = F.substring("gram", 1, n - 1)
        followers = level.groupBy(context.alias("context")).agg(
            *[f for kind in ("allow", "block") for f in (
                F.sum(kind).alias(f"{kind}_n"), F.sum((F.col(kind) > 0).cast("long")).alias(f"{kind}_types"))])
        rows = level.withColumn("context", context).join(followers, "context")
        if probable is None:
            rows = rows.withColumn("allow_p", F.lit(1.0 / ALPHABET)).withColumn("block_p", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.withColumn("short", F.substring("gram", 2, n - 1)).join(probable, "short").drop("short")
        for kind in ("allow", "block"):
            mass = F.col(f"{kind}_n") + F.col(f"{kind}_types")
            rows = rows.withColumn(f"{kind}_p", F.when(
                mass > 0, (F.col(kind) + F.col(f"{kind}_types") * F.col(f"{kind}_p")) / mass).otherwise(F.col(f"{kind}_p")))
        probable = rows.select(F.col("gram").alias("short"), "allow_p", "block_p")
    return probable.select(F.col("short").alias("gram"), F.log(F.col("allow_p") / F.col("block_p")).alias("ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """Per page (page_id, host, path, rule, verdict, score)."""
    host, path = host_and_path(F.col(url_col))
    rows = durable(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                                host.alias("host"), path.alias("path")), "urls")
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    kept_out = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    example = F.when(F.length("host") + F.length("path") > 0, F.col("ruled.verdict"))
    marks = rows.where(F.length("host") + F.length("path") > 0).select("url", example.alias("kind"), kept_out.alias("kept_out"))
    weights = marks.groupBy("url").agg(*[
        F.sum(((F.col("kind") == k) & ~F.col("kept_out")).cast("long")).alias(k) for k in ("allow", "block")])
    urls = durable(weights.select("url", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block")),
                   "distinct-urls")
    grams = _grams(urls, order)
    counts = durable(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-grams")
    kinds = counts.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    if all(kinds):
        ratios = durable(_probabilities(counts, order), "url-ratios")
        # Rounded terms: the sum does not depend on the order of the rows.
        term = F.round("ratio", 9).cast("decimal(20,9)")
        scores = grams.groupBy("url", "gram").agg(F.count(F.lit(1)).alias("n")).join(ratios, "gram").groupBy("url").agg(
            (F.sum(term * F.col("n")).cast("double") / F.sum("n")).alias("score"))
        scores = durable(scores, "url-scores")
    else:
        scores = urls.select("url", F.lit(0.0).alias("score"))
    scored = rows.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    means = {r[0]: r[1] for r in scored.where(kept_out & F.col("ruled").isNotNull()).groupBy("ruled.verdict").agg(
        F.avg(F.round("score", 9).cast("decimal(20,9)")).cast("double")).collect()}
    bar = (means["allow"] + means["block"]) / 2 if len(means) == 2 and all(kinds) else 0.0
    return scored.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), F.when(F.col("score") >= bar, "allow").otherwise("block")).alias("verdict"),
        F.round("score", 9).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
