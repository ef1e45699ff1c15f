"""Row access by attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The only accepted form of a stored condition: column = value.
CONDITION = r"^\s*(\w+)\s*=\s*'?([^'=]*?)'?\s*$"


def _allowed(attributes: DataFrame, attribute: str, column: str) -> DataFrame:
    return (attributes.where("is_active").where(F.col("attribute_name") == attribute)
            .select("user_sk", F.col("attribute_value").alias(column)))


def rows_visible_to(rows: DataFrame, column: str, attributes: DataFrame, attribute: str, user_sk: int) -> DataFrame:
    """The rows one reader may see: ``column`` equals one of the reader's active attribute values."""
    mine = _allowed(attributes.where(F.col("user_sk") == user_sk), attribute, column).select(column)
    return rows.join(mine, column, "left_semi").select(rows.columns)


def permitted_requests(requests: DataFrame, column: str, attributes: DataFrame, attribute: str) -> DataFrame:
    """Requests (with user_sk and the wanted row's ``column``) that the user's attributes allow."""
    return requests.join(_allowed(attributes, attribute, column), ["user_sk", column], "left_semi")


def parsed_policies(policies: DataFrame, resource: str, action: str) -> DataFrame:
    """Active policies for a resource and action with their condition split in two.

    Stored text is never run; a condition that is not ``column = value`` gives
    a NULL column and so matches nothing.
    """
    return (
        policies.where(F.col("is_active") & (F.col("resource_pattern") == resource) & (F.col("action_type") == action))
        .select("policy_sk", "priority_order",
                F.nullif(F.regexp_extract("policy_condition", CONDITION, 1), F.lit("")).alias("match_column"),
                F.regexp_extract("policy_condition", CONDITION, 2).alias("match_value"))
    )


def parsed_rules(policies: DataFrame, resource: str) -> DataFrame:
    """As ``parsed_policies``, for every action of a resource, which is kept as ``action_type``."""
    condition = F.col("policy_condition")
    return (policies.where(F.col("is_active") & (F.col("resource_pattern") == resource))
            .select("policy_sk", "priority_order", "action_type",
                    F.nullif(F.regexp_extract(condition, CONDITION, 1), F.lit("")).alias("match_column"),
                    F.regexp_extract(condition, CONDITION, 2).alias("match_value")))


def rows_by_policy(rows: DataFrame, key: str, columns: list[str], policies: DataFrame, resource: str, action: str) -> DataFrame:
    """Every row with the policy that decides on it and ``is_allowed``.

    Of all active policies that match a row, whatever their action, the one with the
    lowest priority number decides: it allows its own action and denies any other. A
    row that no policy matches is denied. Only winners, one per matched row, meet the rows again.
    """
    rules = parsed_rules(policies, resource)
    won = first_policy(rows, key, columns, rules).join(rules.select("policy_sk", "action_type"), "policy_sk")
    return (rows.join(won, key, "left")
            .withColumn("is_allowed", F.coalesce(F.col("action_type") == action, F.lit(False))).drop("action_type"))


def visible_rows(rows: DataFrame, key: str, columns: list[str], policies: DataFrame, resource: str, action: str) -> DataFrame:
    """The rows that the first matching policy allows, as they are."""
    decided = rows_by_policy(rows, key, columns, policies, resource, action)
    return decided.where("is_allowed").select(rows.columns)


def first_policy(rows: DataFrame, key: str, columns: list[str], policies: DataFrame) -> DataFrame:
    """For each row the matching policy with the lowest priority number.

    Rows are opened into (column, value) pairs, which meet the policies in an
    equi join; the best policy is an aggregate per row key. Rows no policy
    matches are left out.
    """
    pairs = rows.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("match_column"), F.col(c).cast("string").alias("match_value")) for c in columns
    ])).alias("p")).select(key, "p.match_column", "p.match_value")
    best = F.min(F.struct("priority_order", "policy_sk")).alias("b")
    # One policy per (column, value): the rest can never win, and each row then meets at most one per column.
    rules = policies.groupBy("match_column", "match_value").agg(best).select("match_column", "match_value", "b.*")
    won = pairs.join(rules, ["match_column", "match_value"]).groupBy(key).agg(best)
    return won.select(key, "b.policy_sk", "b.priority_order")
