"""Access-control queries: active users, permissions, audit, sessions, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelake.functions.aggregates import count_if, mean
from farelake.functions.scalars import clock, days_before, full_name
from farelake.plans.views import Tables, since

AUDIT_DAYS = 30
ALL_PERMISSIONS_ROLE = "SUPER_ADMIN"
READER_ROLE = "DATA_ANALYST"
READER_RESOURCES = ("TABLE", "VIEW")


def v_active_users(wh: Tables) -> DataFrame:
    return (wh["security_users"].where(F.col("user_status") == "ACTIVE")
            .select("user_id", "email", full_name("first_name", "last_name").alias("full_name"),
                    "account_type", "user_status", "last_login_at", "email_verified", "mfa_enabled"))


def v_user_permissions(wh: Tables) -> DataFrame:
    """Distinct effective permissions of active users over active links."""
    return _effective_permissions(wh, wh["user_roles"].where("is_active"))


def effective_permissions_asof(wh: Tables, as_of=None) -> DataFrame:
    """As ``v_user_permissions``, without assignments that have run out."""
    valid = F.col("expires_at").isNull() | (F.col("expires_at") > clock(as_of))
    return _effective_permissions(wh, wh["user_roles"].where("is_active").where(valid))


def _effective_permissions(wh: Tables, assignments: DataFrame) -> DataFrame:
    """Roles are resolved to permissions first, so users meet one joined side only.

    Spark splits a popular role's partition where the side is too large to
    broadcast; repeated assignments fall together at the end.
    """
    granted = (
        wh["security_roles"].where("is_active").select("role_sk", "role_name")
        .join(wh["role_permissions"].where("is_active").select("role_sk", "permission_sk"), "role_sk")
        .join(wh["security_permissions"].where("is_active")
              .select("permission_sk", "permission_code", "permission_name", "resource_name", "action_type"),
              "permission_sk")
        .drop("permission_sk")
    )
    users = wh["security_users"].where(F.col("user_status") == "ACTIVE").select("user_sk", "user_id", "email")
    return (
        users.join(assignments.select("user_sk", "role_sk"), "user_sk")
        .join(granted, "role_sk")
        .select("user_id", "email", "role_name", "permission_code", "permission_name",
                "resource_name", "action_type")
        .distinct()
    )


def v_security_audit_summary(wh: Tables, as_of=None) -> DataFrame:
    """Last 30 days by user and event type. A NULL outcome is not a failure.

    Events are summed per user key before the join with users, so a busy
    account reaches the shuffle as one row per task and event type.
    """
    per_user = (
        since(wh["security_audit_log"], "event_timestamp", days_before(as_of, AUDIT_DAYS), "event")
        .where(F.col("user_sk").isNotNull())
        .groupBy("user_sk", "event_type")
        .agg(F.count(F.lit(1)).alias("event_count"),
             F.max("event_timestamp").alias("last_event"),
             count_if(~F.col("success")).alias("failed_attempts"))
    )
    users = wh["security_users"].select("user_sk", "user_id", "email")
    return (per_user.join(users, "user_sk")
            .select("user_id", "email", "event_type", "event_count", "last_event", "failed_attempts"))


def expand_role_grants(roles: DataFrame, permissions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New role grants: the all-permissions role gets every permission, the
    reader role the READ ones on tables and views.

    Each permission lists the role codes it goes to, which are then looked up
    by code. Pairs already granted are left out.
    """
    for_reader = (F.col("action_type") == "READ") & F.col("resource_type").isin(*READER_RESOURCES)
    receivers = F.array_compact(F.array(F.lit(ALL_PERMISSIONS_ROLE), F.when(for_reader, F.lit(READER_ROLE))))
    grants = (
        permissions.select("permission_sk", F.explode(receivers).alias("role_code"))
        .join(roles.select("role_code", "role_sk"), "role_code")
        .select("role_sk", "permission_sk", F.lit("SYSTEM").alias("granted_by"))
    )
    if existing is None:
        return grants
    return grants.join(existing.select("role_sk", "permission_sk"), ["role_sk", "permission_sk"], "left_anti")


def check_permissions(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Flag each request (user_id, permission_code) with 1 if granted, else 0."""
    granted = (permissions.select("user_id", "permission_code").distinct()
               .withColumn("has_permission", F.lit(1)))
    return (requests.join(granted, ["user_id", "permission_code"], "left")
            .withColumn("has_permission", F.coalesce("has_permission", F.lit(0))))


def check_requests(wh: Tables, requests: DataFrame) -> DataFrame:
    """``check_permissions`` that resolves the requests' own users and permission codes only."""
    users = requests.select("user_id").distinct()
    codes = requests.select("permission_code").distinct()
    asked = {**wh, "security_users": wh["security_users"].join(users, "user_id", "left_semi"),
             "security_permissions": wh["security_permissions"].join(codes, "permission_code", "left_semi")}
    named = asked["security_users"].where(F.col("user_status") == "ACTIVE").select("user_sk")
    asked["user_roles"] = wh["user_roles"].join(named, "user_sk", "left_semi")
    return check_permissions(requests, v_user_permissions(asked))


def unknown_login_attempts(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts under a name that is neither a user id nor an e-mail.

    The two columns become one list of known names, which keeps this an equi
    join. A NULL name is unknown.
    """
    names = (users.select(F.col("user_id").alias("username"))
             .unionByName(users.select(F.col("email").alias("username"))))
    return (attempts.join(names, "username", "left_anti")
            .select("attempt_id", F.col("username").alias("username_attempted"), "ip_address", "user_agent",
                    F.lit("USER_NOT_FOUND").alias("failure_reason"),
                    F.col("attempt_ts").alias("attempt_timestamp")))


def resolve_attempts(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts with the key of the user whose id or e-mail was given.

    A name that is one user's id and another's e-mail goes to the lower key,
    so each attempt keeps one row.
    """
    names = (users.select(F.col("user_id").alias("username"), "user_sk")
             .unionByName(users.select(F.col("email").alias("username"), "user_sk"))
             .groupBy("username").agg(F.min("user_sk").alias("user_sk")))
    return attempts.join(names, "username")


def failed_logins_by_ip(attempts: DataFrame, bucket: str = "1 hour", threshold: int = 3) -> DataFrame:
    """Addresses with at least ``threshold`` failures within a time bucket."""
    return (
        attempts.groupBy("ip_address", F.window("attempt_timestamp", bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"),
             F.count_distinct("username_attempted").alias("usernames"),
             F.max("attempt_timestamp").alias("last_attempt"))
        .where(F.col("failures") >= threshold)
        .select("ip_address", F.col("w.start").alias("bucket_start"), "failures", "usernames", "last_attempt")
    )


def session_status(sessions: DataFrame, as_of=None, idle_minutes: int = 15) -> DataFrame:
    """State of each session: closed, expired, idle or active."""
    now = clock(as_of)
    idle_since = now - F.make_dt_interval(mins=F.lit(idle_minutes))
    state = (F.when(~F.col("is_active"), "closed")
             .when(F.col("expires_at") <= now, "expired")
             .when(F.col("last_activity") < idle_since, "idle")
             .otherwise("active"))
    return sessions.select("session_sk", "session_id", "user_sk", "session_type", state.alias("session_state"))


def audit_risk_summary(audit: DataFrame) -> DataFrame:
    """Events per user, day and risk band, with the band's mean and highest score."""
    band = (F.when(F.col("risk_score") >= 75, "high").when(F.col("risk_score") >= 40, "medium").otherwise("low"))
    return (audit.groupBy("user_sk", F.to_date("event_timestamp").alias("event_date"), band.alias("risk_band"))
            .agg(F.count(F.lit(1)).alias("events"),
                 mean("risk_score").alias("avg_risk"),
                 F.max("risk_score").alias("max_risk")))
