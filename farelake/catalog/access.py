"""Access-control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators.logins import login_audit_rows, login_outcomes, login_state, users_after_logins
from farelake.plans import access
from farelake.registry import EVENT_CLOCK, query

PERMISSION_TABLES = ("security_users", "user_roles", "security_roles", "role_permissions", "security_permissions")

# Rights per role as one list, then the roles each user holds.
USER_PERMISSIONS = """
with rights as (
  select permission_sk, {{'code': permission_code, 'name': permission_name, 'resource': resource_name,
                         'action': action_type}} as item
  from security_permissions where is_active),
role_sets as (
  select role_sk, list(item) as items
  from (select distinct role_sk, permission_sk from role_permissions where is_active) join rights using (permission_sk)
  group by role_sk),
held as (select distinct user_sk, role_sk from user_roles where is_active {valid}),
user_items as (
  select user_sk, role_name, unnest(items) as item
  from held join role_sets using (role_sk)
  join (select role_sk, role_name from security_roles where is_active) using (role_sk))
select user_id, email, role_name, item.code as permission_code, item.name as permission_name,
       item.resource as resource_name, item.action as action_type
from user_items join (select user_sk, user_id, email from security_users where user_status = 'ACTIVE') using (user_sk)
group by all"""

query("v_active_users", "security_users", sql="""
select user_id, email, first_name || ' ' || last_name as full_name, account_type, user_status, last_login_at,
       email_verified, mfa_enabled
from security_users where user_status = 'ACTIVE'""")(access.v_active_users)

query("v_user_permissions", *PERMISSION_TABLES, sql=USER_PERMISSIONS.format(valid=""))(
    access.v_user_permissions)

query("effective_permissions_asof", *PERMISSION_TABLES, sql=USER_PERMISSIONS.format(
    valid=f"and (expires_at is null or expires_at > timestamp '{EVENT_CLOCK}')"))(
    lambda wh: access.effective_permissions_asof(wh, EVENT_CLOCK))

query("v_security_audit_summary", "security_audit_log", "security_users", sql=f"""
with per_key as (
  select user_sk, event_type, count(*) as n, count(*) filter (where not success) as failed,
         max(event_timestamp) as latest
  from security_audit_log where event_timestamp >= timestamp '{EVENT_CLOCK}' - interval '30' day
  group by all)
select user_id, email, event_type, cast(sum(n) as bigint) as event_count, max(latest) as last_event,
       cast(sum(failed) as bigint) as failed_attempts
from per_key join (select user_sk, user_id, email from security_users) using (user_sk)
group by user_id, email, event_type""")(
    lambda wh: access.v_security_audit_summary(wh, EVENT_CLOCK))

query("expand_role_grants", "security_roles", "permission_catalogue", "existing_grants", sql="""
select r.role_sk, p.permission_sk, 'SYSTEM' as granted_by
from security_roles r join permission_catalogue p
  on r.role_code = 'SUPER_ADMIN'
  or (r.role_code = 'DATA_ANALYST' and p.action_type = 'READ' and p.resource_type in ('TABLE', 'VIEW'))
where not exists (select 1 from existing_grants e
                  where e.role_sk = r.role_sk and e.permission_sk = p.permission_sk)""")(
    lambda wh: access.expand_role_grants(wh["security_roles"], wh["permission_catalogue"], wh["existing_grants"]))

query("check_permissions", "access_requests", *PERMISSION_TABLES, sql=f"""
select q.request_id, q.user_id, q.permission_code, coalesce(g.has_permission, 0) as has_permission
from access_requests q
left join (select distinct user_id, permission_code, 1 as has_permission
           from ({USER_PERMISSIONS.format(valid='')}) as v) g
  on q.user_id = g.user_id and q.permission_code = g.permission_code""")(
    lambda wh: access.check_requests({n: wh[n] for n in PERMISSION_TABLES}, wh["access_requests"]))

LOGIN_CHAIN = """
with recursive numbered as (
  select *, row_number() over (partition by user_sk order by attempt_ts, attempt_id) as n from login_attempts),
chain as (
  select attempt_id, user_sk, attempt_ts, n, case when password_ok then 1 else 0 end as result,
         case when password_ok then 0 else 1 end as failed_login_attempts,
         cast(null as timestamp) as locked_until
  from numbered where n = 1
  union all
  select a.attempt_id, a.user_sk, a.attempt_ts, a.n,
         case when c.locked_until > a.attempt_ts then -1 when a.password_ok then 1 else 0 end,
         case when c.locked_until > a.attempt_ts then c.failed_login_attempts
              when a.password_ok then 0 else c.failed_login_attempts + 1 end,
         case when c.locked_until > a.attempt_ts then c.locked_until
              when a.password_ok then null
              when c.failed_login_attempts + 1 >= 5 then a.attempt_ts + interval '30' minute end
  from chain c join numbered a on a.user_sk = c.user_sk and a.n = c.n + 1)"""

query("login_outcomes", "login_attempts", sql=LOGIN_CHAIN + """
select attempt_id, user_sk, attempt_ts,
       case result when 1 then 'LOGIN_SUCCESS' when 0 then 'LOGIN_FAILED' else 'LOGIN_ATTEMPT' end as event_type,
       result = 1 as success, cast(result as integer) as result,
       cast(failed_login_attempts as integer) as failed_login_attempts, locked_until
from chain""")(lambda wh: login_outcomes(wh["login_attempts"]))

query("login_audit_rows", "login_attempts", sql=LOGIN_CHAIN + """
select c.user_sk, case result when 1 then 'LOGIN_SUCCESS' when 0 then 'LOGIN_FAILED' else 'LOGIN_ATTEMPT' end as event_type,
       case result when 1 then 'User authenticated' when 0 then 'Invalid password' else 'Account locked' end
           as event_description,
       result = 1 as success, a.ip_address, a.user_agent, c.attempt_ts as event_timestamp
from chain c join login_attempts a on a.attempt_id = c.attempt_id""")(
    lambda wh: login_audit_rows(login_outcomes(wh["login_attempts"], carry=["ip_address", "user_agent"])))

USER_STATE = """
select user_sk,
       cast(arg_max(failed_login_attempts, n) as integer) as failed_login_attempts,
       max(case when result = 0 then attempt_ts end) as last_failed_login,
       max(case when n = last_failure then locked_until end) as account_locked_until,
       max(case when result = 1 then attempt_ts end) as last_login_at
from (select *, max(case when result = 0 then n end) over (partition by user_sk) as last_failure from chain) as c
group by user_sk"""


def users_snapshot(wh):
    users = wh["security_users"].withColumns({
        "failed_login_attempts": F.lit(0), "last_failed_login": F.lit(None).cast("timestamp_ntz"),
        "account_locked_until": F.lit(None).cast("timestamp_ntz")})
    return users_after_logins(users, login_state(login_outcomes(wh["login_attempts"])))


query("users_after_logins", "login_attempts", "security_users", sql=LOGIN_CHAIN + f"""
select u.* exclude (last_login_at), coalesce(s.failed_login_attempts, 0) as failed_login_attempts,
       s.last_failed_login, s.account_locked_until, coalesce(s.last_login_at, u.last_login_at) as last_login_at
from security_users u left join ({USER_STATE}) s on s.user_sk = u.user_sk""")(users_snapshot)

query("login_state", "login_attempts", sql=LOGIN_CHAIN + """
select user_sk,
       cast(arg_max(failed_login_attempts, n) as integer) as failed_login_attempts,
       max(case when result = 0 then attempt_ts end) as last_failed_login,
       max(case when n = last_failure then locked_until end) as account_locked_until,
       max(case when result = 1 then attempt_ts end) as last_login_at,
       count(case when result >= 0 then 1 end) as evaluated_attempts
from (select *, max(case when result = 0 then n end) over (partition by user_sk) as last_failure from chain) as c
group by user_sk""")(lambda wh: login_state(login_outcomes(wh["login_attempts"])))

query("unknown_login_attempts", "named_attempts", "security_users", sql="""
select attempt_id, username as username_attempted, ip_address, user_agent, 'USER_NOT_FOUND' as failure_reason,
       attempt_ts as attempt_timestamp
from named_attempts a
where not exists (select 1 from security_users u where u.user_id = a.username)
  and not exists (select 1 from security_users u where u.email = a.username)""")(
    lambda wh: access.unknown_login_attempts(wh["named_attempts"], wh["security_users"]))

query("resolve_attempts", "named_attempts", "security_users", sql="""
select a.username, a.attempt_id, a.attempt_ts, a.ip_address, a.user_agent, min(u.user_sk) as user_sk
from named_attempts a join security_users u on u.user_id = a.username or u.email = a.username
group by all""")(
    lambda wh: access.resolve_attempts(wh["named_attempts"], wh["security_users"]))

query("failed_logins_by_ip", "failed_login_attempts", sql="""
select ip_address, date_trunc('day', attempt_timestamp) as bucket_start, count(*) as failures,
       count(distinct username_attempted) as usernames, max(attempt_timestamp) as last_attempt
from failed_login_attempts group by 1, 2 having count(*) >= 3""")(
    lambda wh: access.failed_logins_by_ip(wh["failed_login_attempts"], bucket="1 day"))

query("session_status", "user_sessions", sql="""
select session_sk, session_id, user_sk, session_type,
       case when not is_active then 'closed'
            when expires_at <= timestamp '2024-01-15 12:00:00' then 'expired'
            when last_activity < timestamp '2024-01-15 12:00:00' - interval '15' minute then 'idle'
            else 'active' end as session_state
from user_sessions""")(lambda wh: access.session_status(wh["user_sessions"], "2024-01-15 12:00:00"))

query("audit_risk_summary", "security_audit_log", sql="""
select user_sk, cast(event_timestamp as date) as event_date,
       case when risk_score >= 75 then 'high' when risk_score >= 40 then 'medium' else 'low' end as risk_band,
       count(*) as events, cast(sum(risk_score) as double) / count(risk_score) as avg_risk,
       max(risk_score) as max_risk
from security_audit_log group by 1, 2, 3""")(lambda wh: access.audit_risk_summary(wh["security_audit_log"]))
