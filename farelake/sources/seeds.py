"""Seed rows of the access-control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# System roles (code, name, description), numbered from 1.
ROLES = (
    ("SUPER_ADMIN", "Super Administrator", "Full system access"),
    ("DB_ADMIN", "Database Administrator", "Database management access"),
    ("DATA_ANALYST", "Data Analyst", "Read access to analytical data"),
    ("CITY_MANAGER", "City Operations Manager", "City-specific operational access"),
    ("DRIVER_SUPPORT", "Driver Support Agent", "Driver assistance and basic data access"),
    ("RIDER_SUPPORT", "Rider Support Agent", "Rider assistance and basic data access"),
    ("FINANCIAL_ANALYST", "Financial Analyst", "Financial data and reporting access"),
    ("API_USER", "API User", "Programmatic API access"),
)

# Permissions (code, name, resource type, resource, action), numbered from 1.
PERMISSIONS = (
    ("fact_trips.read", "Read Trip Data", "TABLE", "fact_trips", "READ"),
    ("fact_trips.write", "Write Trip Data", "TABLE", "fact_trips", "WRITE"),
    ("dim_drivers.read", "Read Driver Data", "TABLE", "dim_drivers", "READ"),
    ("dim_drivers.write", "Write Driver Data", "TABLE", "dim_drivers", "WRITE"),
    ("dim_riders.read", "Read Rider Data", "TABLE", "dim_riders", "READ"),
    ("fact_payments.read", "Read Payment Data", "TABLE", "fact_payments", "READ"),
    ("analytics.execute", "Execute Analytics Queries", "VIEW", "v_trip_summary", "READ"),
    ("users.manage", "Manage Users", "TABLE", "security_users", "WRITE"),
    ("roles.manage", "Manage Roles", "TABLE", "security_roles", "WRITE"),
    ("audit.read", "Read Audit Logs", "TABLE", "security_audit_log", "READ"),
    ("system.admin", "System Administration", "SYSTEM", "*", "EXECUTE"),
)


def seed_roles(spark: SparkSession) -> DataFrame:
    rows = [(n, *role, True, True) for n, role in enumerate(ROLES, 1)]
    return spark.createDataFrame(
        rows, "role_sk bigint, role_code string, role_name string, role_description string, "
              "is_system_role boolean, is_active boolean")


def seed_permissions(spark: SparkSession) -> DataFrame:
    rows = [(n, *permission, True) for n, permission in enumerate(PERMISSIONS, 1)]
    return spark.createDataFrame(
        rows, "permission_sk bigint, permission_code string, permission_name string, "
              "resource_type string, resource_name string, action_type string, is_active boolean")
