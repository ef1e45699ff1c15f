"""Table schemas of the warehouse and of its access-control side.

Readers always use these; nothing is inferred. Text lengths and NOT NULL
columns, which Parquet does not enforce, are in ``TEXT_LIMITS`` and
``REQUIRED`` and are checked by the quality report.
"""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

# Table and column names and types of the data model.
TABLES = {
    "dim_drivers": """
        driver_sk BIGINT, driver_id INT, driver_license STRING, first_name STRING, last_name STRING,
        email STRING, phone STRING, date_of_birth DATE, driver_rating DECIMAL(3,2), total_trips INT,
        vehicle_make STRING, vehicle_model STRING, vehicle_year INT, vehicle_license_plate STRING,
        vehicle_type STRING, driver_status STRING, city_code STRING, registration_date DATE,
        effective_start_date TIMESTAMP_NTZ, effective_end_date TIMESTAMP_NTZ, is_current BOOLEAN,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "dim_riders": """
        rider_sk BIGINT, rider_id INT, first_name STRING, last_name STRING, email STRING, phone STRING,
        date_of_birth DATE, rider_rating DECIMAL(3,2), total_trips INT, loyalty_tier STRING,
        preferred_payment_method STRING, rider_status STRING, signup_date DATE, city_code STRING,
        effective_start_date TIMESTAMP_NTZ, effective_end_date TIMESTAMP_NTZ, is_current BOOLEAN,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "dim_locations": """
        location_sk BIGINT, location_id STRING, address STRING, street_name STRING, city STRING,
        state STRING, country STRING, postal_code STRING, latitude DECIMAL(10,8),
        longitude DECIMAL(11,8), location_type STRING, is_airport BOOLEAN, is_downtown BOOLEAN,
        zone_id STRING, created_at TIMESTAMP_NTZ""",
    "dim_time": """
        time_sk BIGINT, full_date DATE, year INT, quarter INT, month INT, month_name STRING,
        week_of_year INT, day_of_month INT, day_of_year INT, day_of_week INT, day_name STRING,
        hour_24 INT, hour_12 INT, am_pm STRING, minute INT, is_weekend BOOLEAN, is_holiday BOOLEAN,
        holiday_name STRING, business_hours STRING, rush_hour STRING""",
    "dim_payment_methods": """
        payment_method_sk BIGINT, payment_method_id INT, payment_type STRING, provider STRING,
        is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "dim_trip_status": """
        trip_status_sk BIGINT, status_code STRING, status_name STRING, status_description STRING,
        is_completed BOOLEAN, is_cancelled BOOLEAN""",
    "fact_trips": """
        trip_sk BIGINT, trip_id STRING, driver_sk BIGINT, rider_sk BIGINT, pickup_location_sk BIGINT,
        dropoff_location_sk BIGINT, pickup_time_sk BIGINT, dropoff_time_sk BIGINT,
        trip_status_sk BIGINT, requested_timestamp TIMESTAMP_NTZ, pickup_timestamp TIMESTAMP_NTZ,
        dropoff_timestamp TIMESTAMP_NTZ, cancelled_timestamp TIMESTAMP_NTZ,
        estimated_distance_miles DECIMAL(8,2), actual_distance_miles DECIMAL(8,2),
        estimated_duration_minutes INT, actual_duration_minutes INT, wait_time_minutes INT,
        base_fare DECIMAL(10,2), distance_fare DECIMAL(10,2), time_fare DECIMAL(10,2),
        surge_multiplier DECIMAL(4,2), surge_fare DECIMAL(10,2), tolls_fare DECIMAL(10,2),
        tips_amount DECIMAL(10,2), discount_amount DECIMAL(10,2), total_fare DECIMAL(10,2),
        driver_earnings DECIMAL(10,2), company_commission DECIMAL(10,2),
        rider_rating_given DECIMAL(3,2), driver_rating_given DECIMAL(3,2), trip_type STRING,
        passenger_count INT, special_requests STRING, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ""",
    "fact_payments": """
        payment_sk BIGINT, payment_id STRING, trip_sk BIGINT, payment_method_sk BIGINT,
        payment_time_sk BIGINT, payment_amount DECIMAL(10,2), processing_fee DECIMAL(10,2),
        payment_status STRING, transaction_id STRING, payment_timestamp TIMESTAMP_NTZ,
        created_at TIMESTAMP_NTZ""",
    "fact_driver_daily": """
        driver_daily_sk BIGINT, driver_sk BIGINT, activity_date DATE, city_code STRING,
        hours_online DECIMAL(5,2), hours_driving DECIMAL(5,2), total_trips INT, completed_trips INT,
        cancelled_trips INT, gross_earnings DECIMAL(10,2), net_earnings DECIMAL(10,2),
        total_miles_driven DECIMAL(8,2), acceptance_rate DECIMAL(5,2),
        cancellation_rate DECIMAL(5,2), average_rating DECIMAL(3,2), created_at TIMESTAMP_NTZ""",
    "staging_raw_trips": """
        trip_id STRING, driver_id INT, rider_id INT, pickup_lat DECIMAL(10,8),
        pickup_lng DECIMAL(11,8), dropoff_lat DECIMAL(10,8), dropoff_lng DECIMAL(11,8),
        requested_at TIMESTAMP_NTZ, pickup_at TIMESTAMP_NTZ, dropoff_at TIMESTAMP_NTZ, status STRING,
        fare_breakdown STRING, raw_data STRING, ingestion_timestamp TIMESTAMP_NTZ,
        processed BOOLEAN, ingestion_date DATE""",
    "security_users": """
        user_sk BIGINT, user_id STRING, email STRING, password_hash STRING, salt STRING,
        first_name STRING, last_name STRING, phone STRING, user_status STRING, account_type STRING,
        email_verified BOOLEAN, phone_verified BOOLEAN, failed_login_attempts INT,
        last_failed_login TIMESTAMP_NTZ, account_locked_until TIMESTAMP_NTZ,
        password_expires_at TIMESTAMP_NTZ, must_change_password BOOLEAN, mfa_enabled BOOLEAN,
        mfa_secret STRING, backup_codes STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ,
        created_by STRING, last_login_at TIMESTAMP_NTZ, last_password_change TIMESTAMP_NTZ""",
    "user_sessions": """
        session_sk BIGINT, session_id STRING, user_sk BIGINT, device_info STRING, ip_address STRING,
        location STRING, login_timestamp TIMESTAMP_NTZ, last_activity TIMESTAMP_NTZ,
        expires_at TIMESTAMP_NTZ, is_active BOOLEAN, logout_timestamp TIMESTAMP_NTZ,
        session_type STRING""",
    "security_roles": """
        role_sk BIGINT, role_code STRING, role_name STRING, role_description STRING,
        is_system_role BOOLEAN, is_active BOOLEAN, created_at TIMESTAMP_NTZ, created_by STRING""",
    "security_permissions": """
        permission_sk BIGINT, permission_code STRING, permission_name STRING,
        permission_description STRING, resource_type STRING, resource_name STRING,
        action_type STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "role_permissions": """
        role_permission_sk BIGINT, role_sk BIGINT, permission_sk BIGINT, granted_by STRING,
        granted_at TIMESTAMP_NTZ, is_active BOOLEAN""",
    "user_roles": """
        user_role_sk BIGINT, user_sk BIGINT, role_sk BIGINT, assigned_by STRING,
        assigned_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, is_active BOOLEAN""",
    "user_attributes": """
        user_attribute_sk BIGINT, user_sk BIGINT, attribute_name STRING, attribute_value STRING,
        attribute_type STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "access_policies": """
        policy_sk BIGINT, policy_name STRING, policy_description STRING, resource_pattern STRING,
        policy_condition STRING, action_type STRING, is_active BOOLEAN, priority_order INT,
        created_at TIMESTAMP_NTZ, created_by STRING""",
    "security_audit_log": """
        audit_sk BIGINT, user_sk BIGINT, session_id STRING, event_type STRING,
        event_description STRING, resource_accessed STRING, action_attempted STRING,
        success BOOLEAN, ip_address STRING, user_agent STRING, event_timestamp TIMESTAMP_NTZ,
        additional_data STRING, risk_score INT""",
    "failed_login_attempts": """
        attempt_sk BIGINT, username_attempted STRING, ip_address STRING, user_agent STRING,
        failure_reason STRING, attempt_timestamp TIMESTAMP_NTZ""",
    "encryption_keys": """
        key_sk BIGINT, key_id STRING, key_type STRING, key_purpose STRING, key_status STRING,
        created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, rotated_at TIMESTAMP_NTZ,
        created_by STRING""",
    "data_classification": """
        classification_sk BIGINT, table_name STRING, column_name STRING,
        classification_level STRING, data_type STRING, encryption_required BOOLEAN,
        masking_rule STRING, retention_period_days INT, created_at TIMESTAMP_NTZ""",
}

# Defaults for columns a load leaves out. "now" is the as_of clock.
DEFAULTS = {
    "dim_drivers": {"total_trips": "0", "is_current": "true", "created_at": "now", "updated_at": "now"},
    "dim_riders": {"total_trips": "0", "is_current": "true", "created_at": "now", "updated_at": "now"},
    "dim_locations": {"is_airport": "false", "is_downtown": "true", "created_at": "now"},
    "dim_payment_methods": {"is_active": "true", "created_at": "now"},
    "dim_trip_status": {"is_completed": "false", "is_cancelled": "false"},
    "fact_trips": {"surge_multiplier": "1.0", "passenger_count": "1", "created_at": "now", "updated_at": "now"},
    "fact_payments": {"created_at": "now"},
    "fact_driver_daily": {"created_at": "now"},
    "staging_raw_trips": {"ingestion_timestamp": "now", "processed": "false"},
    "security_users": {
        "user_status": "'ACTIVE'", "account_type": "'DRIVER'", "email_verified": "false",
        "phone_verified": "false", "failed_login_attempts": "0", "must_change_password": "false",
        "mfa_enabled": "false", "created_at": "now", "updated_at": "now", "last_password_change": "now"},
    "user_sessions": {"login_timestamp": "now", "last_activity": "now", "is_active": "true", "session_type": "'WEB'"},
    "security_roles": {"is_system_role": "false", "is_active": "true", "created_at": "now"},
    "security_permissions": {"is_active": "true", "created_at": "now"},
    "role_permissions": {"granted_at": "now", "is_active": "true"},
    "user_roles": {"assigned_at": "now", "is_active": "true"},
    "user_attributes": {"attribute_type": "'STRING'", "is_active": "true", "created_at": "now"},
    "access_policies": {"is_active": "true", "priority_order": "100", "created_at": "now"},
    "security_audit_log": {"event_timestamp": "now", "risk_score": "0"},
    "failed_login_attempts": {"attempt_timestamp": "now"},
    "encryption_keys": {"key_status": "'ACTIVE'", "created_at": "now"},
    "data_classification": {"encryption_required": "false", "created_at": "now"},
}

# Accepted codes, in lower case as the data model lists them.
ACCEPTED = {
    "vehicle_type": ("economy", "premium", "luxury"),
    "driver_status": ("active", "inactive", "suspended"),
    "rider_status": ("active", "inactive", "suspended"),
    "loyalty_tier": ("bronze", "silver", "gold", "platinum"),
    "location_type": ("pickup", "dropoff", "waypoint"),
    "payment_type": ("credit_card", "debit_card", "digital_wallet", "cash"),
    "payment_status": ("pending", "completed", "failed", "refunded"),
    "trip_type": ("standard", "pool", "premium", "scheduled"),
    "session_type": ("web", "mobile", "api"),
    "classification_level": ("public", "internal", "confidential", "restricted"),
}


def _limits(text: str) -> dict[str, int]:
    return {name: int(limit) for name, limit in re.findall(r"(\w+) (\d+)", text)}


# Longest text of each column.
TEXT_LIMITS = {table: _limits(text) for table, text in {
    "dim_drivers": """driver_license 50, first_name 100, last_name 100, email 255, phone 20, vehicle_make 50, vehicle_model 50,
        vehicle_license_plate 20, vehicle_type 30, driver_status 20, city_code 10""",
    "dim_riders": """first_name 100, last_name 100, email 255, phone 20, loyalty_tier 20, preferred_payment_method 30,
        rider_status 20, city_code 10""",
    "dim_locations": """location_id 50, address 500, street_name 200, city 100, state 50, country 50, postal_code 20,
        location_type 30, zone_id 20""",
    "dim_time": "month_name 20, day_name 20, am_pm 2, holiday_name 100, business_hours 20, rush_hour 20",
    "dim_payment_methods": "payment_type 30, provider 50",
    "dim_trip_status": "status_code 20, status_name 50, status_description 200",
    "fact_trips": "trip_id 50, trip_type 30, special_requests 500",
    "fact_payments": "payment_id 50, payment_status 20, transaction_id 100",
    "fact_driver_daily": "city_code 10",
    "staging_raw_trips": "trip_id 50, status 20",
    "security_users": """user_id 50, email 255, password_hash 255, salt 100, first_name 100, last_name 100, phone 20, user_status 20,
        account_type 20, mfa_secret 100, backup_codes 500, created_by 50""",
    "user_sessions": "session_id 128, device_info 500, ip_address 45, location 100, session_type 20",
    "security_roles": "role_code 50, role_name 100, role_description 500, created_by 50",
    "security_permissions": """permission_code 100, permission_name 150, permission_description 500, resource_type 50,
        resource_name 100, action_type 20""",
    "role_permissions": "granted_by 50",
    "user_roles": "assigned_by 50",
    "user_attributes": "attribute_name 50, attribute_value 200, attribute_type 20",
    "access_policies": """policy_name 100, policy_description 500, resource_pattern 200, policy_condition 1000, action_type 20,
        created_by 50""",
    "security_audit_log": """session_id 128, event_type 50, event_description 1000, resource_accessed 200, action_attempted 50,
        ip_address 45, user_agent 500""",
    "failed_login_attempts": "username_attempted 255, ip_address 45, user_agent 500, failure_reason 100",
    "encryption_keys": "key_id 50, key_type 20, key_purpose 50, key_status 20, created_by 50",
    "data_classification": "table_name 128, column_name 128, classification_level 20, data_type 50, masking_rule 200",
}.items()}

# Columns that are never NULL.
REQUIRED = {table: tuple(text.split()) for table, text in {
    "dim_drivers": "driver_sk driver_id driver_license", "dim_riders": "rider_sk rider_id", "dim_locations": "location_sk location_id",
    "dim_time": "time_sk", "dim_payment_methods": "payment_method_sk payment_method_id", "dim_trip_status": "trip_status_sk status_code",
    "fact_trips": "trip_sk trip_id", "fact_payments": "payment_sk payment_id trip_sk", "fact_driver_daily": "driver_daily_sk driver_sk",
    "security_users": "user_sk user_id email password_hash salt", "user_sessions": "session_sk session_id user_sk",
    "security_roles": "role_sk role_code role_name", "security_permissions": "permission_sk permission_code permission_name",
    "role_permissions": "role_permission_sk role_sk permission_sk", "user_roles": "user_role_sk user_sk role_sk",
    "user_attributes": "user_attribute_sk user_sk attribute_name attribute_value", "access_policies": "policy_sk policy_name",
    "security_audit_log": "audit_sk", "failed_login_attempts": "attempt_sk", "encryption_keys": "key_sk key_id",
    "data_classification": "classification_sk",
}.items()}

# Keys, the primary key of each table first.
UNIQUE = {table: tuple(tuple(key.split("+")) for key in text.split()) for table, text in {
    "dim_drivers": "driver_sk", "dim_riders": "rider_sk", "dim_locations": "location_sk", "dim_time": "time_sk",
    "dim_payment_methods": "payment_method_sk", "dim_trip_status": "trip_status_sk", "fact_trips": "trip_sk",
    "fact_payments": "payment_sk", "fact_driver_daily": "driver_daily_sk", "security_users": "user_sk user_id email",
    "user_sessions": "session_sk session_id", "security_roles": "role_sk role_code", "security_permissions": "permission_sk permission_code",
    "role_permissions": "role_permission_sk role_sk+permission_sk", "user_roles": "user_role_sk",
    "user_attributes": "user_attribute_sk", "access_policies": "policy_sk", "security_audit_log": "audit_sk",
    "failed_login_attempts": "attempt_sk", "encryption_keys": "key_sk key_id", "data_classification": "classification_sk",
}.items()}

# References (table, column, table referred to, its key).
FOREIGN_KEYS = (
    ("fact_trips", "driver_sk", "dim_drivers", "driver_sk"),
    ("fact_trips", "rider_sk", "dim_riders", "rider_sk"),
    ("fact_trips", "pickup_location_sk", "dim_locations", "location_sk"),
    ("fact_trips", "dropoff_location_sk", "dim_locations", "location_sk"),
    ("fact_trips", "pickup_time_sk", "dim_time", "time_sk"),
    ("fact_trips", "dropoff_time_sk", "dim_time", "time_sk"),
    ("fact_trips", "trip_status_sk", "dim_trip_status", "trip_status_sk"),
    ("fact_payments", "trip_sk", "fact_trips", "trip_sk"),
    ("fact_payments", "payment_method_sk", "dim_payment_methods", "payment_method_sk"),
    ("fact_payments", "payment_time_sk", "dim_time", "time_sk"),
    ("fact_driver_daily", "driver_sk", "dim_drivers", "driver_sk"),
    ("user_sessions", "user_sk", "security_users", "user_sk"),
    ("role_permissions", "role_sk", "security_roles", "role_sk"),
    ("role_permissions", "permission_sk", "security_permissions", "permission_sk"),
    ("user_roles", "user_sk", "security_users", "user_sk"),
    ("user_roles", "role_sk", "security_roles", "role_sk"),
    ("user_attributes", "user_sk", "security_users", "user_sk"),
    ("security_audit_log", "user_sk", "security_users", "user_sk"),
)

# Ranges of figures.
RANGES = {
    "dim_drivers": {"driver_rating": (0, 5)}, "dim_riders": {"rider_rating": (0, 5)},
    "fact_trips": {"rider_rating_given": (0, 5), "driver_rating_given": (0, 5)}, "security_audit_log": {"risk_score": (0, 100)},
}


def columns_of(table: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns, without a session."""
    return re.findall(r"(\w+) ([A-Z_]+(?:\(\d+,\d+\))?)", TABLES[table])


def schema_of(table: str) -> StructType:
    """The explicit read schema of a table."""
    return StructType.fromDDL(" ".join(TABLES[table].split()))
