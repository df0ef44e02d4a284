"""Closed vocabularies of the metadata and proposal model."""

# The enumerations of the proposal contract.
NORMALIZED_TYPES = ["string", "integer", "numeric", "boolean", "date", "timestamp", "json", "unknown"]
CONFIDENCES = ["low", "medium", "high"]
SEVERITIES = ["info", "warning", "error"]
AGGREGATIONS = ["count", "count_distinct", "sum", "avg", "min", "max", "custom"]
CARDINALITIES = ["low", "medium", "high", "very_high"]
GRANULARITIES = ["day", "week", "month", "quarter", "year"]
RELATIONSHIP_TYPES = [
    "exact_match", "fuzzy_match", "derived", "one_to_many", "many_to_many", "unlinked_dimension",
]
FORMAT_HINTS = ["integer", "decimal", "percent", "currency_usd", "currency_unknown", "duration_days"]
STATUSES = ["proposed", "approved", "rejected", "superseded"]

# Substrings of a native type name and the type they stand for, tried in this order.
TYPE_SUBSTRINGS = [
    ("integer", ["smallint", "integer", "bigint", "int2", "int4", "int8", "int64", "serial"]),
    ("numeric", ["numeric", "decimal", "real", "double", "float", "money"]),
    ("boolean", ["boolean", "bool"]),
    ("timestamp", ["timestamp", "datetime"]),
    ("date", ["date"]),
    ("json", ["json", "jsonb"]),
    ("string", ["character", "varchar", "char", "text", "string", "uuid"]),
]

# Largest distinct count of each cardinality bucket.
CARDINALITY_LIMITS = [("low", 10), ("medium", 100), ("high", 10_000)]

# Schemas that never hold user tables.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]

# Fields a reviewer may edit while a definition is proposed.
EDITABLE_FIELDS = ["name", "display_name", "description", "rationale", "confidence"]

# Trailing words of a company name that do not identify the company.
COMPANY_DESIGNATORS = [
    "CORPORATION", "CORP", "INCORPORATED", "INC", "LIMITED", "LTD", "LLC", "PLC", "COMPANY", "CO",
    "GROUP", "GRP", "HOLDINGS", "HLDGS", "HOLD", "INDUSTRIES", "IND", "ENTERPRISES", "ENT",
    "SYSTEMS", "SYS", "IMPORTS", "IMPORT",
]

RULESET_VERSION = "rules-v1"
DEFAULT_SAMPLE_ROWS = 10
