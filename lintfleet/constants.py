"""Fixed values that results must agree on: word lists, code tables, formats and limits."""

# Schemas the catalog rules leave out.
EXCLUDED_SCHEMAS = [
    "_timescaledb_cache", "_timescaledb_catalog", "_timescaledb_config", "_timescaledb_internal",
    "auth", "cron", "extensions", "graphql", "graphql_public", "information_schema", "net",
    "pg_catalog", "pgbouncer", "pgmq", "pgroonga", "pgsodium", "pgsodium_masks", "pgtle",
    "realtime", "repack", "storage", "supabase_functions", "supabase_migrations", "tiger",
    "topology", "vault",
]
# Shorter lists of single rules.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]
FK_EXCLUDED_SCHEMAS = ["pg_catalog", "information_schema", "auth", "storage", "vault", "extensions"]
REG_EXCLUDED_SCHEMAS = ["pg_catalog", "information_schema", "pgsodium"]

# Roles the policy rule leaves out (LIKE patterns), and where migration tools keep their books.
IGNORED_ROLES = ["pg_%", "supabase%admin"]
MIGRATION_TABLES = ["_sqlx_migrations"]
MIGRATION_SCHEMAS = ["supabase_migrations"]

# Roles whose presence opens the gated rules, and the two that count as API readers.
GATE_ROLES = ["anon", "authenticated", "service_role"]
API_ROLES = ["anon", "authenticated"]

# Reloptions that make a view run with the caller's rights.
SECURITY_INVOKER_OPTIONS = [
    "security_invoker=1", "security_invoker=true", "security_invoker=yes", "security_invoker=on",
]

# Object identifier alias types that block an upgrade.
REG_TYPES = [
    "regcollation", "regconfig", "regdictionary", "regnamespace", "regoper", "regoperator", "regproc",
    "regprocedure",
]

# Column names taken to hold private data.
SENSITIVE_COLUMNS = [
    "password", "passwd", "pwd", "passphrase", "secret", "secret_key", "private_key", "api_key", "apikey",
    "auth_key", "token", "jwt", "access_token", "refresh_token", "oauth_token", "session_token",
    "bearer_token", "auth_code", "session_id", "session_key", "session_secret", "recovery_code",
    "backup_code", "verification_code", "otp", "two_factor", "2fa_secret", "2fa_code",
    "ssn", "social_security", "social_security_number", "driver_license", "drivers_license",
    "license_number", "passport_number", "passport_id", "national_id", "tax_id",
    "credit_card", "card_number", "cvv", "cvc", "cvn", "bank_account", "account_number",
    "routing_number", "iban", "swift_code", "bic",
    "health_record", "medical_record", "patient_id", "insurance_number", "health_insurance",
    "medical_insurance", "treatment",
    "mac_address", "macaddr", "imei", "device_uuid",
    "pgp_key", "gpg_key", "ssh_key", "certificate", "license_key", "activation_key",
    "facial_recognition",
]

# Normalised policy expressions that are always true.
ALWAYS_TRUE = ["true", "(true)", "1=1", "(1=1)"]

# Limits of the bloat rule.
BLOAT_FACTOR = 70.0
BLOAT_WASTE_BYTES = 20 * 1024 * 1024

# Postgres catalog class OIDs (public system catalog numbers).
PG_CLASS, PG_PROC, PG_TYPE, PG_NAMESPACE, PG_ATTRIBUTE = 1259, 1255, 1247, 2615, 1249

# SQL names of built-in types.
SQL_TYPE_NAMES = {
    "int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision",
    "bool": "boolean", "varchar": "character varying", "bpchar": "character",
    "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone",
    "time": "time without time zone", "timetz": "time with time zone", "varbit": "bit varying",
}

# Diagnostic severities, lowest first.
HINT, INFORMATION, WARNING, ERROR, FATAL = range(5)
SEVERITY_NAMES = ["hint", "information", "warning", "error", "fatal"]
LEVEL_SEVERITY = {"INFO": INFORMATION, "WARN": WARNING, "ERROR": ERROR}

# Environment words a schema name should not start or end with.
ENVIRONMENT_WORDS = ["staging", "stg", "preprod", "prod", "sandbox", "sbox"]

# Words reserved by Postgres (public documentation, appendix on key words).
RESERVED_WORDS = [
    "all", "analyse", "analyze", "and", "any", "array", "as", "asc", "asymmetric", "both", "case", "cast",
    "check", "collate", "column", "constraint", "create", "current_catalog", "current_date", "current_role",
    "current_time", "current_timestamp", "current_user", "default", "deferrable", "desc", "distinct", "do",
    "else", "end", "except", "false", "fetch", "for", "foreign", "from", "grant", "group", "having", "in",
    "initially", "intersect", "into", "lateral", "leading", "limit", "localtime", "localtimestamp", "not",
    "null", "offset", "on", "only", "or", "order", "placing", "primary", "references", "returning", "select",
    "session_user", "some", "symmetric", "system_user", "table", "then", "to", "trailing", "true", "union",
    "unique", "user", "using", "variadic", "when", "where", "window", "with",
]
# Further words that begin or shape statements, counted as unreserved keywords.
STATEMENT_WORDS = [
    "add", "alter", "attach", "begin", "cascade", "commit", "concurrently", "delete", "detach", "drop",
    "exists", "if", "index", "insert", "key", "reindex", "rename", "reset", "rollback", "savepoint", "schema",
    "set", "start", "transaction", "trigger", "truncate", "type", "update", "vacuum", "validate", "values",
    "view",
]
