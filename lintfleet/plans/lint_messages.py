"""The message of each migration rule, in rule order. %s stands for a name from the statement."""

MESSAGES = {
    "addSerialColumn": "Adding a column with type %s requires a table rewrite.",
    "addSerialColumn.generated": "Adding a column with GENERATED ALWAYS AS ... STORED requires a table rewrite.",
    "addingFieldWithDefault": "Adding a column with a DEFAULT value causes a table rewrite.",
    "addingFieldWithDefault.generated": "Adding a generated column requires a table rewrite.",
    "addingFieldWithDefault.volatile": "Adding a column with a volatile default value causes a table rewrite.",
    "addingForeignKeyConstraint": "Adding a foreign key constraint requires a table scan and locks on both tables.",
    "addingForeignKeyConstraint.inline": "Adding a column with a foreign key constraint requires a table scan and locks.",
    "addingNotNullField": "Setting a column NOT NULL blocks reads while the table is scanned.",
    "addingPrimaryKeyConstraint": "Adding a PRIMARY KEY constraint results in locks and table rewrites.",
    "addingRequiredField": "Adding a new column that is NOT NULL and has no default value to an existing table effectively makes it required.",
    "avoidAddingExclusionConstraint": "Adding an exclusion constraint acquires an ACCESS EXCLUSIVE lock.",
    "avoidAlterEnumAddValue": "ALTER TYPE ... ADD VALUE cannot be used in a transaction block before Postgres 12.",
    "avoidAttachingPartition": "Attaching a partition acquires an ACCESS EXCLUSIVE lock on the parent table.",
    "avoidCreateTrigger": "Creating a trigger acquires a SHARE ROW EXCLUSIVE lock on the table.",
    "avoidEnableDisableTrigger": "Enabling or disabling a trigger acquires a SHARE ROW EXCLUSIVE lock.",
    "avoidWideLockWindow": "Acquiring a lock on %s while already holding ACCESS EXCLUSIVE locks on other tables.",
    "banCharField": "CHAR type is discouraged due to space padding behavior.",
    "banConcurrentIndexCreationInTransaction": "CREATE INDEX CONCURRENTLY cannot be used inside a transaction block.",
    "banDeleteWithoutWhere": "A DELETE without a WHERE clause will remove all rows from the table.",
    "banDropColumn": "Dropping a column may break existing clients.",
    "banDropDatabase": "Dropping a database may break existing clients.",
    "banDropNotNull": "Dropping a NOT NULL constraint may break existing clients.",
    "banDropSchema": "Dropping a schema will remove all objects within it and may break existing clients.",
    "banDropTable": "Dropping a table may break existing clients.",
    "banDropTrigger": "Dropping a trigger acquires an ACCESS EXCLUSIVE lock on the table.",
    "banTruncate": "Truncating a table removes all rows and can cause data loss.",
    "banTruncateCascade": "The `CASCADE` option will also truncate any tables that are foreign-keyed to the specified tables.",
    "banUpdateWithoutWhere": "An UPDATE without a WHERE clause will modify all rows in the table.",
    "banVacuumFull": "VACUUM FULL rewrites the entire table and blocks all access.",
    "changingColumnType": "Changing a column type requires a table rewrite and blocks reads and writes.",
    "concurrentRefreshMatviewLock": "REFRESH MATERIALIZED VIEW CONCURRENTLY still acquires an EXCLUSIVE lock.",
    "constraintMissingNotValid": "Adding a constraint without NOT VALID will block reads and writes while validating existing rows.",
    "creatingEnum": "Creating enum type %s is not recommended.",
    "disallowUniqueConstraint": "Adding a UNIQUE constraint requires an ACCESS EXCLUSIVE lock.",
    "lockTimeoutWarning": "Statement takes ACCESS EXCLUSIVE lock on %s without lock timeout set.",
    "lockTimeoutWarning.index": "Statement takes SHARE lock on %s while creating index %s without lock timeout set.",
    "multipleAlterTable": "Multiple ALTER TABLE statements found for table %s.",
    "preferBigInt": "Using smaller integer types can lead to overflow issues.",
    "preferBigintOverInt": "INTEGER type may lead to overflow issues.",
    "preferBigintOverSmallint": "SMALLINT has a very limited range that is easily exceeded.",
    "preferIdentity": "Prefer IDENTITY columns over SERIAL types.",
    "preferJsonb": "Prefer JSONB over JSON for better performance and functionality.",
    "preferRobustStmts.name": "Concurrent index should have an explicit name.",
    "preferRobustStmts.index": "Concurrent index creation should use IF NOT EXISTS.",
    "preferRobustStmts.drop": "Concurrent drop should use IF EXISTS.",
    "preferRobustStmts.drop_table": "DROP TABLE should use IF EXISTS.",
    "preferRobustStmts.create_table": "CREATE TABLE should use IF NOT EXISTS.",
    "preferTextField": "Changing the size of a varchar field requires an ACCESS EXCLUSIVE lock.",
    "preferTimestamptz": "Prefer TIMESTAMPTZ over TIMESTAMP for better timezone handling.",
    "renamingColumn": "Renaming a column may break existing clients.",
    "renamingTable": "Renaming a table may break existing clients.",
    "requireConcurrentDetachPartition": "Detaching a partition without CONCURRENTLY blocks all table access.",
    "requireConcurrentIndexCreation": "Creating an index non-concurrently blocks writes to the table.",
    "requireConcurrentIndexDeletion": "Dropping an index non-concurrently blocks reads and writes to the table.",
    "requireConcurrentRefreshMatview": "REFRESH MATERIALIZED VIEW without CONCURRENTLY blocks all reads.",
    "requireConcurrentReindex": "REINDEX without CONCURRENTLY blocks all table access.",
    "requireIdleInTransactionTimeout": "Statement takes a dangerous lock without idle_in_transaction_session_timeout set.",
    "requireSeparateConstraintValidation": "Constraint %s was added as NOT VALID and validated in the same transaction.",
    "requireStatementTimeout": "Statement takes a dangerous lock without a statement_timeout set.",
    "runningStatementWhileHoldingAccessExclusive": "Running statement while holding ACCESS EXCLUSIVE lock.",
    "transactionNesting.nested": "Nested transaction detected.",
    "transactionNesting.begin": "Transaction already managed by migration tool.",
    "transactionNesting.end": "Attempting to end transaction managed by migration tool.",
}
