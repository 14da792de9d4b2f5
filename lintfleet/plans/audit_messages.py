"""The detail text of each catalog rule, in rule order. %s stands for a name or list of names."""

DETAILS = {
    "unindexed_foreign_keys": "Table `%s.%s` has a foreign key `%s` without a covering index. This can lead to suboptimal query performance.",
    "auth_rls_initplan": "Table `%s.%s` has a row level security policy `%s` that re-evaluates current_setting() or auth.<function>() for each row.",
    "no_primary_key": "Table `%s.%s` does not have a primary key",
    "unused_index": "Index `%s` on table `%s.%s` has not been used",
    "multiple_permissive_policies": "Table `%s.%s` has multiple permissive policies for role `%s` for action `%s`. Policies include `%s`",
    "duplicate_index": "Table `%s.%s` has identical indexes %s. Drop all except one of them",
    "table_bloat": "Table `%s`.`%s` has excessive bloat",
    "auth_users_exposed": 'View/Materialized View "%s" in the public schema may expose `auth.users` data to anon or authenticated roles.',
    "policy_exists_rls_disabled": "Table `%s.%s` has RLS policies but RLS is not enabled on the table. Policies include %s.",
    "rls_enabled_no_policy": "Table `%s.%s` has RLS enabled, but no policies exist",
    "security_definer_view": "View `%s.%s` is defined with the SECURITY DEFINER property",
    "function_search_path_mutable": "Function `%s.%s` has a role mutable search_path",
    "rls_disabled_in_public": "Table `%s.%s` is public, but RLS has not been enabled.",
    "extension_in_public": "Extension `%s` is installed in the public schema. Move it to another schema.",
    "rls_references_user_metadata": "Table `%s.%s` has a row level security policy `%s` that references `user_metadata`. `user_metadata` is editable by end users and should never be used in a security context.",
    "materialized_view_in_api": "Materialized view `%s.%s` is selectable by anon or authenticated roles",
    "foreign_table_in_api": "Foreign table `%s.%s` is accessible over APIs",
    "unsupported_reg_types": "Table `%s.%s` has a column `%s` with unsupported reg* type `%s`.",
    "insecure_queue_exposed_in_api": "Table `%s.%s` is public, but RLS has not been enabled.",
    "fkey_to_auth_unique": "Table `%s`.`%s` has a foreign key `%s` referencing an auth unique constraint",
    "extension_versions_outdated": "Extension `%s` is using version `%s` but version `%s` is available. Using outdated extension versions may expose the database to security vulnerabilities.",
    "sensitive_columns_exposed": "Table `%s.%s` is exposed via API without RLS and contains potentially sensitive column(s): %s. This may lead to data exposure.",
    "rls_policy_always_true": "Table `%s.%s` has an RLS policy `%s` for `%s` that allows unrestricted access%s. This effectively bypasses row-level security for %s.",
}
