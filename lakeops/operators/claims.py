"""Principals from decoded token claims (S16), for a whole table of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def principals_from_claims(claims: DataFrame, required_role: str, claims_col: str = "claims") -> DataFrame:
    """claims rows plus ``status``, ``username``, ``roles``, ``groups``.

    Roles come from ``realm_access.roles`` and must be an array of strings;
    the required role must be present (``missing_role`` otherwise).  Username
    is ``preferred_username`` when a non-empty string, else ``sub``.  Groups
    are optional and non-string members are skipped.  Rows that fail a check
    keep a ``status`` reason instead of raising, so one bad token never fails
    the job.
    """
    v = F.try_parse_json(F.col(claims_col))
    ra = F.try_variant_get(v, "$.realm_access", "variant")
    roles_v = F.try_variant_get(v, "$.realm_access.roles", "variant")
    ra_kind, roles_kind = F.schema_of_variant(ra), F.schema_of_variant(roles_v)
    roles = F.try_variant_get(v, "$.realm_access.roles", "array<string>")
    status = (F.when(ra.isNull(), "invalid:realm_access missing")
              .when(~ra_kind.startswith("OBJECT"), "invalid:realm_access not an object")
              .when(roles_v.isNull(), "invalid:roles missing")
              .when(~roles_kind.startswith("ARRAY"), "invalid:roles not an array")
              .when(~roles_kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
                    | F.coalesce(F.exists(roles, lambda r: r.isNull()), F.lit(False)),
                    "invalid:roles contains non-string element")
              .when(~F.coalesce(F.array_contains(roles, required_role), F.lit(False)), "missing_role")
              .otherwise("ok"))
    pu = F.try_variant_get(v, "$.preferred_username", "variant")
    sub = F.try_variant_get(v, "$.sub", "variant")
    pu_s = F.when(F.schema_of_variant(pu) == "STRING", F.try_variant_get(pu, "$", "string"))
    sub_s = F.when(F.schema_of_variant(sub) == "STRING", F.try_variant_get(sub, "$", "string"))
    username = F.coalesce(F.nullif(pu_s, F.lit("")), sub_s, F.lit(""))
    groups = F.transform(
        F.filter(F.try_variant_get(v, "$.groups", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: F.try_variant_get(x, "$", "string"))
    return (claims.withColumn("status", status).withColumn("username", username)
            .withColumn("roles", F.when(F.col("status").isin("ok", "missing_role"), roles))
            .withColumn("groups", groups))
