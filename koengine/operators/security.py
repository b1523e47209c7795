"""Row filters: tenants, owners, access lists, policies. Each is one boolean column; default is deny."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Subject:
    """Who asks: name, roles, tenant (None: of every tenant)."""

    name: str
    roles: frozenset[str] = field(default_factory=frozenset)
    tenant: str | None = None


def role_closure(roles: Iterable[str], parents: Mapping[str, Iterable[str]]) -> frozenset[str]:
    """Roles with all their ancestors."""
    seen, todo = set(), list(roles)
    while todo:
        r = todo.pop()
        if r not in seen:
            seen.add(r)
            todo += parents.get(r, ())
    return frozenset(seen)


def acl_decision(acl: Column, principals: Iterable[str], action: str) -> Column:
    """'deny' if any matching entry denies, 'allow' if any allows, else null. An entry's ``admin`` action matches every action.

    ``acl`` is array<struct<principal, action, effect>>; a null list matches nothing.
    """
    who = list(principals)
    hit = lambda e: e["principal"].isin(*who) & ((e["action"] == action) | (e["action"] == "admin"))
    acl = F.coalesce(acl, F.expr("array()").cast("array<struct<principal:string,action:string,effect:string>>"))
    deny = F.exists(acl, lambda e: hit(e) & (e["effect"] == "deny"))
    allow = F.exists(acl, lambda e: hit(e) & (e["effect"] == "allow"))
    return F.when(deny, "deny").when(allow, "allow")


def policy_effect(df: DataFrame, policies: list[tuple[str, str, str, str]], who: Iterable[str], action: str, type_name: Column) -> Column:
    """Effect of the first matching policy (principal, action, type, effect); ``*`` matches all. Null if none matches."""
    who = list(who)
    out = F.lit(None).cast("string")
    for principal, act, kind, effect in reversed(policies):
        if (principal == "*" or principal in who) and act in ("*", action):
            out = F.when((F.lit(kind) == "*") | (type_name == kind), F.lit(effect)).otherwise(out)
    return out


def authorized(
    df: DataFrame, subject: Subject, action: str, *, tenant: str = "tenant", owner: str | None = None, acl: Column | None = None,
    policies: list[tuple[str, str, str, str]] = (), type_name: str = "type_name", parents: Mapping[str, Iterable[str]] | None = None,
) -> Column:
    """Tenant confinement first (both set and different: no), then owner or the role ``admin``, then the access list, then policies, else no."""
    roles = role_closure(subject.roles, parents or {})
    who = {subject.name, *roles}
    foreign = F.lit(False) if subject.tenant is None else F.coalesce(F.col(tenant) != subject.tenant, F.lit(False))
    mine = F.lit("admin" in roles)
    if owner:
        mine = mine | F.coalesce(F.col(owner) == subject.name, F.lit(False))
    by_acl = acl_decision(acl, who, action) if acl is not None else F.lit(None).cast("string")
    by_policy = policy_effect(df, list(policies), who, action, F.col(type_name))
    return F.when(foreign, False).when(mine, True).otherwise(F.coalesce(by_acl, by_policy, F.lit("deny")) == "allow")


def tenant_quota(heads: DataFrame, quota: int) -> DataFrame:
    """(tenant, live, over) of every tenant: live objects counted, and whether they exceed the quota."""
    live = heads.where(~F.coalesce(F.col("state"), F.lit("")).eqNullSafe("deleted"))
    return live.groupBy("tenant").agg(F.count("*").alias("live")).withColumn("over", F.col("live") > quota)


def encrypt_fields(df: DataFrame, fields: Iterable[str], keys: DataFrame, *, tenant: str = "tenant") -> DataFrame:
    """``df`` with the fields' texts replaced by AES-GCM ciphers in base64, under each tenant's key.

    ``keys`` has (tenant, key: binary of 16, 24 or 32 bytes), a row for each tenant. The tenant's name
    is bound to the cipher, so it cannot be moved to another tenant. Null fields stay null. A row
    whose tenant has no key fails when it is read: nothing is stored in the clear by accident.
    """
    k = keys.select(F.col("tenant").alias("k_tenant"), F.col("key").alias("k_"))
    joined = df.join(k, F.col(tenant).eqNullSafe(F.col("k_tenant")), "left")
    key = F.when(F.col("k_").isNotNull(), F.col("k_")).otherwise(F.raise_error(F.concat(F.lit("no key for tenant "), F.coalesce(F.col(tenant), F.lit("null")))).cast("binary"))
    bound = F.coalesce(F.col(tenant), F.lit(""))
    out = {f: F.when(F.col(f).isNotNull(), F.base64(F.aes_encrypt(F.col(f).cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), bound))) for f in fields}
    return joined.withColumns(out).drop("k_tenant", "k_")


def decrypt_fields(df: DataFrame, fields: Iterable[str], keys: DataFrame, *, tenant: str = "tenant") -> DataFrame:
    """The reverse of :func:`encrypt_fields`; a field is null if its tenant has no key or the cipher was changed."""
    k = keys.select(F.col("tenant").alias("k_tenant"), F.col("key").alias("k_"))
    joined = df.join(k, F.col(tenant).eqNullSafe(F.col("k_tenant")), "left")
    bound = F.coalesce(F.col(tenant), F.lit(""))
    out = {f: F.try_aes_decrypt(F.unbase64(F.col(f)), F.col("k_"), F.lit("GCM"), F.lit("DEFAULT"), bound).cast("string") for f in fields}
    return joined.withColumns(out).drop("k_tenant", "k_")


def readable(df: DataFrame, subject: Subject, **rules) -> DataFrame:
    """The rows that ``subject`` may read: :func:`authorized` as a filter inside the scan, before any search or traversal."""
    return df.where(authorized(df, subject, "read", **rules))
