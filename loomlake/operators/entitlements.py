"""Roles, rules and what they entitle to, for all users at once.

Rules meet permissions by user first (an equi-join), then segment by segment; there is no cross join.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.rules import matches


def of_organization(df: DataFrame, organization: Column | str | int | None, column: str = "organization_id") -> DataFrame:
    """Rows of one organization; none for a null or empty one (fails closed)."""
    wanted = organization if isinstance(organization, Column) else F.lit(organization)
    return df.where((F.col(column).cast("string") == wanted.cast("string")) & (wanted.cast("string") != ""))


def visible_roles(roles: DataFrame) -> DataFrame:
    return roles.where(~F.coalesce("hidden", F.lit(False)))


#: Asks of a task; a session's own number of partitions holds where they are fewer.
ASKS = 200_000


def _dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows dealt by key into so many partitions, if that is more than the session's number."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def user_rules(memberships: DataFrame, members: DataFrame, rules: DataFrame, parts: int = 0) -> DataFrame:
    """user_id, organization_id, owner, name, hidden, rule, resource_id: rules of roles of the user's own organization."""
    mine = members.select("user_id", "organization_id", "name").join(memberships, ["user_id", "organization_id"])
    return _dealt(mine, parts, "organization_id", "name").join(_dealt(rules, parts, "organization_id", "name"), ["organization_id", "name"])


def effective(memberships: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """For each member: owner, sorted distinct rules and sorted names of visible roles."""
    granted = user_rules(memberships, members, rules).groupBy("user_id", "organization_id").agg(
        F.array_sort(F.collect_set("rule")).alias("rules"),
        F.array_sort(F.collect_set(F.when(~F.coalesce("hidden", F.lit(False)), F.col("name")))).alias("roles"),
    )
    empty = F.expr("cast(array() as array<string>)")
    return memberships.join(granted, ["user_id", "organization_id"], "left").withColumns({"rules": F.coalesce("rules", empty), "roles": F.coalesce("roles", empty)})


def decide(asks: DataFrame, resources: DataFrame, memberships: DataFrame, members: DataFrame, rules: DataFrame, actions: list[str], namespace: str) -> DataFrame:
    """A flag for each action, for every (caller, id) asked about.

    An owner of the resource's organization may do everything in it; else some rule of the caller's roles
    must match, in the same organization.  Rules that name a resource meet only asks for it, so a user
    with very many of those costs one equi-join; the others are few for each user.  Partitions grow
    with the asks, so a task's memory doesn't.
    """
    parts = ceil(asks.count() / ASKS)
    who = memberships.select(F.col("user_id").alias("caller"), F.col("organization_id").alias("_org"), "owner")
    wanted = _dealt(asks, parts, "id").join(_dealt(resources.select("id", "resource", "organization_id"), parts, "id"), "id")
    wanted = _dealt(wanted, parts, "caller").join(who, "caller", "left").withColumn("_same", F.col("organization_id").eqNullSafe(F.col("_org")))
    granted = user_rules(memberships, members, rules, parts).select(F.col("user_id").alias("caller"), "rule", F.col("resource_id").alias("_rid"))
    general = wanted.where("_same").join(_dealt(granted.where("_rid is null").drop("_rid"), parts, "caller").distinct(), "caller")
    wanted = _dealt(wanted, parts, "caller", "id")
    own = wanted.where("_same").join(_dealt(granted.where("_rid is not null").withColumnRenamed("_rid", "id"), parts, "caller", "id").distinct(), ["caller", "id"])
    permission = lambda a: F.concat_ws(":", F.lit(namespace), "resource", F.lit(a), F.col("id").cast("string"))
    columns = ["caller", "id", "rule", "resource"]
    flags = _dealt(general.select(columns).unionAll(own.select(columns)), parts, "caller", "id").groupBy("caller", "id").agg(*[F.bool_or(matches(F.col("rule"), permission(a))).alias(f"_{a}") for a in actions])
    return wanted.join(flags, ["caller", "id"], "left").select("caller", "id", "resource", "organization_id", *[F.coalesce(F.col("_same") & (F.col("owner") | F.coalesce(f"_{a}", F.lit(False))), F.lit(False)).alias(a) for a in actions])


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page and the exact total; page from 1, size 1 to 100, else the defaults 1 and 20."""
    number, size = max(number, 1), size if 1 <= size <= 100 else 20
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(df.count()).cast("long"))


def newest(df: DataFrame, parent: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each parent."""
    n = F.row_number().over(Window.partitionBy(*parent).orderBy(*order))
    return df.withColumn("n", n).where(F.col("n") <= cap)


def ordered_union(*lists: Column) -> Column:
    """Distinct non-blank elements, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.concat(*lists), lambda x: x.isNotNull() & (x != "")))


def drop_prefixed(rules: Column, prefix: str) -> Column:
    return F.filter(rules, lambda r: ~r.startswith(prefix))


def with_filters(df: DataFrame, **wanted) -> DataFrame:
    """Rows that pass every filter that isn't blank."""
    for column, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(column) == value)
    return df


def light(df: DataFrame, heavy: tuple[str, ...] = ("text", "content", "embedding")) -> DataFrame:
    """A listing without the heavy columns, which then aren't read."""
    return df.drop(*heavy)


def decorated(rows: DataFrame, details: DataFrame, key: str, detail_key: str, columns: list[str]) -> DataFrame:
    """Every row with the columns of its one detail; nulls where there is none, and of several details any one."""
    one = details.select(F.col(detail_key).alias(key), *columns).dropDuplicates([key])
    return rows.join(one, key, "left")


def roles_of_users(members: DataFrame, memberships: DataFrame) -> DataFrame:
    """user_id, organization_id, name of the roles that hold a user within the user's own organization.

    ``members``: a row for each role and member; explode a stored array first.
    """
    return members.select("user_id", "organization_id", "name").join(memberships.select("user_id", "organization_id"), ["user_id", "organization_id"])


def ownership(owned: DataFrame, namespace: str, owner: str = "user_id") -> DataFrame:
    """What each owner owns: owner_id, n and the rules (one for each resource, sorted).  ``owned``: owner, resource, id."""
    rule = F.concat(F.lit(f"{namespace}:"), "resource", F.lit(":*:"), F.col("id").cast("string"))
    return owned.select(F.col(owner).alias("owner_id"), rule.alias("rule")).groupBy("owner_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("rule")).alias("rules"))
