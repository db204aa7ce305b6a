"""Tools, credentials and references between records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import is_json, trimmed
from loomlake.storage import durable


def missing_references(links: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Links whose target isn't there."""
    return links.join(targets.select(key).distinct(), key, "left_anti")


def advertised_names(tools: DataFrame, group: str, server: str, name: str, limit: int = 64, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``advertised``: server__name with other characters as ``_``, at most ``limit`` long, unique in its group.

    Of names that would be equal, the first (by server, name and ``order``) keeps it and the n-th ends in ``_n``,
    within the limit.  Where that is some other tool's name, n goes on by the number of those that share the
    name, until it is free; tools that want one free name at once get it in order.  Null servers and names
    are empty.  ``order`` has to tell tools of one server and name apart.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = F.substring(F.regexp_replace(F.concat_ws("__", text(server), text(name)), "[^a-zA-Z0-9_-]", "_"), 1, limit)
    places = [F.col(c).asc_nulls_first() for c in (server, name, *order)]
    numbered = tools.withColumn("_base", base)
    same = Window.partitionBy(group, "_base")
    numbered = numbered.withColumns({"_n": F.row_number().over(same.orderBy(*places)), "_many": F.count("*").over(same)})
    suffix = F.concat(F.lit("_"), F.col("_n").cast("string"))
    candidate = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.substr("_base", F.lit(1), F.lit(limit) - F.length(suffix)), suffix))
    state = numbered.withColumns({"advertised": candidate, "_round": F.lit(0)})
    # First keepers of a name go before those that come to it by a number, and earlier rounds before later ones.
    first = Window.partitionBy(group, "advertised").orderBy(F.when(F.col("_n") == 1, -1).otherwise(F.col("_round")), *places)
    while True:
        state = durable(state.withColumn("_lost", F.row_number().over(first) > 1))
        if not state.where("_lost").limit(1).count():
            return state.select(*tools.columns, "advertised")
        state = state.withColumns({"_n": F.when(F.col("_lost"), F.col("_n") + F.col("_many")).otherwise(F.col("_n")), "_round": F.when(F.col("_lost"), F.col("_round") + 1).otherwise(F.col("_round"))})
        state = state.withColumn("advertised", F.when(F.col("_lost"), candidate).otherwise(F.col("advertised")))


def own_or_wildcard(wanted: DataFrame, entries: DataFrame, key: list[str], tool: str = "tool", value: str = "value") -> DataFrame:
    """Each wanted tool's own entry, even an empty one, or else the ``*`` entry; names that begin with ``/`` don't inherit."""
    own = entries.select(*key, tool, F.col(value).alias("_own"), F.lit(True).alias("_has"))
    star = entries.where(F.col(tool) == "*").select(*key, F.col(value).alias("_star"))
    both = wanted.join(own, [*key, tool], "left").join(star, key, "left")
    inherits = ~F.col(tool).startswith("/")
    return both.withColumn(value, F.when(F.col("_has"), F.col("_own")).when(inherits, F.col("_star"))).drop("_own", "_star", "_has")


def missing_access(required: Column, granted: Column) -> Column:
    """Scopes that are required and not granted; none required is always covered."""
    return F.array_except(required, granted)


def credential_outcome(required: DataFrame, identities: DataFrame, providers: DataFrame) -> DataFrame:
    """ok / not_connected / insufficient_access / provider_gone for each (user, organization, provider, required scopes)."""
    have = identities.select("user_id", "provider", F.col("status").alias("_status"), F.col("granted").alias("_granted"), F.lit(True).alias("_connected"))
    known = providers.select("organization_id", F.col("name").alias("provider"), F.lit(True).alias("_known"))
    joined = required.join(have, ["user_id", "provider"], "left").join(known, ["organization_id", "provider"], "left")
    uncovered = F.size(missing_access(F.col("required"), F.coalesce("_granted", F.expr("cast(array() as array<string>)")))) > 0
    outcome = F.when(F.col("_known").isNull(), "provider_gone").when(F.col("_connected").isNull(), "not_connected").when(F.col("_status").eqNullSafe("revoked") | uncovered, "insufficient_access").otherwise("ok")
    return joined.withColumn("outcome", outcome).drop("_status", "_granted", "_connected", "_known")


def resolve_terms(asked: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Access terms (key, position, term) as scopes: a level's name becomes its scopes, others pass through.

    Rows: key, scopes in order of first occurrence, and the level if exactly one was named and nothing else.
    ``levels``: level, scope_position, scope.
    """
    t = asked.withColumn("term", F.regexp_replace("term", r"(?U)^\s+|\s+$", "")).where("term <> ''")
    wide = t.join(levels.withColumnRenamed("level", "term"), "term", "left")
    is_level = F.col("scope").isNotNull()
    scope = F.coalesce("scope", "term")
    pairs = F.array_sort(F.collect_list(F.struct("position", F.coalesce("scope_position", F.lit(0)).alias("p"), scope.alias("scope"))))
    named = F.count_distinct(F.when(is_level, F.struct("position")))
    raw = F.count_if(~is_level)
    return wide.groupBy(key).agg(F.array_distinct(F.transform(pairs, lambda x: x["scope"])).alias("scopes"), F.when((named == 1) & (raw == 0), F.max(F.when(is_level, F.col("term")))).alias("level"))


def organization_of(records: DataFrame, memberships: DataFrame, user: str = "user_id", column: str = "organization_id") -> DataFrame:
    """The record's own organization, or else its user's."""
    m = memberships.select(F.col("user_id").alias(user), F.col("organization_id").alias("_member_of"))
    return records.join(m, user, "left").withColumn(column, F.coalesce(column, "_member_of")).drop("_member_of")


def expiring(identities: DataFrame, horizon: Column) -> DataFrame:
    """Refreshable, not revoked, and expired by the horizon; without an expiry a record never qualifies."""
    return identities.where(F.col("refreshable") & (F.col("expires_at") <= horizon) & ~F.col("status").eqNullSafe("revoked"))


def refreshed(work: DataFrame) -> DataFrame:
    """Status after a refresh with ``outcome`` success / transient / permanent / nothing."""
    o = F.col("outcome")
    more = F.col("refresh_failures") + 1
    return work.withColumns({
        "new_status": F.when(o == "success", "active").when(o == "transient", "refresh_failed").when(o == "permanent", "revoked").otherwise(F.col("status")),
        "new_failures": F.when(o == "success", F.lit(0).cast("long")).when(o.isin("transient", "permanent"), more).otherwise(F.col("refresh_failures")),
        "still_refreshable": (o != "nothing") & F.col("refreshable"),
    })


#: Headers that belong to the platform or to the connection, in lower case.
RESERVED_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length", "content-type", "accept", "x-user-id")


def credential_config_error(providers: Column, headers: Column, params: Column, reserved_prefix: str = "x-plat-") -> Column:
    """The first thing wrong with what a tool effectively resolves to (own or inherited); null if nothing.

    ``providers``: array of struct<provider, level> that it requires; ``headers`` and ``params``: arrays of names that
    credentials are put into.  Nulls are empty arrays.  Names of headers are compared without case.
    """
    none = F.expr("cast(array() as array<string>)")
    named = F.transform(F.coalesce(providers, F.expr("cast(array() as array<struct<provider:string,level:string>>)")), lambda p: p["provider"])
    headers, params = F.coalesce(headers, none), F.coalesce(params, none)
    lower = F.transform(headers, lambda h: F.lower(h))

    def header(h: Column, i: Column) -> Column:
        low = F.lower(h)
        return (
            F.when(~h.rlike("^[A-Za-z0-9][A-Za-z0-9-]{0,63}$"), "bad header").when(low.isin(*RESERVED_HEADERS) | low.startswith(reserved_prefix), "reserved header")
            .when(F.array_contains(F.slice(lower, 1, i), low), "header set twice")
        )

    def param(p: Column, i: Column) -> Column:
        return F.when(~p.rlike("^[A-Za-z_][A-Za-z0-9_.-]{0,63}$"), "bad param").when(F.array_contains(F.slice(params, 1, i), p), "param set twice")

    first = lambda names, check: F.get(F.filter(F.transform(names, check), lambda e: e.isNotNull()), F.lit(0))
    some = (F.size(headers) > 0) | (F.size(params) > 0)
    return F.coalesce(
        F.when(F.size(F.array_distinct(named)) < F.size(named), "provider required twice"),
        F.when(some & (F.size(named) == 0), "authorization without requirement"),
        first(headers, header),
        first(params, param),
    )


def provider_error(name: Column, level: Column, scopes: Column) -> Column:
    """The first thing wrong with a provider's access level; null if nothing."""
    return (
        F.when(~F.coalesce(name, F.lit("")).rlike("^[a-z0-9][a-z0-9_-]{0,63}$"), "provider name").when(~F.coalesce(level, F.lit("")).rlike("^[a-z0-9][a-z0-9_-]{0,31}$"), "level name")
        .when(F.coalesce(F.size(scopes), F.lit(0)) <= 0, "no scopes").when(F.exists(scopes, lambda s: trimmed(s) == ""), "empty scope")
    )


def agent_error(model: Column, name: Column, schema: Column, models: tuple[str, ...], most_bytes: int = 65_536) -> Column:
    """The first thing wrong with an agent; its output schema, if not blank, has to be one JSON object."""
    v = F.try_parse_json(schema)
    is_object = is_json(schema) & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(~F.coalesce(model, F.lit("")).isin(*models), "unknown model").when(F.coalesce(trimmed(name), F.lit("")) == "", "no name").when((schema != "") & (~is_object | (F.octet_length(schema) > most_bytes)), "schema")


def users_of_keys(shown: DataFrame, users: DataFrame, key: str = "key") -> DataFrame:
    """Shown keys with the user whose stored hash they have; ``users``: user_id, api_keys (array of struct with key_hash), email_verified.

    Keys of users without a verified address, and unknown ones, drop out.
    """
    hashes = users.where("email_verified").select("user_id", F.explode("api_keys.key_hash").alias("_hash"))
    return shown.withColumn("_hash", F.sha2(F.col(key), 256)).join(hashes, "_hash").drop("_hash")


def bound_tools(agents: DataFrame, tools: DataFrame) -> DataFrame:
    """agent_id, server_id, tool_id of the tools of the servers that an agent names, within its organization."""
    each = agents.select("agent_id", "organization_id", F.explode("servers").alias("server_id")).distinct()
    return each.join(tools, ["organization_id", "server_id"]).select("agent_id", "server_id", "tool_id")


def unadvertised(entries: DataFrame, offered: DataFrame, server: str = "server_id", tool: str = "tool") -> DataFrame:
    """Configured tools that their server doesn't offer; wildcards and probe keys aren't tools."""
    return entries.where((F.col(tool) != "*") & ~F.col(tool).startswith("/")).select(server, tool).distinct().join(offered, [server, tool], "left_anti")


def granted_level(granted: Column, asked: Column, level: str) -> tuple[Column, Column]:
    """The scopes that count as granted (what was asked, if the answer names none), and the level if they cover it."""
    scopes = F.when(F.size(granted) > 0, granted).otherwise(asked)
    return scopes, F.when(F.size(missing_access(asked, scopes)) == 0, level)


def credential_fields(answer: Column, now: Column) -> tuple[Column, Column]:
    """Scopes (parted by blanks) and expiry (epoch seconds) of a credential's JSON, a variant.

    Scopes come as a string or a list; the expiry as RFC 3339, epoch seconds or seconds from ``now``.
    """
    listed = F.array_join(F.try_variant_get(answer, "$.scope", "array<string>"), " ")
    scopes = F.coalesce(listed, F.try_variant_get(answer, "$.scope", "string"), F.lit(""))
    at = F.try_to_timestamp(F.try_variant_get(answer, "$.expires_at", "string"))
    return scopes, F.coalesce(F.try_variant_get(answer, "$.expires_at", "bigint"), F.unix_timestamp(at), now + F.try_variant_get(answer, "$.expires_in", "bigint"))


def counted(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """kind, name, n: how many rows have each value of a column."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")


def revocation_tally(outcomes: DataFrame, key: str = "provider") -> DataFrame:
    """Of each provider: how many credentials were revoked, can't be, or failed to be, and how many are deleted in all."""
    o = F.col("outcome")
    return outcomes.groupBy(key).agg(*[F.count_if(o == x).alias(x) for x in ("revoked", "unsupported", "failed")], F.count("*").alias("deleted"))
