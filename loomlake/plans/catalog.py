"""Queries on tools, credentials and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import catalog as op
from loomlake.operators.maintenance import latest
from loomlake.plans.tables import cte, load
from loomlake.registry import query

MODELS = ("small", "medium", "large")


@query("j2_reference_integrity", cte("agent_kbs", "kb_documents", "agents") + """SELECT 'agent_kb' AS relation, CAST(agent_id AS BIGINT) AS id, CAST(kb_id AS VARCHAR) AS missing FROM agent_kbs WHERE kb_id NOT IN (SELECT kb_id FROM kb_documents)
    UNION ALL SELECT 'agent_model', id, model FROM agents WHERE model NOT IN ('small', 'medium', 'large')
    UNION ALL SELECT 'agent_server', a.id, CAST(t.server AS VARCHAR) FROM agents a JOIN (SELECT id AS agent, unnest([id, id + 1, id + 25]) AS server FROM agents) t ON t.agent = a.id WHERE t.server NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT DISTINCT 'step_agent', l_orderkey, CAST(l_suppkey + 5 AS VARCHAR) FROM lineitem WHERE l_suppkey + 5 NOT IN (SELECT id FROM agents)""")
def j2(spark, sf_dir):
    kbs, agents = load(spark, sf_dir, "agent_kbs"), load(spark, sf_dir, "agents")
    models = spark.createDataFrame([(m,) for m in MODELS], "model string")
    steps = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step_of"), (F.col("l_suppkey") + 5).alias("id")).distinct()
    servers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server_id"))
    named = agents.select("id", F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 25)).alias("server_id"))
    say = lambda df, relation, key, missing: df.select(F.lit(relation).alias("relation"), F.col(key).cast("long").alias("id"), F.col(missing).cast("string").alias("missing"))
    return (
        say(op.missing_references(kbs, load(spark, sf_dir, "kb_documents"), "kb_id"), "agent_kb", "agent_id", "kb_id")
        .unionAll(say(op.missing_references(agents, models, "model"), "agent_model", "id", "model"))
        .unionAll(say(op.missing_references(named, servers, "server_id"), "agent_server", "id", "server_id"))
        .unionAll(say(op.missing_references(steps, agents, "id"), "step_agent", "step_of", "id"))
    )


@query("j7_key_lookup", cte("users") + "SELECT e.event_id, u.id AS user_id FROM events e JOIN users u ON sha256('sk_' || CAST(u.id AS VARCHAR)) = sha256('sk_' || CAST(e.event_id % 3000 AS VARCHAR)) WHERE u.email_verified")
def j7(spark, sf_dir):
    key = F.sha2(F.concat(F.lit("sk_"), F.col("id").cast("string")), 256)
    users = load(spark, sf_dir, "users").select(F.col("id").alias("user_id"), "email_verified", F.array(F.struct(key.alias("key_hash"))).alias("api_keys"))
    shown = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sk_"), (F.col("event_id") % 3000).cast("string")).alias("key"))
    return op.users_of_keys(shown, users).select("event_id", "user_id")


@query("j8_tool_binding", cte("agents", "tools") + "SELECT a.id AS agent_id, t.server_id, t.tool_id FROM agents a JOIN tools t ON t.organization_id = a.organization_id AND t.server_id IN (a.id, a.id + 1, a.id + 25)")
def j8(spark, sf_dir):
    agents = load(spark, sf_dir, "agents").select(F.col("id").alias("agent_id"), "organization_id", F.array(F.col("id"), F.col("id") + 1, F.col("id") + 25).alias("servers"))
    return op.bound_tools(agents, load(spark, sf_dir, "tools"))


@query("w13_advertised_names", cte("tools") + """, b AS (SELECT organization_id, server_id, tool_id, name, substring(regexp_replace(CAST(server_id AS VARCHAR) || '__' || name, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64) AS base FROM tools),
    n AS (SELECT *, row_number() OVER (PARTITION BY organization_id, base ORDER BY server_id, name, tool_id) AS n FROM b)
    SELECT organization_id, tool_id, CASE WHEN n > 1 THEN substring(base, 1, 64 - length('_' || n)) || '_' || n ELSE base END AS advertised FROM n""")
def w13(spark, sf_dir):
    return op.advertised_names(load(spark, sf_dir, "tools"), "organization_id", "server_id", "name", order=("tool_id",)).select("organization_id", "tool_id", "advertised")


@query("w13_names_are_unique", cte("tools") + "SELECT organization_id, count(*) AS tools, count(*) AS names, true AS short FROM tools GROUP BY organization_id")
def w13_unique(spark, sf_dir):
    """Names that a number could make twice, or that are alike once they are cut: there are as many as tools."""
    k = F.col("tool_id")
    name = F.when(k % 3 == 0, "find it").when(k % 3 == 1, F.concat(F.lit("find_it_"), (k % 5).cast("string"))).otherwise(F.concat(F.repeat(F.lit("long"), F.lit(20)), (k % 4).cast("string")))
    named = op.advertised_names(load(spark, sf_dir, "tools").withColumns({"server_id": F.lit(1), "name": name}), "organization_id", "server_id", "name", order=("tool_id",))
    return named.groupBy("organization_id").agg(F.count("*").alias("tools"), F.count_distinct("advertised").alias("names"), (F.max(F.length("advertised")) <= 64).alias("short"))


def _identities(spark, sf_dir):
    i = load(spark, sf_dir, "identities")
    return i.withColumn("granted", F.filter(F.split("scopes", ","), lambda s: s != ""))


_REQUIRED = """SELECT o_orderkey AS id, o_custkey AS user_id, c_nationkey AS organization_id, CASE o_orderkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'github' ELSE 'jira' END AS provider,
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'repo' WHEN 2 THEN 'repo,user' ELSE 'read:org' END AS need FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("j9_credential_outcomes", cte("identities", "identity_providers") + f""", q AS ({_REQUIRED}) SELECT q.id, CASE WHEN p.name IS NULL THEN 'provider_gone' WHEN i.user_id IS NULL THEN 'not_connected'
    WHEN i.status IS NOT DISTINCT FROM 'revoked' OR (need <> '' AND len(list_filter(string_split(need, ','), lambda x: NOT list_contains(string_split(i.scopes, ','), x))) > 0) THEN 'insufficient_access' ELSE 'ok' END AS outcome
    FROM q LEFT JOIN identities i ON i.user_id = q.user_id AND i.provider = q.provider LEFT JOIN identity_providers p ON p.organization_id = q.organization_id AND p.name = q.provider""")
def j9(spark, sf_dir):
    needs = spark.sql(_REQUIRED.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=load(spark, sf_dir, "orders"), customer=load(spark, sf_dir, "customer"))
    needs = needs.withColumn("required", F.filter(F.split("need", ","), lambda s: s != ""))
    return op.credential_outcome(needs, _identities(spark, sf_dir), load(spark, sf_dir, "identity_providers")).select("id", "outcome")


@query("j10_organization_fallback", cte("identities", "memberships") + "SELECT i.user_id, i.provider, coalesce(i.organization_id, m.organization_id) AS organization_id FROM identities i LEFT JOIN memberships m USING (user_id)")
def j10(spark, sf_dir):
    return op.organization_of(load(spark, sf_dir, "identities"), load(spark, sf_dir, "memberships")).select("user_id", "provider", "organization_id")


@query("x2_scope_coverage", cte("identities") + """SELECT user_id, provider, array_to_string(list_filter(['repo', 'user'], lambda x: NOT list_contains(string_split(scopes, ','), x)), ',') AS missing FROM identities""")
def x2(spark, sf_dir):
    need = F.array(F.lit("repo"), F.lit("user"))
    return _identities(spark, sf_dir).select("user_id", "provider", F.array_join(op.missing_access(need, F.col("granted")), ",").alias("missing"))


_TERMS = """SELECT c_custkey AS user_id, 1 AS position, CASE c_custkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN ' admin ' WHEN 2 THEN 'gist' ELSE '' END AS term FROM customer
    UNION ALL SELECT c_custkey, 2, CASE c_custkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN '' ELSE 'repo' END FROM customer"""
_LEVELS = [("read", 0, "repo:status"), ("read", 1, "read:org"), ("admin", 0, "repo"), ("admin", 1, "admin:org")]


@query("x3_access_terms", f"""WITH a AS ({_TERMS}), l AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}, '{c}')" for a, b, c in _LEVELS)}) v(level, p, scope)),
    w AS (SELECT user_id, position, trim(term) AS term, coalesce(l.p, 0) AS p, coalesce(l.scope, trim(term)) AS scope, l.level FROM a LEFT JOIN l ON l.level = trim(term) WHERE trim(term) <> ''),
    f AS (SELECT user_id, scope, min(position * 10 + p) AS place FROM w GROUP BY 1, 2)
    SELECT user_id, string_agg(scope, ',' ORDER BY place) AS scopes, (SELECT CASE WHEN count(DISTINCT position) FILTER (WHERE level IS NOT NULL) = 1 AND count(*) FILTER (WHERE level IS NULL) = 0 THEN max(level) END FROM w WHERE w.user_id = f.user_id) AS level FROM f GROUP BY user_id""")
def x3(spark, sf_dir):
    asked = spark.sql(_TERMS.replace("FROM customer", "FROM {customer}"), customer=load(spark, sf_dir, "customer"))
    levels = spark.createDataFrame(_LEVELS, "level string, scope_position int, scope string")
    return op.resolve_terms(asked, levels, "user_id").select("user_id", F.array_join("scopes", ",").alias("scopes"), "level")


@query("x4_granted_reconciliation", cte("identities") + "SELECT user_id, provider, CASE WHEN scopes <> '' THEN scopes ELSE 'repo' END AS granted, CASE WHEN scopes = '' OR list_contains(string_split(scopes, ','), 'repo') THEN 'read' END AS level FROM identities")
def x4(spark, sf_dir):
    granted, level = op.granted_level(F.col("granted"), F.array(F.lit("repo")), "read")
    return _identities(spark, sf_dir).select("user_id", "provider", F.array_join(granted, ",").alias("granted"), level.alias("level"))


# Requirements of servers: '*' of most, own entries of every fifth tool (some empty), probe keys.
_ENTRIES = """SELECT s_suppkey AS server_id, '*' AS tool, 'github:read' AS value FROM supplier WHERE s_suppkey % 4 <> 0
    UNION ALL SELECT p_partkey % 100, 'tool' || cast(p_partkey AS varchar(20)), CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'github:admin' END FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT s_suppkey, '/initialize', 'google:read' FROM supplier WHERE s_suppkey % 9 = 0"""
_WANTED = """SELECT p_partkey % 100 AS server_id, 'tool' || cast(p_partkey AS varchar(20)) AS tool FROM part UNION ALL SELECT s_suppkey, '/initialize' FROM supplier"""


def _entries(spark, sf_dir):
    tables = {t: load(spark, sf_dir, t) for t in ("supplier", "part")}
    sql = lambda s: spark.sql(s.replace("FROM supplier", "FROM {supplier}").replace("FROM part", "FROM {part}"), **tables)
    return sql(_WANTED), sql(_ENTRIES)


_RESOLVED = f"""WITH e AS ({_ENTRIES}), w AS ({_WANTED}), x AS (SELECT w.server_id, w.tool, CASE WHEN o.tool IS NOT NULL THEN o.value WHEN NOT starts_with(w.tool, '/') THEN s.value END AS value
    FROM w LEFT JOIN e o ON o.server_id = w.server_id AND o.tool = w.tool LEFT JOIN e s ON s.server_id = w.server_id AND s.tool = '*') """


@query("x6_wildcard_fallback", _RESOLVED + "SELECT * FROM x")
def x6(spark, sf_dir):
    wanted, entries = _entries(spark, sf_dir)
    return op.own_or_wildcard(wanted, entries, ["server_id"]).select("server_id", "tool", "value")


@query("x7_configured_not_advertised", f"WITH e AS ({_ENTRIES}) SELECT server_id, tool FROM e WHERE tool <> '*' AND NOT starts_with(tool, '/') AND (server_id, tool) NOT IN (SELECT p_partkey % 100, 'tool' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 <> 0)")
def x7(spark, sf_dir):
    _, entries = _entries(spark, sf_dir)
    offered = load(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select((F.col("p_partkey") % 100).alias("server_id"), F.concat(F.lit("tool"), F.col("p_partkey").cast("string")).alias("tool"))
    return op.unadvertised(entries, offered)


@query("q3_tool_credential_checks", _RESOLVED + """, h AS (SELECT *, (server_id * 7 + length(tool)) % 11 AS h, (server_id + length(tool) * 3) % 5 AS p FROM x), c AS (SELECT *, coalesce(value, '') = '' AS nothing FROM h)
    SELECT server_id, tool, CASE WHEN NOT nothing AND server_id % 13 = 5 THEN 'provider required twice' WHEN nothing AND (h <> 10 OR p <> 4) THEN 'authorization without requirement'
      WHEN h IN (1, 2) THEN 'bad header' WHEN h IN (3, 4, 5) THEN 'reserved header' WHEN h = 6 THEN 'header set twice' WHEN p = 1 THEN 'bad param' WHEN p = 2 THEN 'param set twice' END AS error FROM c""")
def q3(spark, sf_dir):
    """Requirements, headers and params are checked on what each tool effectively resolves to."""
    wanted, entries = _entries(spark, sf_dir)
    x = op.own_or_wildcard(wanted, entries, ["server_id"])
    n, m = F.pmod(F.col("server_id") * 7 + F.length("tool"), F.lit(11)), F.pmod(F.col("server_id") + F.length("tool") * 3, F.lit(5))
    names = lambda *a: F.array(*[F.lit(y) for y in a]) if a else F.expr("cast(array() as array<string>)")
    pick = lambda at, cases: F.coalesce(*[F.when(at == i, names(*c)) for i, c in enumerate(cases)])
    headers = pick(n, [("X-Key",), ("Bad Header",), ("-dash",), ("Host",), ("X-One", "te"), ("X-Plat-Own",), ("X-Key", "x-key"), ("A", "B"), ("Authorization",), ("Z9",), ()])
    params = pick(m, [("token",), ("9bad",), ("a", "b", "a"), ("a", "A"), ()])
    need = F.filter(F.array(F.col("value")), lambda v: F.coalesce(v, F.lit("")) != "")
    need = F.when(F.col("server_id") % 13 == 5, F.concat(need, need)).otherwise(need)
    providers = F.transform(need, lambda v: F.struct(F.split(v, ":")[0].alias("provider"), F.split(v, ":")[1].alias("level")))
    return x.select("server_id", "tool", op.credential_config_error(providers, headers, params).alias("error"))


@query("q4_provider_checks", """SELECT p_partkey, CASE WHEN NOT regexp_full_match(n, '[a-z0-9][a-z0-9_-]{0,63}') THEN 'provider name' WHEN NOT regexp_full_match(l, '[a-z0-9][a-z0-9_-]{0,31}') THEN 'level name' WHEN s = '' THEN 'no scopes' WHEN list_contains(string_split(s, ','), ' ') THEN 'empty scope' END AS error FROM
    (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', '-')) ELSE p_brand END AS n, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE lower(p_type) END AS l, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a, ' ELSE 'a,b' END AS s FROM part) x""")
def q4(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).otherwise(F.col("p_brand"))
    level = F.when(k % 3 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    scopes = F.filter(F.split(F.when(k % 5 == 0, "").when(k % 5 == 1, "a, ").otherwise("a,b"), ","), lambda s: s != "")
    return p.select("p_partkey", op.provider_error(name, level, scopes).alias("error"))


@query("q5_agent_checks", cte("agents") + "SELECT id, CASE WHEN model NOT IN ('small', 'medium', 'large') THEN 'unknown model' WHEN name = '' THEN 'no name' WHEN id % 6 IN (3, 4) THEN 'schema' END AS error, id % 6 NOT IN (0, 1) AS has_schema FROM agents")
def q5(spark, sf_dir):
    schema = F.col("output_schema")
    return load(spark, sf_dir, "agents").select("id", op.agent_error(F.col("model"), F.col("name"), schema, MODELS).alias("error"), (~schema.isin("", "{}")).alias("has_schema"))


@query("c9_account_normalization", cte("users") + "SELECT email, id FROM (SELECT lower(trim(email)) AS email, id, row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY id DESC) AS n FROM users) x WHERE n = 1")
def c9(spark, sf_dir):
    u = load(spark, sf_dir, "users").withColumn("email", F.lower(tx.trimmed(F.col("email"))))
    return latest(u, ["email"], [F.desc("id")]).select("email", "id")


@query("c10_credential_fields", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'repo user' WHEN 1 THEN 'repo' ELSE '' END AS scopes,
    CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate)::BIGINT WHEN 1 THEN epoch(o_orderdate)::BIGINT WHEN 2 THEN 1000 + 3600 END AS expires_epoch FROM orders""")
def c10(spark, sf_dir):
    """Scopes from a string or a list, expiry from RFC 3339, epoch seconds or seconds from now (here 1000)."""
    k, at = F.col("o_orderkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    scopes = F.when(k % 3 == 0, '"scope":"repo user",').when(k % 3 == 1, '"scope":["repo"],').otherwise("")
    expiry = F.when(k % 4 == 0, F.concat(F.lit('"expires_at":"'), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit('"'))).when(k % 4 == 1, F.concat(F.lit('"expires_at":'), at.cast("string"))).when(k % 4 == 2, '"expires_in":3600').otherwise('"none":0')
    raw = load(spark, sf_dir, "orders").select(k.alias("id"), F.parse_json(F.concat(F.lit("{"), scopes, expiry, F.lit("}"))).alias("v"))
    found, when = op.credential_fields(F.col("v"), F.lit(1000))
    return raw.select("id", found.alias("scopes"), when.alias("expires_epoch"))


_HORIZON = "1999-01-01"


@query("f6_expiry_work_list", cte("identities") + f"SELECT user_id, provider, expires_at FROM identities WHERE refreshable AND expires_at <= TIMESTAMP '{_HORIZON}' AND status IS DISTINCT FROM 'revoked'")
def f6(spark, sf_dir):
    return op.expiring(load(spark, sf_dir, "identities"), F.lit(_HORIZON).cast("timestamp_ntz")).select("user_id", "provider", "expires_at")


@query("t6_expiry_sweep", cte("identities") + f"""SELECT user_id, provider, CASE o WHEN 0 THEN 'active' WHEN 1 THEN 'refresh_failed' WHEN 2 THEN 'revoked' ELSE status END AS new_status,
    CAST(CASE o WHEN 0 THEN 0 WHEN 3 THEN refresh_failures ELSE refresh_failures + 1 END AS BIGINT) AS new_failures, o <> 3 AS still_refreshable
    FROM (SELECT *, (user_id + length(provider)) % 4 AS o FROM identities WHERE refreshable AND expires_at <= TIMESTAMP '{_HORIZON}' AND status IS DISTINCT FROM 'revoked') x""")
def t6(spark, sf_dir):
    work = op.expiring(load(spark, sf_dir, "identities"), F.lit(_HORIZON).cast("timestamp_ntz"))
    o = (F.col("user_id") + F.length("provider")) % 4
    outcomes = work.select("user_id", "provider", F.when(o == 0, "success").when(o == 1, "transient").when(o == 2, "permanent").otherwise("nothing").alias("outcome"))
    return op.refreshed(work.join(outcomes, ["user_id", "provider"])).select("user_id", "provider", "new_status", "new_failures", "still_refreshable")


@query("a5_entity_counts", cte("resources", "identities") + "SELECT 'resource' AS kind, resource AS name, count(*) AS n FROM resources GROUP BY resource UNION ALL SELECT 'identity', provider, count(*) FROM identities GROUP BY provider")
def a5(spark, sf_dir):
    return op.counted(load(spark, sf_dir, "resources"), "resource", "resource").unionAll(op.counted(load(spark, sf_dir, "identities"), "identity", "provider"))


@query("a8_revocation_tally", cte("identities") + "SELECT provider, count(*) FILTER (WHERE (user_id % 3) = 0) AS revoked, count(*) FILTER (WHERE (user_id % 3) = 1) AS unsupported, count(*) FILTER (WHERE (user_id % 3) = 2) AS failed, count(*) AS deleted FROM identities GROUP BY provider")
def a8(spark, sf_dir):
    o = F.col("user_id") % 3
    return op.revocation_tally(load(spark, sf_dir, "identities").withColumn("outcome", F.when(o == 0, "revoked").when(o == 1, "unsupported").otherwise("failed")))
