"""Queries on organizations, roles and what they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import entitlements as op
from loomlake.plans.tables import cte, load
from loomlake.registry import query

_ACCESS = ("memberships", "role_members", "role_rules", "resources", "asks")


def _access(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(load(spark, sf_dir, n) for n in _ACCESS)


def _decided(spark, sf_dir, actions):
    memberships, members, rules, resources, asks = _access(spark, sf_dir)
    return op.decide(asks, resources, memberships, members, rules, actions, "plat")


def _match(rule: str, permission: str) -> str:
    """DuckDB: rule matching, spelled out by segments."""
    seg = lambda i: f"(len(string_split({rule}, ':')) < {i} OR string_split({rule}, ':')[{i}] = '*' OR string_split({rule}, ':')[{i}] = string_split({permission}, ':')[{i}])"
    return f"({rule} <> '' AND {permission} <> '' AND len(string_split({rule}, ':')) <= len(string_split({permission}, ':')) AND {' AND '.join(seg(i) for i in range(1, 5))})"


def _decision(actions: list[str]) -> str:
    flags = ", ".join(f"coalesce(bool_or(m.organization_id = r.organization_id AND (m.owner OR {_match('u.rule', f"('plat:' || r.resource || ':{a}:' || CAST(r.id AS VARCHAR))")})), false) AS \"{a}\"" for a in actions)
    return (
        cte(*_ACCESS)
        + f""", u AS (SELECT DISTINCT m.user_id, rr.rule, rr.resource_id FROM memberships m JOIN role_members rm ON rm.user_id = m.user_id AND rm.organization_id = m.organization_id
        JOIN role_rules rr ON rr.organization_id = rm.organization_id AND rr.name = rm.name),
        decided AS (SELECT a.caller, a.id, r.resource, r.organization_id, {flags} FROM asks a JOIN resources r ON r.id = a.id LEFT JOIN memberships m ON m.user_id = a.caller
        LEFT JOIN u ON u.user_id = a.caller AND (u.resource_id IS NULL OR u.resource_id = a.id) GROUP BY a.caller, a.id, r.resource, r.organization_id) """
    )


@query("f1_tenant_filter", cte("resources") + "SELECT id, resource, organization_id FROM resources WHERE organization_id = 7")
def f1(spark, sf_dir):
    return op.of_organization(load(spark, sf_dir, "resources"), 7).select("id", "resource", "organization_id")


@query("f2_owner_parent_filter", cte("kb_documents") + "SELECT document_id, kb_id, user_id, filename FROM kb_documents WHERE user_id = 3 AND kb_id IN (3, 8)")
def f2(spark, sf_dir):
    wanted = spark.createDataFrame([(3,), (8,)], "kb_id long")
    return load(spark, sf_dir, "kb_documents").where("user_id = 3").join(F.broadcast(wanted), "kb_id", "left_semi").select("document_id", "kb_id", "user_id", "filename")


@query("f3_private_rows", cte("resources") + "SELECT id, user_id FROM resources WHERE organization_id = 4 AND user_id % 2 = 0")
def f3(spark, sf_dir):
    return op.of_organization(load(spark, sf_dir, "resources"), 4).where("user_id % 2 = 0").select("id", "user_id")


@query("f4_heavy_columns_left_out", cte("kb_documents") + "SELECT document_id, kb_id, filename, uploaded_at FROM kb_documents")
def f4(spark, sf_dir):
    return op.light(load(spark, sf_dir, "kb_documents").select("document_id", "kb_id", "filename", "uploaded_at", "text"))


@query("f5_optional_filters", cte("executions") + "SELECT id, workflow_id, status FROM executions WHERE status = 'queued'")
def f5(spark, sf_dir):
    return op.with_filters(load(spark, sf_dir, "executions"), status="queued", workflow_id=None, user_id="").select("id", "workflow_id", "status")


@query("f7_hidden_roles_left_out", cte("role_rules") + "SELECT organization_id, name, rule FROM role_rules WHERE NOT hidden")
def f7(spark, sf_dir):
    return op.visible_roles(load(spark, sf_dir, "role_rules")).select("organization_id", "name", "rule")


@query("j3_decoration", cte("users") + "SELECT o_orderkey, o_custkey, u.display_name, u.email_verified FROM orders LEFT JOIN users u ON u.id = o_custkey + 5")
def j3(spark, sf_dir):
    users = load(spark, sf_dir, "users").withColumn("id", F.col("id") - 5)
    return op.decorated(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey", "id", ["display_name", "email_verified"])


@query("j4_roles_of_user", cte("memberships", "role_members") + "SELECT m.user_id, m.organization_id, rm.name FROM memberships m JOIN role_members rm ON rm.user_id = m.user_id AND rm.organization_id = m.organization_id")
def j4(spark, sf_dir):
    return op.roles_of_users(load(spark, sf_dir, "role_members"), load(spark, sf_dir, "memberships"))


@query(
    "j5_rule_matches",
    cte("role_rules", "resources")
    + f"SELECT rr.organization_id, rr.name, r.id FROM (SELECT * FROM role_rules WHERE NOT hidden) rr JOIN resources r ON r.organization_id = rr.organization_id AND {_match('rr.rule', '''('plat:' || r.resource || ':view:' || CAST(r.id AS VARCHAR))''')}",
)
def j5(spark, sf_dir):
    from loomlake.functions.rules import matches

    # Rules of a type meet resources of it; rules for any type (few) meet all of the organization.
    rules = op.visible_roles(load(spark, sf_dir, "role_rules")).select("organization_id", "name", "rule")
    rules = rules.withColumn("_type", F.coalesce(F.get(F.split("rule", ":"), F.lit(1)), F.lit("*")))
    resources = load(spark, sf_dir, "resources").select("organization_id", "resource", "id")
    permission = F.concat(F.lit("plat:"), F.col("resource"), F.lit(":view:"), F.col("id").cast("string"))
    typed = resources.join(rules.where("_type <> '*'"), (resources.organization_id == rules.organization_id) & (resources.resource == F.col("_type"))).drop(rules.organization_id)
    free = resources.join(rules.where("_type = '*'"), "organization_id")
    columns = ["organization_id", "name", "id"]
    return typed.where(matches(F.col("rule"), permission)).select(columns).unionAll(free.where(matches(F.col("rule"), permission)).select(columns))


@query("j6_visible_resources", _decision(["view"]) + "SELECT caller, id FROM decided WHERE \"view\"")
def j6(spark, sf_dir):
    return _decided(spark, sf_dir, ["view"]).where("view").select("caller", "id").distinct()


@query("a2_effective_rules", cte("memberships", "role_members", "role_rules") + """SELECT m.user_id, m.organization_id, m.owner,
    coalesce(string_agg(DISTINCT rr.rule, ',' ORDER BY rr.rule), '') AS rules, coalesce(string_agg(DISTINCT CASE WHEN NOT rr.hidden THEN rr.name END, ',' ORDER BY CASE WHEN NOT rr.hidden THEN rr.name END), '') AS roles
    FROM memberships m LEFT JOIN role_members rm ON rm.user_id = m.user_id AND rm.organization_id = m.organization_id LEFT JOIN role_rules rr ON rr.organization_id = rm.organization_id AND rr.name = rm.name GROUP BY ALL""")
def a2(spark, sf_dir):
    memberships, members, rules, *_ = _access(spark, sf_dir)
    out = op.effective(memberships, members, rules)
    return out.select("user_id", "organization_id", "owner", F.array_join("rules", ",").alias("rules"), F.array_join("roles", ",").alias("roles"))


@query("a3_any_rule_allows", _decision(["edit"]) + "SELECT caller, id, \"edit\" AS allowed FROM decided")
def a3(spark, sf_dir):
    return _decided(spark, sf_dir, ["edit"]).select("caller", "id", F.col("edit").alias("allowed")).distinct()


@query("a4_action_flags", _decision(["edit", "delete", "use"]) + "SELECT caller, id, \"edit\" AS editable, \"delete\" AS deletable, \"use\" AS usable FROM decided")
def a4(spark, sf_dir):
    return _decided(spark, sf_dir, ["edit", "delete", "use"]).select("caller", "id", F.col("edit").alias("editable"), F.col("delete").alias("deletable"), F.col("use").alias("usable")).distinct()


@query("a14_access_audit", _decision(["view"]) + "SELECT organization_id, resource, count(*) AS candidates, CAST(sum(CASE WHEN \"view\" THEN 1 ELSE 0 END) AS BIGINT) AS visible FROM decided GROUP BY organization_id, resource")
def a14(spark, sf_dir):
    rows = _decided(spark, sf_dir, ["view"]).distinct()
    return rows.groupBy("organization_id", "resource").agg(F.count("*").alias("candidates"), F.count_if("view").alias("visible"))


@query("w1_newest_per_parent", cte("executions") + "SELECT workflow_id, id, CAST(n AS INTEGER) AS n FROM (SELECT workflow_id, id, row_number() OVER (PARTITION BY workflow_id ORDER BY queued_at DESC, id) AS n FROM executions) x WHERE n <= 50")
def w1(spark, sf_dir):
    return op.newest(load(spark, sf_dir, "executions"), ["workflow_id"], [F.desc("queued_at"), "id"], 50).select("workflow_id", "id", "n")


@query("w2_page_and_total", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def w2(spark, sf_dir):
    return op.page(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 3, 0)


@query("x1_ordered_union", """SELECT c_custkey, list_aggregate(list_filter([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'any' END, 'any', c_mktsegment, lower(c_mktsegment)], lambda x, i: x <> '' AND
    list_position([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'any' END, 'any', c_mktsegment, lower(c_mktsegment)], x) = i), 'string_agg', ',') AS tags FROM customer""")
def x1(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    first = F.array(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("any"))
    second = F.array(F.lit("any"), F.col("c_mktsegment"), F.lower("c_mktsegment"))
    return c.select("c_custkey", F.array_join(op.ordered_union(first, second), ",").alias("tags"))


@query("x8_rules_dropped_by_prefix", cte("role_rules") + """SELECT organization_id, count(*) AS roles, CAST(sum(b) AS BIGINT) AS rules_before, CAST(sum(a) AS BIGINT) AS rules_after FROM
    (SELECT organization_id, name, count(*) AS b, count(*) FILTER (WHERE NOT starts_with(rule, 'plat:kb:')) AS a FROM role_rules GROUP BY organization_id, name) x GROUP BY organization_id""")
def x8(spark, sf_dir):
    stored = load(spark, sf_dir, "role_rules").groupBy("organization_id", "name").agg(F.collect_list("rule").alias("rules"))
    kept = stored.withColumn("kept", op.drop_prefixed(F.col("rules"), "plat:kb:"))
    return kept.groupBy("organization_id").agg(F.count("*").alias("roles"), F.sum(F.size("rules")).alias("rules_before"), F.sum(F.size("kept")).alias("rules_after"))


@query("a15_ownership_inventory", cte("resources", "agents") + """SELECT owner_id, count(*) AS n, string_agg(rule, ',' ORDER BY rule) AS rules FROM
    (SELECT user_id AS owner_id, 'plat:' || resource || ':*:' || CAST(id AS VARCHAR) AS rule FROM resources UNION ALL SELECT id % 10, 'plat:agent:*:a' || CAST(id AS VARCHAR) FROM agents) x GROUP BY owner_id""")
def a15(spark, sf_dir):
    resources, agents = load(spark, sf_dir, "resources"), load(spark, sf_dir, "agents")
    owned = resources.select("user_id", "resource", F.col("id").cast("string").alias("id")).unionByName(agents.select((F.col("id") % 10).alias("user_id"), F.lit("agent").alias("resource"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("id")))
    return op.ownership(owned, "plat").withColumn("rules", F.array_join("rules", ","))
