"""Upserts, deletes, backfills and audits as operations on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.rules import rule_error
from loomlake.sinks import KeyedTable


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The target with the latest change of each key in place of, or beside, its rows; running it again changes nothing."""
    new = latest(changes, key, [F.desc(version)]).drop(version)
    return target.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return target.join(gone.select(*key).distinct(), key, "left_anti")


def apply_operations(target: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """The target after uploads and deletes; of each key the last operation of the log wins."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in (key, order)]), order).alias("_o")).select(key, "_o.*")
    return target.join(last.select(key), key, "left_anti").unionByName(last.where("op = 'put'").select(target.columns))


def replace_sets(target: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Whole groups of the target swapped for those of ``fresh``; groups that it lacks stay."""
    return target.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def backfill(records: DataFrame, memberships: DataFrame, user: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Stamps the owner's organization on records without one, and counts what happened."""
    m = memberships.select(F.col("user_id").alias(user), F.col("organization_id").alias("_org"))
    joined = records.join(m, user, "left").withColumn("_what", F.when(F.col(column).isNotNull(), "kept").when(F.col("_org").isNull(), "skipped").otherwise("stamped"))
    return joined.withColumn(column, F.coalesce(column, "_org")).drop("_org", "_what"), joined.groupBy(F.col("_what").alias("what")).agg(F.count("*").alias("n"))


def apply_rows(table: KeyedTable, batch: int, rows: DataFrame, columns: list[str], source: str = "maintenance") -> bool:
    """Writes what a job has made of a table's rows: only rows that differ in ``columns`` from what is there are written, by their key.

    Making rows and writing them are two calls, so a dry run is the first one alone.  False if the batch had been applied before.
    """
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    now = table.rows().select(*table.key, *[F.col(c).alias(f"_{c}") for c in columns])
    changed = rows.join(now, table.key).where(~same).select(*table.schema.names)
    return table.upsert(batch, changed, lambda old, new: old.join(new.select(*table.key), table.key, "left_anti").unionByName(new), source)


def rekey(records: DataFrame, column: str, organization: str) -> DataFrame:
    """Ids scoped to their organization; scoped ones and those without an organization stay."""
    k, o = F.col(column), F.col(organization).cast("string")
    prefix = F.concat(o, F.lit(":"))
    return records.withColumn(column, F.when(o.isNull() | k.startswith(prefix), k).otherwise(F.concat(prefix, k)))


def cascade(gone: DataFrame, children: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows that fall with a set of parents, level by level: (table, key) of each; ``children``: name, rows, parent key, own key."""
    out, parents = None, gone.select(F.col(gone.columns[0]).alias("_p"))
    for name, rows, parent, own in children:
        hit = rows.join(parents, rows[parent] == parents["_p"], "left_semi")
        level = hit.groupBy().agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        out = level if out is None else out.unionAll(level)
        parents = hit.select(F.col(own).alias("_p")).distinct()
    return out


def upload_gate(batches: DataFrame, files: DataFrame, batch: str, content: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Every batch with its files, their bytes and a verdict: ok / no files / empty file / too large.

    One bad file refuses its whole batch; a null content is empty.  ``batches`` may name batches without files.
    """
    return sized_gate(batches, files, batch, F.octet_length(content), most_bytes)


def sized_gate(batches: DataFrame, files: DataFrame, batch: str, size: Column, most_bytes: int = 50 << 20) -> DataFrame:
    """``upload_gate`` of files by their sizes in bytes, where these are known already."""
    size = F.coalesce(size, F.lit(0))
    held = files.groupBy(batch).agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.bool_or(size == 0).alias("_empty"))
    n = F.coalesce("files", F.lit(0).cast("long"))
    verdict = F.when(n == 0, "no files").when(F.col("_empty"), "empty file").when(F.col("total") > most_bytes, "too large").otherwise("ok")
    return batches.select(batch).distinct().join(held, batch, "left").select(batch, n.alias("files"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), verdict.alias("verdict"))


def accepted(files: DataFrame, gate: DataFrame, batch: str) -> DataFrame:
    """The files of the batches that ``upload_gate`` lets through."""
    return files.join(gate.where("verdict = 'ok'").select(batch), batch, "left_semi")


def change_elements(elements: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of records after a log of changes, and each changed record's ``updated_at``.

    ``elements``: record, element, touched_at.  ``changes``: record, element, at, op; ``add`` appends an element if
    it is absent, ``remove`` takes it out, ``touch`` stamps ``touched_at`` of one that is there and otherwise does nothing.
    All changes of a record are folded at once, so none is lost.  The stamp is the record's last change.
    Changes of one element at one moment have to be apart in ``at``.
    """
    key = ["record", "element"]
    gone = changes.groupBy(*key).agg(F.max(F.when(F.col("op") == "remove", F.col("at"))).alias("_gone"))
    later = changes.join(gone, key).where(F.col("_gone").isNull() | (F.col("at") > F.col("_gone")))
    folded = later.groupBy(*key).agg(F.min(F.when(F.col("op") == "add", F.col("at"))).alias("_added"), F.max(F.when(F.col("op") == "touch", F.col("at"))).alias("_touched"))
    here = elements.withColumn("_here", F.lit(True)).join(gone, key, "full_outer").join(folded, key, "left")
    stays = F.col("_here").isNotNull() & F.col("_gone").isNull()
    touched = F.when(stays, F.greatest("touched_at", "_touched")).when(F.col("_touched") > F.col("_added"), F.col("_touched"))
    after = here.where(stays | F.col("_added").isNotNull()).select(*key, touched.alias("touched_at"))
    return after, changes.groupBy("record").agg(F.max("at").alias("updated_at"))


def orphan_rules(rules: DataFrame, resources: DataFrame, rule: str = "rule") -> DataFrame:
    """Rules that name one resource (type and id, no wildcard) that isn't there; ``resources``: resource, id."""
    parts = F.split(rule, ":")
    named = rules.withColumns({"_type": F.get(parts, F.lit(1)), "_id": F.get(parts, F.lit(3))}).where("_type <> '*' and _id <> '*'")
    there = resources.select(F.col("resource").alias("_type"), F.col("id").cast("string").alias("_id")).distinct()
    return named.join(there, ["_type", "_id"], "left_anti").drop("_type", "_id")


def split_grants(changes: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grant changes that may be applied, and refused ones: only a hidden role, or one that isn't there yet, takes them.

    ``changes``: organization_id, role, ...; ``roles``: organization_id, name, hidden.
    """
    visible = roles.where("not hidden").select("organization_id", F.col("name").alias("role")).distinct()
    return changes.join(visible, ["organization_id", "role"], "left_anti"), changes.join(visible, ["organization_id", "role"], "left_semi")


def change_memberships(asked: DataFrame, current: DataFrame) -> DataFrame:
    """Each asked membership with a verdict and what holds after it: user_id, verdict, organization_id, created_at.

    Nobody moves between organizations: a user without one is accepted, as of now; asking for one's own
    changes nothing and keeps ``created_at``; asking for another is a conflict, and the old one stays.
    ``asked``: user_id, wanted, asked_at.  ``current``: user_id, organization_id, created_at.
    """
    both = asked.join(current, "user_id", "left")
    new = F.col("organization_id").isNull()
    verdict = F.when(new, "accept").when(F.col("organization_id") == F.col("wanted"), "no-op").otherwise("conflict")
    return both.select("user_id", verdict.alias("verdict"), F.coalesce("organization_id", "wanted").alias("organization_id"), F.when(new, F.col("asked_at")).otherwise(F.col("created_at")).alias("created_at"))


def founded(before: DataFrame, after: DataFrame) -> DataFrame:
    """Organizations that approvals bring about, each with its first member, who owns it: organization_id, name, user_id, owner.

    ``before``: id, status, name, requested_by; ``after``: id, status.  Only requests that were pending count.
    """
    newly = before.where("status = 'pending'").select("id", "name", "requested_by").join(after.where("status = 'approved'").select("id"), "id", "left_semi")
    return newly.select(F.concat(F.lit("org-"), F.col("id").cast("string")).alias("organization_id"), "name", F.col("requested_by").alias("user_id"), F.lit(True).alias("owner"))


def left_owners(memberships: DataFrame, removed: DataFrame) -> DataFrame:
    """Owners of each organization, how many a batch of removals leaves, and whether it is refused because none is left."""
    gone = removed.select("user_id").distinct().withColumn("_gone", F.lit(True))
    left = F.col("owner") & F.col("_gone").isNull()
    return memberships.join(gone, "user_id", "left").groupBy("organization_id").agg(F.count_if("owner").alias("owners"), F.count_if(left).alias("left_over"), (F.count_if(left) == 0).alias("refused"))


def keep_last_good(old: DataFrame, new: DataFrame, probed: DataFrame, key: str) -> DataFrame:
    """Rows after a refresh: groups that were probed are as found now, even if empty; others keep their old rows."""
    return new.join(probed.select(key).distinct(), key, "left_semi").unionByName(old.join(probed.select(key).distinct(), key, "left_anti"))


def role_errors(roles: DataFrame, memberships: DataFrame, namespace: str) -> DataFrame:
    """What is wrong with roles: organization_id, name, what, detail.

    ``roles``: organization_id, name, rules (array), members (array of user ids).  Checked are the name's
    characters, that it is no user's id, each rule, and that each member belongs to the organization.
    """
    key = ["organization_id", "name"]
    say = lambda df, what, detail: df.select(*key, F.lit(what).alias("what"), detail.cast("string").alias("detail"))
    users = memberships.select(F.col("user_id").cast("string").alias("name")).distinct()
    rules = roles.select(*key, F.explode("rules").alias("rule")).withColumn("wrong", rule_error(F.col("rule"), namespace)).where("wrong is not null")
    members = roles.select(*key, F.explode("members").alias("user_id")).distinct()
    outside = members.join(memberships.select("user_id", "organization_id"), ["user_id", "organization_id"], "left_anti")
    bad = ~F.coalesce("name", F.lit("")).rlike("^[a-zA-Z0-9][a-zA-Z0-9 _-]{0,63}$")
    return (
        say(roles.where(bad), "name", F.col("name"))
        .unionAll(say(roles.join(users, "name", "left_semi"), "name is a user id", F.col("name")))
        .unionAll(say(rules, "rule", F.concat_ws(" ", "wrong", "rule")))
        .unionAll(say(outside, "member of another organization", F.col("user_id")))
    )


def fold_grants(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Each user's rules after a log of grants and revokes, in order: user_id, rules.

    ``changes``: user_id, at, grant (boolean), rule.  Revoking what isn't there does nothing and makes no role.
    """
    last = changes.groupBy("user_id", "rule").agg(F.max_by("grant", "at").alias("grant"))
    add = last.where("grant").groupBy("user_id").agg(F.array_sort(F.collect_list("rule")).alias("_add"))
    take = last.where("not grant").groupBy("user_id").agg(F.collect_list("rule").alias("_take"))
    empty = F.expr("cast(array() as array<string>)")
    joined = current.join(add, "user_id", "full_outer").join(take, "user_id", "left")
    rules = F.array_union(F.array_except(F.coalesce("rules", empty), F.coalesce("_take", empty)), F.coalesce("_add", empty))
    return joined.select("user_id", F.array_sort(rules).alias("rules"))


def decide_first(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests after decisions: only pending ones may be decided, by the first decision of each."""
    first = latest(decisions, ["id"], ["at", "decision"]).select("id", F.col("decision").alias("_d"))
    out = requests.join(first, "id", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("_d").isNotNull(), F.col("_d")).otherwise(F.col("status"))).drop("_d")


def route(kind: Column) -> Column:
    """Where a message goes; an empty or missing type is a knowledge-base upload."""
    k = F.coalesce(F.nullif(kind, F.lit("")), F.lit("kb_context"))
    return F.when(k.isin("kb_context", "agent_rag", "delete_kb_document", "delete_agent_document"), k).otherwise("skip")
