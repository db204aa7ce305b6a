"""Operators on small tables, with nulls, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake import storage
from loomlake.operators import catalog, chats, entitlements, maintenance, retrieval, workflows

ROLES = "organization_id int, name string, rules array<string>, members array<long>"


def df(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def rows(table):
    return sorted(map(tuple, table.collect()), key=repr)


def test_upload_gate(spark):
    files = df(spark, [(1, "ab"), (1, "é"), (2, "x"), (2, ""), (3, "123456"), (4, None)], "b int, text string")
    batches = df(spark, [(1,), (2,), (3,), (4,), (5,), (1,)], "b int")
    gate = maintenance.upload_gate(batches, files, "b", "text", most_bytes=5)
    assert rows(gate) == [(1, 2, 4, "ok"), (2, 2, 1, "empty file"), (3, 1, 6, "too large"), (4, 1, 0, "empty file"), (5, 0, 0, "no files")]
    assert rows(maintenance.accepted(files, gate, "b")) == [(1, "ab"), (1, "é")]
    assert not maintenance.upload_gate(batches.limit(0), files, "b", "text").collect()


def test_changed_elements_against_a_fold(spark):
    r = random.Random(3)
    elements = [(k, e, None) for k in range(6) for e in ("a", "b") if r.random() < 0.5]
    changes = [(r.randrange(6), r.choice("abc"), at, r.choice(["add", "remove", "touch", "touch"])) for at in range(1, 120)]
    state, stamp = {(k, e): t for k, e, t in elements}, {}
    for k, e, at, op in changes:
        stamp[k] = at
        if op == "add":
            state.setdefault((k, e), None)
        elif op == "remove":
            state.pop((k, e), None)
        elif (k, e) in state:
            state[k, e] = at
    after, stamps = maintenance.change_elements(df(spark, elements, "record int, element string, touched_at long"), df(spark, changes, "record int, element string, at long, op string"))
    assert {(x.record, x.element): x.touched_at for x in after.collect()} == state
    assert {x.record: x.updated_at for x in stamps.collect()} == stamp


def test_orphan_rules(spark):
    rules = df(spark, [(r,) for r in ("plat:kb:view:1", "plat:kb:*:2", "plat:kb:view:*", "plat:*:view:9", "plat:kb", "*", "plat:agent:use:1", None)], "rule string")
    assert rows(maintenance.orphan_rules(rules, df(spark, [("kb", 1)], "resource string, id long"))) == [("plat:agent:use:1",), ("plat:kb:*:2",)]


def test_grants_of_visible_roles_are_refused(spark):
    changes = df(spark, [(1, "own 5", "r1"), (1, "seg a", "r2"), (1, "new", "r3"), (2, "seg a", "r4")], "organization_id int, role string, rule string")
    good, refused = maintenance.split_grants(changes, df(spark, [(1, "own 5", True), (1, "seg a", False), (1, "seg a", False)], "organization_id int, name string, hidden boolean"))
    assert [r.rule for r in good.orderBy("rule").collect()] == ["r1", "r3", "r4"] and [r.rule for r in refused.collect()] == ["r2"]


def test_membership_changes(spark):
    asked = df(spark, [(1, 7, 50), (2, 7, 50), (3, 7, 50)], "user_id long, wanted int, asked_at long")
    current = df(spark, [(2, 7, 20), (3, 8, 30)], "user_id long, organization_id int, created_at long")
    assert rows(maintenance.change_memberships(asked, current)) == [(1, "accept", 7, 50), (2, "no-op", 7, 20), (3, "conflict", 8, 30)]


def test_founded_organizations(spark):
    before = df(spark, [(1, "pending", "A", 10), (2, "pending", "B", 11), (3, "approved", "C", 12)], "id int, status string, name string, requested_by long")
    after = maintenance.decide_first(before, df(spark, [(1, 1, "approved"), (1, 2, "rejected"), (2, 1, "rejected"), (3, 1, "approved")], "id int, at int, decision string"))
    assert rows(maintenance.founded(before, after)) == [("org-1", "A", 10, True)]


def test_last_good_rows_stay(spark):
    old, new = df(spark, [(1, 1), (2, 2), (3, 3)], "s int, t int"), df(spark, [(1, 9), (3, 8)], "s int, t int")
    assert rows(maintenance.keep_last_good(old, new, df(spark, [(1,), (2,)], "s int"), "s")) == [(1, 9), (3, 3)]


def test_role_errors(spark):
    roles = df(spark, [(1, "good name", ["plat:kb"], [5]), (1, "_bad", ["kb:*"], [5, 6]), (2, "5", ["*"], []), (2, None, None, None)], ROLES)
    got = rows(maintenance.role_errors(roles, df(spark, [(5, 1), (6, 2)], "user_id long, organization_id int"), "plat"))
    assert got == sorted([(1, "_bad", "name", "_bad"), (2, None, "name", None), (2, "5", "name is a user id", "5"), (1, "_bad", "rule", "namespace kb:*"), (1, "_bad", "member of another organization", "6")], key=repr)


def test_credential_configs(spark):
    one = [("github", "read")]
    cases = [
        (one, ["X-Key"], [], None), (one, [], ["a", "A"], None), ([], [], [], None), (None, None, None, None), (one * 2, [], [], "provider required twice"), ([], ["X-Key"], [], "authorization without requirement"),
        (None, [], ["p"], "authorization without requirement"), (one, ["-x"], [], "bad header"), (one, ["a b"], [], "bad header"), (one, ["x" * 65], [], "bad header"), (one, ["HOST"], [], "reserved header"),
        (one, ["X-Plat-User"], [], "reserved header"), (one, ["X-Key", "x-KEY"], [], "header set twice"), (one, ["A"], ["9"], "bad param"), (one, [], ["p", "q", "p"], "param set twice"),
    ]
    table = df(spark, [(i, *c) for i, c in enumerate(cases)], "i int, providers array<struct<provider:string,level:string>>, headers array<string>, params array<string>, want string")
    for r in table.withColumn("got", catalog.credential_config_error(F.col("providers"), F.col("headers"), F.col("params"))).collect():
        assert r.got == r.want, r


def test_provider_and_agent_errors(spark):
    p = df(spark, [("ok", "read", ["a"], None), ("Bad", "read", ["a"], "provider name"), ("ok", "x" * 33, ["a"], "level name"), ("ok", "read", [], "no scopes"), ("ok", "read", None, "no scopes"), ("ok", "read", ["a", " "], "empty scope"), (None, "read", ["a"], "provider name")], "n string, l string, s array<string>, want string")
    assert all(r.got == r.want for r in p.withColumn("got", catalog.provider_error(F.col("n"), F.col("l"), F.col("s"))).collect())
    a = df(spark, [("small", "n", '{"a":1}', None), ("small", "n", "", None), ("small", "n", None, None), ("none", "n", "", "unknown model"), ("small", " ", "", "no name"), ("small", "n", "[1]", "schema"), ("small", "n", "{", "schema"), ("small", "n", '{"a":"' + "x" * 66_000 + '"}', "schema"), (None, None, None, "unknown model")], "m string, n string, s string, want string")
    assert all(r.got == r.want for r in a.withColumn("got", catalog.agent_error(F.col("m"), F.col("n"), F.col("s"), ("small",))).collect())


def test_request_verdicts(spark):
    base = dict(role="user", content="hi", agent="a", model="", files=0)
    cases = [({}, "ok"), ({"agent": None, "model": "m"}, "ok"), ({"content": " \n"}, "blank content"), ({"content": None}, "blank content"), ({"role": "system"}, "role"), ({"role": None}, "role"), ({"content": "x" * 262_145}, "too large"), ({"agent": ""}, "no agent or model"), ({"model": "m"}, "agent and model"), ({"files": 6}, "too many files"), ({"files": None}, "ok")]
    table = df(spark, [(*(base | c).values(), want) for c, want in cases], "role string, content string, agent string, model string, files int, want string")
    assert all(r.got == r.want for r in table.withColumn("got", chats.request_verdict(table)).collect())


def test_refused_attachments(spark):
    files = [(1, 0, "a.pdf", "eA=="), (2, 0, "a.exe", "eA=="), (2, 1, "b.pdf", "%"), (3, 0, "a.md", "%%"), (4, 0, "a.md", ""), (5, 0, "a.md", "eA=="), (6, 0, "a.md", "eHh4")] + [(7, i, "a.md", "eA==") for i in range(6)]
    messages = df(spark, [(k, "user") for k in (1, 2, 3, 4, 6, 7)] + [(5, "assistant")], "conv_id int, role string")
    got = {r.conv_id: r.reason for r in chats.refused_attachments(df(spark, files, "conv_id int, position int, filename string, data string"), messages, most_bytes=2).collect()}
    assert got == {1: None, 2: "2 unsupported type", 3: "3 not base64", 4: "4 empty", 5: "1 no user message", 6: "5 too large", 7: "0 too many files"}


def test_step_contexts_and_errors(spark):
    runs = df(spark, [(1, 1, "a", "succeeded", "x", None), (1, 2, "b", "succeeded", "y", None), (1, 3, "a", "succeeded", "z", None), (1, 4, "c", "failed", None, "boom"), (1, 5, "d", "succeeded", "never", None)], "execution_id int, position int, name string, status string, output string, error string")
    seen = {r.position: (r.previous, r.earlier) for r in workflows.contexts(workflows.propagate_skips(runs)).collect()}
    assert seen == {1: (None, {}), 2: ("x", {"a": "x"}), 3: ("y", {"a": "x", "b": "y"}), 4: ("z", {"a": "z", "b": "y"}), 5: ("z", {"a": "z", "b": "y"})}
    done = workflows.roll_up(workflows.propagate_skips(runs)).first()
    assert (done.status, done.output, done.error, done.steps) == ("failed", None, 'step "c" failed: boom', 5)


def test_collections_and_sizes(spark):
    docs = df(spark, [(1, 10, "a", "x" * 2000), (1, 11, "b", "  "), (2, 12, "c", "é"), (2, 13, "d", None)], "kb int, document_id int, filename string, text string")
    assert rows(retrieval.documents_of_collection(docs, "kb")) == [(1, 10, 3, "a"), (2, 12, 1, "c")]
    sizes = retrieval.context_sizes(df(spark, [(7, 1), (7, 2), (8, 9)], "agent int, kb int"), docs, "agent", "kb")
    assert rows(sizes) == sorted([(7, 1, 2, 2002, 2002), (7, 2, 2, 1, 2), (7, None, 4, 2003, 2004)], key=repr)


def test_one_space_for_all_tables(spark):
    texts = df(spark, [("the cat",), ("the dog",), ("a bird",), (None,), ("",)], "text string")
    embedder = retrieval.fit_embedder(texts, dim=32)
    of = lambda t: {r.text: tuple(r.embedding) for r in embedder(t).collect()}
    whole, part = of(texts), of(texts.where("text = 'the dog'"))
    assert part["the dog"] == whole["the dog"] and not any(whole[""]) and abs(sum(x * x for x in part["the dog"]) - 1) < 1e-9


def test_partitions_grow_with_the_asks(spark, monkeypatch):
    memberships = df(spark, [(u, u % 3, u % 7 == 0) for u in range(40)], "user_id long, organization_id long, owner boolean")
    members = df(spark, [(u % 3, f"r{u}", u) for u in range(40)] + [(o, "all", u) for o in range(3) for u in range(40)], "organization_id long, name string, user_id long")
    rules = df(spark, [(u % 3, f"r{u}", False, i, f"p:kb:*:{i}") for i in range(300) for u in [i % 40]] + [(0, "all", False, None, "p:kb:view")], "organization_id long, name string, hidden boolean, resource_id long, rule string")
    resources = df(spark, [("kb", i, i % 40 % 3) for i in range(300)], "resource string, id long, organization_id long")
    asks = df(spark, [((i + d) % 41, i) for i in range(300) for d in (0, 1, 3)], "caller long, id long")
    decided = lambda: entitlements.decide(asks, resources, memberships, members, rules, ["view", "edit"], "p")
    want = sorted(decided().collect())
    assert {r["view"] for r in want} == {r["edit"] for r in want} == {True, False}
    monkeypatch.setattr(entitlements, "ASKS", 30)
    assert sorted((got := decided()).collect()) == want
    assert got.rdd.getNumPartitions() == 30 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_details_and_ownership(spark):
    got = entitlements.decorated(df(spark, [(1,), (2,), (None,)], "k int"), df(spark, [(1, "a"), (1, "a")], "id int, n string"), "k", "id", ["n"])
    assert rows(got) == sorted([(1, "a"), (2, None), (None, None)], key=repr)
    owned = df(spark, [(1, "kb", 5), (1, "agent", 2), (2, "kb", 6)], "user_id int, resource string, id long")
    assert rows(entitlements.ownership(owned, "plat")) == [(1, 2, ["plat:agent:*:2", "plat:kb:*:5"]), (2, 1, ["plat:kb:*:6"])]
    assert entitlements.light(df(spark, [(1, "t")], "id int, text string")).columns == ["id"]


class _Cluster:
    """What ``shared_folder`` asks of a session."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_no_local_folder_on_a_cluster(spark):
    with pytest.raises(ValueError):
        storage.shared_folder(_Cluster)
    assert storage.new_folder(spark, "x").startswith(storage.shared_folder(spark) + "/x-")
