"""Table-driven cases of single operators."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import rules, text as tx
from loomlake.operators import catalog, chats, entitlements, logs, maintenance, retrieval, vector_index, workflows
from loomlake.sources import messages


def values(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


MATCHES = [
    ("plat:kb:edit:123", "plat:kb:edit:123", True), ("plat:kb:edit:123", "plat:kb:edit:456", False), ("plat:kb:edit:123", "plat:kb:view:123", False),
    ("plat:kb:edit:123", "plat:agent:edit:123", False), ("plat:kb:view:*", "plat:kb:view:anything", True), ("plat:kb:*:123", "plat:kb:delete:123", True),
    ("plat:*:view:123", "plat:agent:view:123", True), ("plat:kb:view:*", "plat:kb:edit:123", False), ("plat:kb", "plat:kb:edit:123", True),
    ("plat:kb:*", "plat:kb:edit:123", True), ("plat", "plat:kb:edit:123", True), ("plat:kb", "plat:agent:edit:123", False),
    ("plat:kb:edit:123", "plat:kb:edit", False), ("plat:kb:edit:123:extra", "plat:kb:edit:123", False), ("", "plat:kb:edit:123", False),
    ("plat:kb:edit:123", "", False), ("*", "plat:kb:edit:123", True), (None, "plat:kb", False), ("plat", None, False),
]


def test_rule_matching(spark):
    df = values(spark, MATCHES, "rule string, permission string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", rules.matches(F.col("rule"), F.col("permission"))).collect())


def chunked(text, size, overlap):
    """Chunking, spelled out."""
    size, overlap = tx.chunk_settings(size, overlap)
    t, out, start = text.strip(), [], 0
    while start < len(t):
        piece = t[start : start + size].strip()
        out += [piece] if piece else []
        if start + size >= len(t):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(1000, 150), (50, 10), (7, 6), (100, 0), (0, 0), (10, 10), (200, -1), (100, 500)])
def test_chunks(spark, size, overlap):
    texts = ["", "   ", "a", "x" * size, "x" * (size + 1), "ab" * 700, "a" + " " * 120 + "b", "é🙂" * 90, "\t lead and trail \n", "w " * 400]
    df = values(spark, list(enumerate(texts)), "i int, t string").withColumn("c", tx.chunks(F.col("t"), size, overlap))
    for r in df.collect():
        assert r.c == chunked(r.t, size, overlap), (r.t[:20], size, overlap)


def test_chunk_settings():
    assert tx.chunk_settings(0, 0) == (1000, 0) and tx.chunk_settings(100, 100) == (100, 25) and tx.chunk_settings(200, -1) == (200, 150)


def test_replies(spark):
    cases = [
        ('  {"a":0.9}  ', "json", '{"a":0.9}'), (" Oslo is the capital.", "text", '"Oslo is the capital."'), ("42", "text", '"42"'), ('{"a":1} x', "text", '"{\\"a\\":1} x"'), ("[1,2]", "json", "[1,2]"),
        ("[1", "text", '"[1"'), ("", "text", '""'), ("{} {}", "text", '"{} {}"'), ("a\nb", "text", '"a\\nb"'), (None, None, None),
    ]
    for r in values(spark, cases, "t string, kind string, value string").withColumn("got", tx.normalized_reply(F.col("t"))).collect():
        assert (r.got.kind, r.got.value) == (r.kind, r.value) if r.t is not None else r.got is None, r


def by_depth(markup):
    """Text outside of tags, character by character."""
    depth, out = 0, []
    for c in markup:
        if c == "<":
            depth += 1
        elif c == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(c)
    return " ".join("".join(out).split())


def test_html(spark):
    cases = ["<p>a <b>c</b></p>\n d", "x <a <b>> y", "open <tag never", "1 > 0", "", "a <<<<x>>>> b", "v<map<string,vector<set<int>>>> rest", ">>a<b>c", "<b>" * 1000 + "t" + "</b>" * 999 + "q", "<i>w </i>" * 1000]
    for r in values(spark, [(c,) for c in [*cases, None]], "t string").withColumn("got", tx.strip_html(F.col("t"))).collect():
        assert r.got == (None if r.t is None else by_depth(r.t)), r
    assert by_depth("a <<<<x>>>> b") == "a b"


def test_long_text_in_linear_time(spark):
    """A text of 2.9 MB takes no more than a few times the time a MB of one of 0.7 MB."""
    import time

    took = {}
    for n in (90_000, 90_000, 360_000):
        t = spark.range(1).select(F.repeat(F.lit("wordily "), F.lit(n)).alias("t")).cache()
        t.count()
        began = time.time()
        assert t.select(F.size(tx.chunks(F.col("t")))).first()[0] == -(-(8 * n - 1 - 1000) // 850) + 1
        took[n] = time.time() - began
    assert took[360_000] < 8 * took[90_000] + 1, took


def test_excerpts(spark):
    cases = [("ab\0c", 10), ("é" * 10, 7), ("€" * 10, 8), ("🙂" * 3, 7), ("abcdef", 3), ("abc", 3), (None, 3), ("", 3)]
    for n, (t, most) in enumerate(cases):
        kind, cut = retrieval.excerpt(F.col("t"), most)
        r = values(spark, [(t,)], "t string").select(kind.alias("kind"), cut.alias("cut")).first()
        if t is None:
            assert tuple(r) == (None, None)
            continue
        data = t.encode()
        want = t if len(data) <= most else data[:most].decode(errors="ignore") + f"\n(cut; {len(data)} bytes in all)"
        assert tuple(r) == ("binary" if "\0" in t else "text", want), n


def test_titles(spark):
    cases = [("a\n b", "a b"), ("é" * 61, "é" * 60 + "…"), ("é" * 60, "é" * 60), ("  ", "")]
    for r in values(spark, cases, "t string, want string").withColumn("got", tx.title(F.col("t"))).collect():
        assert r.got == r.want


CALLS = "conv_id int, position int, ordinal int, server_id string, tool string, tool_use_id string, arguments string, content string, is_error boolean, turn int, text string"
BIND = [("s", "find", "s__find")]


def replayed(spark, msgs, calls, bind=BIND):
    m = values(spark, msgs, "conv_id int, position int, role string, content string")
    b = values(spark, bind, "server_id string, tool string, advertised string")
    rows = chats.replay(m, values(spark, calls, CALLS), b).collect()
    return [(r.role, r.content, r.tools) for r in sorted(rows, key=lambda r: (r.position, r.round, r.part))]


def call(ordinal, turn=1, tool="find", arguments="{}", error=False, position=1):
    return (1, position, ordinal, "s", tool, f"t{ordinal}", arguments, "found", error, turn, "")


def test_history_replay(spark):
    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more")]
    one = replayed(spark, talk, [call(1)])
    assert [r for r, *_ in one] == ["user", "assistant", "user", "assistant", "user"]
    assert len(replayed(spark, talk[1:2], [call(1, 1), call(2, 2)])) == 5
    assert len(replayed(spark, talk[1:2], [call(1, 1), call(2, 2), call(3, 1)])) == 7  # rounds are islands
    assert replayed(spark, talk[1:2], [call(1, tool="gone")]) == [("assistant", "a", None)]
    assert replayed(spark, talk[1:2], [call(1)], [("x", "y", "z")]) == [("assistant", "a", None)]
    blank = replayed(spark, [(1, 1, "assistant", "")], [call(1, arguments="", error=True)])
    assert len(blank) == 2 and '"arguments":"{}"' in blank[0][2] and '"arguments":"true"' in blank[1][2]
    assert replayed(spark, talk, []) == [("user", "q", None), ("assistant", "a", None), ("user", "more", None)]


def test_throttle(spark):
    df = spark.sql("select 1 as k, timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as at from values (0),(4),(6),(10),(11) v(m)")
    assert [r.at.minute for r in chats.throttle(df, "k", "at").orderBy("at").collect()] == [0, 6, 11]


def test_wildcard_lookup(spark):
    entries = values(spark, [(1, "*", "github:read"), (1, "admin_op", "github:admin"), (1, "none", ""), (2, "x", "only")], "s int, tool string, value string")
    wanted = values(spark, [(1, "list"), (1, "admin_op"), (1, "none"), (1, "/initialize"), (2, "other"), (2, "x")], "s int, tool string")
    got = {(r.s, r.tool): r.value for r in catalog.own_or_wildcard(wanted, entries, ["s"]).collect()}
    assert got == {(1, "list"): "github:read", (1, "admin_op"): "github:admin", (1, "none"): "", (1, "/initialize"): None, (2, "other"): None, (2, "x"): "only"}


def test_access_terms(spark):
    levels = values(spark, [("read", 0, "repo:status"), ("read", 1, "read:org"), ("admin", 0, "repo"), ("admin", 1, "admin:org")], "level string, scope_position int, scope string")
    asked = values(spark, [(1, 1, "read"), (2, 1, "gist"), (3, 1, "read"), (3, 2, "gist"), (4, 1, "read"), (4, 2, "admin"), (5, 1, " ")], "k int, position int, term string")
    got = {r.k: (len(r.scopes), r.level) for r in catalog.resolve_terms(asked, levels, "k").collect()}
    assert got == {1: (2, "read"), 2: (1, None), 3: (3, None), 4: (4, None)}


def test_advertised_names(spark):
    long = "n" * 70
    df = values(spark, [(1, "a", "x y"), (1, "a", "x_y"), (1, "a", "x-y"), (2, "b", long + "1"), (2, "b", long + "2")], "g int, server string, name string")
    got = [r.advertised for r in catalog.advertised_names(df, "g", "server", "name").collect()]
    assert len(set(got)) == 5 and all(len(x) <= 64 for x in got) and {"a__x_y", "a__x_y_2", "a__x-y"} <= set(got)


def test_advertised_names_are_unique(spark):
    """A name that a number makes may be another tool's own, or, cut to the limit, another number's."""
    q = "q" * 70
    names = ["a.x", "a x", "a_x_2", "a_x", "b", "b_2", "b_2_2", "b", q, q + "z", "q" * 59 + "_2", "q" * 60 + "y", None, None]
    df = values(spark, [*[(1, "s", n, i) for i, n in enumerate(names)], (2, "s", "a.x", 99), (None, "s", "a.x", 100)], "g int, server string, name string, id int")
    got = {r.id: (r.g, r.advertised) for r in catalog.advertised_names(df, "g", "server", "name", order=("id",)).collect()}
    assert len(set(got.values())) == len(got) == df.count() and all(len(x) <= 64 for _, x in got.values())
    assert got[2] == (1, "s__a_x_2") and got[5] == (1, "s__b_2") and got[99] == (2, "s__a_x") and got[100] == (None, "s__a_x")


def test_throttle_of_hot_and_sparse_keys(spark):
    """Against the definition, use by use; one key has 100,000 uses."""
    import random
    from datetime import datetime, timedelta

    r = random.Random(1)
    uses = [(k, r.randrange(20 * 86_400)) for k in range(5) for _ in range(1000)] + [(9, i * 7) for i in range(100_000)] + [(8, 86_400 * 3 + i * 100) for i in range(20)] + [(7, 5), (7, 5), (7, 305)]
    start = datetime(2024, 1, 1)
    df = values(spark, uses, "k long, s long").select("k", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)").alias("at"))
    df = df.unionAll(values(spark, [(None, start), (3, None)], "k long, at timestamp_ntz"))
    want, last = [], {}
    for k, s in sorted(uses):
        if k not in last or s >= last[k] + 300:
            last[k] = s
            want.append((k, start + timedelta(seconds=s)))
    for long_walk in (chats.LONG_WALK, 5000, 0):  # no key, the hot one, and every key in runs
        assert sorted(map(tuple, chats.throttle(df, "k", "at", long_walk=long_walk).collect())) == want
    assert not chats.throttle(df.limit(0), "k", "at").collect()


def test_step_checks(spark):
    step = lambda w, p, name="s", kind="code", agent="", prompt="", code="x": (w, p, name, kind, agent, prompt, code)
    rows = [step(1, 1), step(1, 2, "t", "agent", "a", "p", ""), step(2, 1), step(2, 2), step(3, 1, "a b"), step(4, 1, kind="odd"), step(5, 1, "s", "agent", "", "p", ""), step(6, 1, code=""), *[step(7, i, f"s{i}") for i in range(1, 27)]]
    df = values(spark, rows, "workflow_id int, position int, name string, type string, agent_id string, prompt string, code string")
    got = {r.workflow_id: r.error for r in workflows.step_errors(df).collect()}
    want = {1: None, 2: "name used twice", 3: "bad name", 4: "unknown type", 5: "no agent", 6: "no code", 7: "too many steps"}
    assert got == want
    known = values(spark, [(1,), (2,), (9,), (9,)], "workflow_id int")
    assert {r.workflow_id: r.error for r in workflows.step_errors(df, known).collect()} == {1: None, 2: "name used twice", 9: "no steps"}


def test_rendering(spark):
    df = spark.sql("""select parse_json('{"Input":{"city":"Porto","days":3,"note":null},"Steps":{"plan":{"title":"Two bridges"}},"Previous":{"ok":true}}') as v""")
    for template, want in [
        ("{{ .Input.city }} in {{.Input.days}} days: {{ .Steps.plan.title }}, {{ .Previous.ok }}.", ("Porto in 3 days: Two bridges, true.", None)), ("Note {{ .Input.note }}", ("Note null", None)), ("as it is { .Input.city }", ("as it is { .Input.city }", None)),
        ("{{ .Steps.route.title }} {{ .Input.zip }}", (None, "missing Steps.route.title")), ("", ("", None)), ("x" * 262_145, (None, "prompt too large")),
    ]:
        prompt, error = workflows.render(template, F.col("v"))
        assert tuple(df.select(prompt, error).first()) == want


def test_steps_of_a_pipeline(spark):
    none = F.lit(None).cast("string")
    df = values(spark, [(1, 21)], "id int, input int")
    log = workflows.run_steps(df, [("double", lambda x, p, s: (x * 2, none)), ("total", lambda x, p, s: (x + p.cast("int"), none))]).orderBy("position").collect()
    assert [r.output for r in log] == ["42", "63"]


def test_log_lines(spark):
    line = r'[2024-01-01T00:00:00.000Z] (WARN) trace_id=ab note="a b=c" empty="" msg="said \"hi\""'
    r = values(spark, [(line,)], "l string").select(*[c.alias(n) for n, c in logs.parse_line(F.col("l")).items()]).first()
    assert r.level == "WARN" and r.fields == {"trace_id": "ab", "note": "a b=c", "empty": "", "msg": 'said "hi"'}


def test_deliveries(spark):
    df = spark.sql("""select id as message_id, timestamp_ntz '2024-01-01 00:10:00' - make_interval(0,0,0,0,0,ago,0) as attempt_ts, acked from values
        (1, 1, true), (2, 1, false), (3, 3, false), (4, 3, false), (4, 4, false), (4, 5, false), (4, 6, false), (4, 7, false) v(id, ago, acked)""")
    got = {r.message_id: r.state for r in logs.deliveries(df, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).collect()}
    assert got == {1: "done", 2: "pending", 3: "reclaimable", 4: "dropped"}


def test_sinks_are_idempotent(spark):
    target = values(spark, [(1, "a"), (2, "b")], "k int, v string")
    changes = values(spark, [(2, "old", 1), (2, "new", 2), (3, "c", 1)], "k int, v string, version int")
    once = maintenance.upsert(target, changes, ["k"], "version")
    twice = maintenance.upsert(once, changes, ["k"], "version")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "new"), (3, "c")]
    rekeyed = maintenance.rekey(values(spark, [("a", 1), ("1:b", 1), ("c", None)], "k string, o int"), "k", "o")
    again = maintenance.rekey(rekeyed, "k", "o")
    assert sorted(r.k for r in again.collect()) == sorted(r.k for r in rekeyed.collect()) == ["1:a", "1:b", "c"]


def test_tenants(spark):
    df = values(spark, [(1, "a"), (2, ""), (3, None)], "i int, organization_id string")
    count = lambda o: entitlements.of_organization(df, o).count()
    assert (count("a"), count(""), count(None)) == (1, 0, 0)


def test_vectors(spark):
    items = values(spark, [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, [-1.0, 0.0]), (4, 2, [1.0, 0.0])], "id int, t int, embedding array<float>")
    queries = values(spark, [(9, 1, [2.0, 0.0])], "query_id int, t int, embedding array<float>")
    assert [(r.id, r.score) for r in retrieval.top_k(queries, items, ["t"], 5).orderBy("rank").collect()] == [(1, 1.0), (3, 0.0)]
    with pytest.raises(ValueError):
        retrieval.require_schema(items, {"id": "bigint"})


def test_index_recall(spark):
    """Nine of ten of each tenant's results, from a part of its vectors, without a row for each query and item."""
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "label as t", "embedding")
    q = got.where("id % 25 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build_index(got, ["t"])
    assert index.items.count() == got.count()  # every vector is in it
    exact = retrieval.top_k(q, got, ["t"], 5).select("query_id", "id", "t", "score")
    found = index.search(q).select("query_id", "id", F.col("score").alias("found"))
    hits = exact.join(found, ["query_id", "id"]).where("score = found").groupBy("t").count().join(exact.groupBy("t").agg(F.count("*").alias("of")), "t").collect()
    assert len(hits) == exact.select("t").distinct().count() and all(r["count"] >= 0.9 * r["of"] for r in hits), hits
    assert all(r.scored_share < 0.75 for r in index.read_share(q).collect())
    plan = index.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_of_few_and_odd_vectors(spark):
    items = values(spark, [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", [0.0, 0.0]), (4, "a", None), (5, "b", [1.0, 1.0]), (6, "a", [1.0, 0.0])], "id int, t string, embedding array<double>")
    queries = values(spark, [(1, "a", [3.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [1.0, 0.0]), (4, "a", [0.0, 0.0])], "query_id int, t string, embedding array<double>")
    for cells in (None, 2, 50):
        got = vector_index.build_index(items, ["t"], cells=cells).search(queries, 2, least=9)
        assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == [(1, 1, 1), (1, 6, 2), (2, 5, 1)]
    assert not vector_index.build_index(items.limit(0), ["t"]).search(queries).collect()


def test_embedding_by_a_model(spark, tmp_path):
    """One batch fails twice and then comes; one text always fails, alone; an empty vector is an error."""
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.write("x")
        if len(open(log).read()) <= 2 or "bad" in texts:
            raise ConnectionError("busy")
        return [[] if t == "silent" else [len(t), 1] for t in texts]

    rows = [(i, t) for i, t in enumerate(["one", "three", None, "silent", "bad", "", "seven"])]
    df = values(spark, rows, "id int, text string").withColumn("embedding", F.lit("old")).coalesce(1)
    got = {r.id: (r.embedding, r.embedding_error) for r in retrieval.batch_embedder(model, batch=3, tries=3, wait_seconds=0.001)(df).collect()}
    assert got[0] == ([3.0, 1.0], None) and got[1] == ([5.0, 1.0], None) and got[2] == (None, None) and got[3] == (None, "empty vector")
    assert got[4] == (None, "ConnectionError: busy") and got[5] == ([0.0, 1.0], None) and got[6] == ([5.0, 1.0], None)
    short = retrieval.batch_embedder(lambda texts: [[1.0]], batch=4, tries=1)(df)
    assert {r.embedding_error for r in short.where("text is not null").collect()} == {None}  # asked for one by one in the end


def test_document_names(spark):
    cases = [("Report_v2 (final).pdf", "Report v2 (final)"), ("/a/b.c/x..y.md", "x y"), (".pdf", "document-7"), ("été_[1]-a.txt", "t [1]-a"), ("plain", "plain"), ("a!b?.csv", "ab"), (None, "document-7"), ("_ .txt", "document-7")]
    for r in values(spark, cases, "f string, want string").withColumn("got", chats.document_name(F.col("f"), F.lit(7))).collect():
        assert r.got == r.want, r


def test_traces(spark):
    lines = values(spark, [("a", "ERROR"), ("a", "INFO"), ("b", "INFO"), ("", "INFO"), (None, "INFO")], "trace_id string, level string")
    requests = values(spark, [("a", 500, 1.5), ("a", 200, 0.5), ("c", 200, None)], "trace_id string, status int, duration_s double")
    assert sorted(tuple(r) for r in logs.by_trace(lines, requests).collect()) == [("a", 2, 1, 2, 1, 1.5), ("b", 1, 0, 0, 0, None), ("c", 0, 0, 1, 0, None)]


def test_sketches_of_any_grouping(spark):
    """Quantiles of sketches that were put together in two ways are near the exact ones by rank; few values are exact."""
    log = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 100 > 0, (F.col("id") * 7919 % 50_021).cast("double")).alias("duration_s"), F.lit(200).alias("status"), (F.col("id") % 40).alias("part"))
    merged = logs.merge_sketches(logs.duration_sketches(log, ["k", "part"]), ["k"])
    once = logs.duration_sketches(log, ["k"])
    for rows in (merged, once):
        for r in logs.quantiles(rows, {"p50": 0.5, "p99": 0.99}).collect():
            mine = log.where(F.col("k") == r.k)
            n = mine.where("duration_s is not null").count()
            assert r.requests == mine.count()
            for q, v in ((0.5, r.p50), (0.99, r.p99)):
                assert abs(mine.where(F.col("duration_s") <= v).count() / n - q) < 0.02
    few = values(spark, [(1, 200, float(x)) for x in (5, 1, 3)] + [(2, 500, None)], "k int, status int, duration_s double")
    assert sorted(map(tuple, logs.quantiles(logs.duration_sketches(few, ["k"]), {"p50": 0.5}).collect())) == [(1, 3, 0, 3.0), (2, 1, 1, None)]


def test_messages(spark):
    lines = values(spark, [('{"type":"a","document_id":"1"}',), ("{broken",), ("",), ('{"type":5}',)], "value string")
    assert [r.ok for r in messages(lines).collect()][:2] == [True, False]


def test_numbers_of_lists_without_sorting_pairs(spark):
    """Collections are numbered once; a parent with two collections at one place is numbered pair by pair."""
    links = values(spark, [(1, 0, 7), (1, 1, 8), (1, 2, 99), (2, 5, 8), (2, 6, 7), (3, 0, 7), (3, 0, 8), (4, 0, 7), (4, 1, 7)], "a int, p int, c int")
    docs = values(spark, [(7, 3), (7, 1), (8, 2), (8, 4), (9, 5)], "c int, d int")
    got = retrieval.numbered_of_lists(links, docs, "a", "p", "c", ["d"])
    want = retrieval.numbered(links.join(docs, "c"), ["a"], ["p", "d"])
    key = lambda df: sorted(map(tuple, df.select("a", "p", "c", "d", "n").collect()))
    assert key(got) == key(want) and len(key(got)) == 16 and dict(got.dtypes)["n"] == "int"
    before = got.where("a = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "_before" in before


def test_lists_of_many_are_written_small(spark, monkeypatch, tmp_path):
    """Pairs of links and documents come in runs that Parquet packs: they had over a byte each."""
    links = spark.range(1000).selectExpr("id as a", "cast(0 as int) as p", "7L as c", "id * 3 as more").unionAll(spark.range(400).selectExpr("id", "1", "8L", "id"))
    docs = spark.range(1000).selectExpr("7L as c", "id * 17 % 1009 as d").unionAll(spark.range(10).selectExpr("8L", "id"))
    retrieval.numbered_of_lists(links, docs, "a", "p", "c", ["d"]).write.parquet(f"{tmp_path}/pairs")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.4 * 1_004_000
    rows = lambda df: sorted(map(tuple, df.select("a", "p", "c", "d", "more", "n").collect()))
    want = rows(retrieval.numbered(links.where("a < 50").join(docs, "c"), ["a"], ["p", "d"]))
    monkeypatch.setattr(retrieval, "LINKS", 8)
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    assert rows(retrieval.numbered_of_lists(links.where("a < 50"), docs, "a", "p", "c", ["d"])) == want and len(want) == 50_500


def test_files_are_written_in_tasks(spark, tmp_path):
    from loomlake.sources import uploads, write_files

    rows = values(spark, [("a=1/b=2.txt", "x\ny"), ("a=1/b=3.txt", ""), ("a=-2/b=4.txt", None), ("a=-2/b=5.txt", "é")], "name string, content string")
    for at in (f"{tmp_path}/plain", f"file://{tmp_path}/named"):
        assert write_files(rows, at) == 4 and write_files(rows, at) == 4
        got = uploads(spark, at, "*.txt").collect()
        assert sorted((r.path.split("/a=")[1], r.length, bytes(r.content)) for r in got) == [("-2/b=5.txt", 2, "é".encode()), ("1/b=2.txt", 3, b"x\ny")]  # the reader passes over empty ones
        assert {f.name: f.stat().st_size for f in tmp_path.rglob("b=*.txt") if at.endswith(f.parts[-3])} == {"b=2.txt": 3, "b=3.txt": 0, "b=4.txt": 0, "b=5.txt": 2}
    assert write_files(rows.limit(0), f"{tmp_path}/none") == 0


def test_files_are_listed_in_tasks(spark, monkeypatch, tmp_path):
    """The driver held the path and state of every file; hidden and empty files and other names are left out, as before."""
    import __spark_entry__ as entry
    from loomlake import sources

    monkeypatch.setattr(sources, "TASK_FILES", 2, raising=False)
    monkeypatch.setattr(sources, "READ_ROWS", 2, raising=False)
    monkeypatch.setattr(sources, "READ_BYTES", 3, raising=False)
    want = {"/a.txt": b"x", "/b/c=1/d e.txt": "é\n".encode(), "/b/c=2/f.txt": b"12345", "/b/c=2/_g=1.txt": b"z", "/b/c=2/h.txt": b"67", "/b/c=2/i.txt": b"8"}
    for name, content in (want | {"/_no.txt": b"x", "/.no.txt": b"x", "/_hidden/a.txt": b"x", "/b/empty.txt": b"", "/b/other.csv": b"x"}).items():
        (tmp_path / "up" / name[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "up" / name[1:]).write_bytes(content)
    for at in (f"{tmp_path}/up", f"file://{tmp_path}/up/"):
        got = sources.uploads(spark, at, "*.txt")
        assert not got.inputFiles()
        assert {r.path.removeprefix(at.rstrip("/")): (r.length, bytes(r.content)) for r in got.collect()} == {n: (len(c), c) for n, c in want.items()}
    (tmp_path / "none").mkdir()
    assert sources.uploads(spark, f"{tmp_path}/none").count() == 0
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert not entry.queries()["s4_accepted_files"](spark, f"{tmp_path}/sf").collect()


def test_chunks_take_no_pattern_to_trim(spark):
    """A pattern looked at every character of every window, behind it too, and a text was trimmed for each use."""
    spaces = "\t\n\x0b\f\r \x85\xa0        　"
    df = values(spark, [(spaces + "a 　b" + spaces,), (spaces,), (None,), ("​x",)], "t string")
    assert [r.t for r in df.select(tx.trimmed(F.col("t")).alias("t")).collect()] == ["a 　b", "", None, "​x"]
    plan = df.select(tx.chunks(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("trim(t#") == 1


def test_top_k_in_blocks(spark, monkeypatch):
    """Blocks of three rows, copies, a row of another length, nulls: the same as by brute force, and no row for each pair."""
    import random

    monkeypatch.setattr(retrieval, "BLOCK", 3)
    draw = random.Random(1)
    rows = [(i, i % 2, [float(draw.randint(-3, 3)) for _ in range(4)] if i % 5 else [1.0, 2.0, 0.0, 1.0]) for i in range(60)]
    odd = [(100, 0, [1.0]), (101, 0, None), (102, 1, [None, 1.0, 1.0, 1.0]), (103, None, [1.0, 2.0, 0.0, 1.0])]
    items = values(spark, rows + odd, "id int, t int, embedding array<float>")
    queries = items.where("id % 4 < 2 and id < 60").selectExpr("id as query_id", "t", "embedding", "id % 7 as k")
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] if any(v) else None for i, _, v in rows}
    score = lambda a, b: round((1 + sum(x * y for x, y in zip(unit[a], unit[b]))) / 2, 6)
    for k in (5, "k"):
        want = {}
        for q, t, _ in rows:
            if q % 4 < 2 and unit[q]:
                near = sorted((-score(q, i), i) for i, u, _ in rows if u == t and unit[i])
                want |= {(q, n + 1): i for n, (_, i) in enumerate(near[: k if k == 5 else q % 7])}
        got = retrieval.top_k(queries, items, ["t"], k)
        assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_dealt_out(spark, monkeypatch):
    """Rows of a key were in one task with a copy of its text each; keys without a text stay."""
    monkeypatch.setattr(retrieval, "SHARE_BYTES", 40)
    rows = values(spark, [(i, i % 3) for i in range(90)], "q int, k int")
    texts = values(spark, [(0, "x" * 10), (1, "y" * 100), (5, "z")], "k int, t string")
    sizes = values(spark, [(0, 30, 10), (1, 30, 100), (5, 1, 1)], "k int, n long, bytes long")
    got = retrieval.with_long_text(rows, texts, sizes, "k", "q")
    assert sorted((r.q, r.k, r.t) for r in got.collect()) == [(i, i % 3, {0: "x" * 10, 1: "y" * 100}.get(i % 3)) for i in range(90)]
    held = got.where("t is not null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) <= 20  # 8 shares of four rows and 30 of one


def test_long_lists_lie_in_files(spark, monkeypatch, tmp_path):
    """Texts longer than a share: one in a task at most, made as the row is given out; the same texts as by ``listed``."""
    monkeypatch.setattr(retrieval, "SHARE_BYTES", 300)
    docs = values(spark, [(i, i % 3, None if i % 7 == 0 else f"é{i}\n" * (i % 5)) for i in range(60)] + [(70, 5, None), (71, 6, ""), (72, None, "x")], "d int, k int, t string")
    block = lambda n: retrieval.file_block(n, F.lit(""), F.col("t"))
    files = retrieval.listed_in_files(docs, "k", ["d"], block, f"file://{tmp_path}/texts")
    assert sorted(r.k for r in files.collect()) == [0, 1, 2, 6]
    rows = values(spark, [(i, i % 9 if i % 10 else None, None if i % 4 == 0 else "" if i % 4 == 1 else f"own{i}") for i in range(80)], "q int, k int, own string")
    want = {r.k: r.t for r in retrieval.listed(retrieval.numbered(docs.where("k < 5 or k = 6"), ["k"], ["d"]), ["k"], block(F.col("n")), ["n"], "intro", "t").collect()}
    got = retrieval.with_listed(rows, files, "k", "q", "intro", "own", "text")
    text = lambda k, own: "\n\n".join(x for x in (want.get(k), own) if x)
    assert sorted((r.q, r.text) for r in got.collect()) == [(r.q, text(r.k, r.own)) for r in rows.orderBy("q").collect()]
    held = got.where(F.length("text") > 400).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 20 and {r["count"] for r in held} == {1}
    none = retrieval.with_listed(rows, files.where("k > 99"), "k", "q", "intro", "own", "text")
    assert sorted((r.q, r.text) for r in none.collect()) == [(r.q, r.own or "") for r in rows.orderBy("q").collect()]


def test_prompts_are_not_moved(spark, monkeypatch):
    """Repeated files went through a shuffle, and a few prompts came to one task by chance."""
    import __spark_entry__ as entry

    monkeypatch.setattr(retrieval, "SHARE_BYTES", 1000)
    got = entry.queries()["a12_prompt_assembly"](spark, "/root/testdata/sf0.01")
    held = got.where(F.length("prompt") > 20_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 5 and {r["count"] for r in held} == {1}


def test_index_with_an_exact_check(spark):
    """What near cells miss is found; vectors without structure are missed by a search of one cell."""
    import random

    draw = random.Random(2)
    items = values(spark, [(i, i % 2, [draw.gauss(0, 1) for _ in range(8)]) for i in range(400)], "id int, t int, embedding array<double>")
    queries = items.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build_index(items, ["t"])
    rows = lambda df: {(r.query_id, r["rank"]): (r.id, r.score) for r in df.collect()}
    want = rows(retrieval.top_k(queries, items, ["t"], 5))
    assert rows(index.search(queries, 5, share=0.01, least=1)) != want
    assert rows(index.search_exactly(queries, 5, share=0.01, least=1)) == want
    got = rows(index.search(queries, 5, least=1))
    assert len(set(got.values()) & set(want.values())) >= 0.9 * len(want)  # by the share that trials needed
