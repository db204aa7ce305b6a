"""Operators against brute force on small fixtures."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import attribution, balltree, language, preferences, queries
from tests.conftest import DATA, compare


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P

    return P


def test_token_counts_by_line(spark, vocabulary):
    import tiktoken

    texts = ["one line", "a\nb  \n  c\n", "\n\n\nx", "é\nübung\n", "", None, "word " * 3000 + "\nend"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path, pattern = vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN
    encoding, sizes = attribution.byte_ranks(path, pattern)
    for rule in attribution.RULES:
        got = attribution.count_tokens(docs, path, pattern, rule).collect()
        for i, text in enumerate(texts):
            data = (text or "").encode()
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            lines = data.splitlines(keepends=True)
            assert [data[r.byte_start : r.byte_end] for r in mine] == lines
            assert [(text or "")[r.char_start : r.char_end].encode() for r in mine] == lines
            ids = encoding.encode_ordinary(text or "")
            assert abs(sum(r.tokens for r in mine) - len(ids)) < 1e-6
            # Brute force, byte by byte.
            owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            want, at = np.zeros(len(lines)), 0
            for t in ids:
                share = np.bincount(owner[at : at + sizes[t]], minlength=len(lines))
                if rule == "start":
                    want[owner[at]] += 1
                elif rule == "majority":
                    want[int(share.argmax())] += 1
                else:
                    want += share / sizes[t]
                at += sizes[t]
            assert np.allclose([r.tokens for r in mine], want)


def test_token_counts_with_given_sections(spark, vocabulary):
    docs = spark.sql("""select 1L as doc_id, 'Title here. Body text follows.' as text, array(named_struct('start', 0L, 'end', 11L), named_struct('start', 12L, 'end', 30L)) as parts
        union all select 2, null, array(named_struct('start', 0L, 'end', 5L)) union all select 3, 'abc', null""")
    got = attribution.count_tokens(docs, vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN, "majority", "parts").collect()
    assert sorted((r.doc_id, r.section, r.tokens) for r in got) == [(1, 0, 3.0), (1, 1, 4.0), (2, 0, 0.0)]
    with pytest.raises(ValueError):
        attribution.count_tokens(docs, "", "", "none")


def attributed(sizes, sections, rule):
    """Tokens of each section, byte by byte."""
    want, at = [0.0] * len(sections), 0
    for size in sizes:
        inside = [sum(a <= x < b for x in range(at, at + size)) for a, b in sections]
        if rule == "start":
            for k, (a, b) in enumerate(sections):
                want[k] += a <= at < b
        elif rule == "majority":
            if inside and max(inside) > 0 and max(inside) >= size - sum(inside):
                want[inside.index(max(inside))] += 1
        else:
            for k, n in enumerate(inside):
                want[k] += n / size
        at += size
    return want


def test_token_counts_of_odd_sections(spark, vocabulary):
    """Empty sections, at a gap and within a token, null ones and null ends, ends beyond the text, very long unbroken text."""
    text = "internationalization of été — counterrevolutionaries"
    lists = [
        [(0, 5), (5, 5), (8, 8), (9, 30)], [(3, 3)], [(0, 0), (0, 7), (7, 7), (7, 200)], [None, (0, 4)], [(None, 4), (5, None), (6, 9)], [], None, [(60, 70)], [(1, 2), (2, 3), (3, 4), (10, 11)],
    ]
    rows = [(i, text, None if x is None else [None if s is None else {"start": s[0], "end": s[1]} for s in x]) for i, x in enumerate(lists)]
    rows.append((99, "x" * 200_000, [{"start": 0, "end": 100_000}, {"start": 100_000, "end": 200_000}]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens array<struct<start:long,end:long>>")
    path, pattern = vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN
    encoding, sizes = attribution.byte_ranks(path, pattern)
    of_text = [int(sizes[t]) for t in encoding.encode_ordinary(text)]
    for rule in attribution.RULES:
        got = attribution.count_tokens(docs, path, pattern, rule, "tokens").collect()
        for i, x in enumerate(lists):
            known = [(k, s) for k, s in enumerate(x or []) if s is not None and None not in s]
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            assert [(r.section, (r.byte_start, r.byte_end)) for r in mine] == known
            assert np.allclose([r.tokens for r in mine], attributed(of_text, [s for _, s in known], rule)), (rule, i)
        assert len([r for r in got if r.doc_id == 99]) == 2


def test_token_counts_query_against_brute_force(spark, vocabulary):
    """The registered query over the whole small table: its lines, their characters and the tokens that begin there."""
    encoding, sizes = attribution.byte_ranks(vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)
    want = set()
    for d in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        ends = np.cumsum([sizes[t] for t in encoding.encode_ordinary(d.text)])
        begins = np.append(0, ends[:-1])
        at = chars = 0
        for k, line in enumerate(d.text.splitlines(keepends=True) if not re.search("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029\r]", d.text) else re.findall("[^\n]*\n|[^\n]+", d.text)):
            n = len(line.encode())
            want.add((d.doc_id, k, at, at + n, chars, chars + len(line), float(((begins >= at) & (begins < at + n)).sum())))
            at, chars = at + n, chars + len(line)
    got = queries.op4_token_counts(spark, f"{DATA}/sf0.001").collect()
    assert {(r.doc_id, r.section, r.byte_start, r.byte_end, r.char_start, r.char_end, r.tokens) for r in got} == want and len(got) == len(want)


def test_preferences_oracle(spark):
    a, b = compare(spark, "op5_preference_formatting")
    assert a == b and a


def test_preferences_prefix_and_masks(spark):
    turn = lambda *x: [{"role": r, "text": t} for r, t in x]
    cases = [
        (1, turn(("user", "hi"), ("assistant", "yes")), turn(("user", "hi"), ("assistant", "no"), ("user", "why"), ("assistant", "so"))),
        (2, turn(("user", "a")), turn(("user", "a"))),
        (3, None, turn(("user", None), (None, "x"))),
        (4, [], []),
        (5, turn((None, None)), turn(("user", ""), ("assistant", "z"))),
    ]
    kind = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    got = rows(preferences.format_pairs(spark.createDataFrame([(*c, "clash") for c in cases], kind)), "id")
    assert [got[i].n_common for i in range(1, 6)] == [1, 1, 0, 0, 1]
    r = got[1]
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert [r.rejected_completion[s.start : s.end] for s in r.rejected_mask] == ["no<|im_end|>", "so<|im_end|>"]
    assert [r.chosen_completion[s.start : s.end] for s in r.chosen_mask] == ["yes<|im_end|>"]
    assert got[2].chosen_completion == got[2].rejected_completion == "" and got[2].prompt
    assert got[3].prompt == "" and got[3].rejected_completion.count("<|im_start|>user\n") == 2


def test_pairs_that_part_early(spark):
    c = spark.createDataFrame([(0, i, "user" if i % 2 == 0 else "assistant", f"a{i}") for i in range(6)] + [(1, i, "user" if i % 2 == 0 else "assistant", f"b{i}") for i in range(4)] + [(4, 0, "user", "x"), (4, 1, "assistant", "y"), (4, 2, "user", "z"), (4, 3, "assistant", "w")], "conv_id long, turn long, role string, text string")
    got = rows(preferences.format_pairs(preferences.swapped_endings(c)), "conv_id")
    assert [got[i].n_common for i in (0, 1, 4)] == [2, 2, 2]
    assert got[0].rejected_completion.count("<|im_start|>") == 2 and "b3" in got[0].rejected_completion and got[4].rejected_completion == ""
    assert [got[1].rejected_completion[s.start : s.end] for s in got[1].rejected_mask] == ["a3<|im_end|>", "a5<|im_end|>"]


def test_swapped_replies_nulls_and_repeats(spark):
    c = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "later"), (1, 0, "user", "p"), (1, 0, "user", "p"), (1, None, None, None), (2, 0, "assistant", "alone"), (None, 0, "assistant", "lost")], "conv_id long, turn long, role string, text string")
    got = rows(preferences.swapped_replies(c), "conv_id")
    assert set(got) == {0, 2}
    assert [t.text for t in got[0].chosen] == ["q", "a"] and [t.text for t in got[0].rejected] == ["q"]
    assert not preferences.swapped_replies(c.limit(0)).collect()


def brute_top(ids, v, queries, k):
    out = set()
    for q in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q])))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    data += [(1000 + i, [0.5] * 8) for i in range(300)]  # a hot vector, with ties
    data += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0, 2.0]), (2005, [3.0, -1.0]), (2006, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    v = balltree.quantised(df)
    exact = {r.vec_id: r.v for r in v.collect()}
    import math

    for i, x in data[:50]:
        assert exact[i] == [math.floor(256 * float(np.float32(y))) for y in x]
    queries_ = [i for i in exact if i % 10 == 0 and exact[i]] + [2004, 2005]
    for how in ({}, {"shard_rows": 100, "block_rows": 40, "leaf": 8}, {"shard_rows": 50, "block_rows": 20, "leaf": 8, "most_cells": 6, "bundle": 2}):
        got = balltree.top_k(v, v.where("vec_id % 10 = 0 or vec_id in (2004, 2005)"), 5, **how)
        assert {tuple(r) for r in got.collect()} == brute_top(list(exact), exact, set(queries_), 5)
    assert not balltree.top_k(v.limit(0), v.limit(0)).collect()


def test_top_k_of_large_integers(spark):
    df = spark.createDataFrame([(i, [1e6 * (i + 1), -3e6]) for i in range(20)], "vec_id long, embedding array<double>")
    v = balltree.quantised(df)
    exact = {r.vec_id: r.v for r in v.collect()}
    got = balltree.top_k(v, v.where("vec_id < 5"), 5, leaf=2)
    assert {tuple(r) for r in got.collect()} == brute_top(list(exact), exact, range(5), 5)


def test_top_k_beyond_64_bits(spark):
    """Scores are cut to the ends of the range; cut ones tie."""
    df = spark.createDataFrame([(i, [1e17 * (-1) ** i, 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    v = balltree.quantised(df)
    got = balltree.top_k(v, v.where("vec_id = 2"), 5).collect()
    most = (1 << 63) - 1
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 0, most), (2, 4, most), (3, 6, most), (4, 1, -most), (5, 3, -most)]


def test_top_k_of_repeated_rows(spark):
    """A row that occurs twice is one; a third of all vectors are one, some of them queries."""
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(120)]
    df = spark.createDataFrame(data + data[::3] + data[-9:], "vec_id long, embedding array<float>")
    v = balltree.quantised(df)
    exact = {r.vec_id: r.v for r in v.collect()}
    want = brute_top(list(exact), exact, [i for i in exact if i % 10 == 0], 5)
    for how in ({}, {"shard_rows": 20, "block_rows": 5, "leaf": 4, "sample_rows": 64, "most_cells": 8, "bundle": 2}):
        got = [tuple(r) for r in balltree.top_k(v, v.where("vec_id % 10 = 0"), 5, **how).collect()]
        assert len(got) == len(want) and set(got) == want
    # One id with two vectors: each is a candidate, neither its own partner.
    two = balltree.quantised(spark.createDataFrame([(1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in balltree.top_k(two, two, 5).collect())
    assert got == [(1, 1, 2, 65536), (2, 1, 1, 327680), (2, 2, 1, 65536)]


def clusters(n: int, per: int, dim: int, seed: int) -> list[tuple[int, list[float]]]:
    """n tight groups of vectors of about one length, in directions of their own."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(n, dim))
    middle *= 4 / np.linalg.norm(middle, axis=1)[:, None]
    points = (middle[:, None, :] + rng.normal(size=(n, per, dim)) * 0.02).reshape(-1, dim)
    return [(i, [float(x) for x in v]) for i, v in enumerate(points)]


def test_top_k_looks_at_near_cells_only(spark):
    """Blocks meet the shards of cells that can reach their scores, on one and on two levels of cells, not all blocks all shards.

    Blocks are about as large as a group's queries; one over several groups has a wide ball and passes over less.
    """
    df = spark.createDataFrame(clusters(40, 60, 16, 5), "vec_id long, embedding array<float>")
    v = balltree.quantised(df).repartition(4).cache()
    exact = {r.vec_id: r.v for r in v.collect()}
    want = brute_top(list(exact), exact, [i for i in exact if i % 6 == 0], 5)
    for how in ({"most_cells": 64}, {"most_cells": 8}):  # the latter: cells of several groups, with centres of their own
        counts: dict[str, int] = {}
        got = balltree.top_k(v, v.where("vec_id % 6 = 0"), 5, shard_rows=40, block_rows=8, leaf=8, counts=counts, **how)
        assert {tuple(r) for r in got.collect()} == want
        assert counts["shards"] > 30 and counts["blocks"] > 20
        every = counts["blocks"] * counts["shards"]
        assert counts["block_cell_pairs"] <= counts["blocks"] * counts["cells"]
        assert counts["block_shard_pairs"] < every / 3 and counts["searched"] < every / 3


def test_shards_that_blocks_reach(spark):
    """Both levels of bounds against all pairs, with cells sent to all tasks and dealt."""
    rng = np.random.default_rng(2)
    at = lambda n: [[float(x) for x in v] for v in rng.normal(size=(n, 4)) * 10]
    middles = at(6)
    shards = [(4, j % 6, 100 + j, c, 0.5, middles[j % 6], float(np.linalg.norm(np.array(c) - middles[j % 6])) + 0.5) for j, c in enumerate(at(60))]
    blocks = [(4, i, c, 0.3, None if i == 0 else int(40 * (i % 7))) for i, c in enumerate(at(20))] + [(5, 99, [1.0] * 5, 0.0, None)]
    s = spark.createDataFrame(shards, "dim int, cell int, shard long, c array<double>, r double, middle array<double>, far double")
    b = spark.createDataFrame(blocks, "dim int, block long, qc array<double>, qr double, least long")
    norm = lambda x: float(np.linalg.norm(x))
    want = {(i, j) for _, i, qc, qr, least in blocks[:-1] for _, _, j, c, r, _, _ in shards if least is None or np.dot(qc, c) + norm(qc) * r + norm(c) * qr + qr * r >= least}
    before = balltree._BROADCAST_NUMBERS, balltree._SHARDS_A_KEY
    try:
        for limits in (before, (0, 3)):
            balltree._BROADCAST_NUMBERS, balltree._SHARDS_A_KEY = limits
            cells = balltree.cell_balls(s)
            got = balltree.near_shards(balltree.near_cells(b, cells, 3), s, cells).collect()
            assert len(got) == len(want) and {(r.block, r.shard) for r in got} == want
    finally:
        balltree._BROADCAST_NUMBERS, balltree._SHARDS_A_KEY = before
    assert 20 < len(want) < 1000


def test_top_k_query_against_brute_force(spark):
    """The registered query over the whole small table."""
    got = {tuple(r) for r in queries.op6_exact_top_k(spark, f"{DATA}/sf0.001").select("query_id", "rank", "vec_id", "score").collect()}
    exact = {r.vec_id: r.v for r in balltree.quantised(spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")).collect()}
    assert got == brute_top(list(exact), exact, [i for i in exact if i % 50 == 0], 5)


def test_language_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, f"{DATA}/sf0.01").collect()
    docs = rows(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    apart = [r for r in got if r.held_out and re.search(r"[^\W\d_]", docs[r.doc_id].text)]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in apart) >= 0.97 * len(apart)


def test_language_edges(spark):
    base = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    docs = spark.createDataFrame([(*r, "x") for r in base + [(100, None, "en"), (101, "", None), (102, "123 !? ½²", "de"), (103, "the dog", None), (103, "the dog", None)]], "doc_id long, text string, lang string, score string")
    got = language.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    assert [by[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    none = language.identify(docs.withColumn("lang", docs.lang.substr(0, 0).cast("string")).where("lang is null or true").withColumn("lang", docs.text.substr(1, 0))).collect()
    assert len(none) == len(got)
    assert not language.identify(docs.limit(0)).collect()
    assert all(r.lang_pred == "und" for r in language.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect())


def plain_ftrl(rows, y, labels, *, alpha=1.0, beta=1.0, l1=0.02, l2=0.02, epochs=2):
    """Follow the regularised leader on dictionaries, number by number."""
    import math

    z, n = [{} for _ in range(labels)], [{} for _ in range(labels)]

    def weight(k, f):
        a, s = z[k].get(f, 0.0), n[k].get(f, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(s)) / alpha + l2)

    for _ in range(epochs):
        for x, label in zip(rows, y):
            scores = [sum(weight(k, f) * v for f, v in x.items()) for k in range(labels)]
            top = max(scores)
            p = [math.exp(s - top) for s in scores]
            for k in range(labels):
                error = p[k] / sum(p) - (k == label)
                for f, v in x.items():
                    w, g, before = weight(k, f), error * v, n[k].get(f, 0.0)
                    n[k][f] = before + g * g
                    z[k][f] = z[k].get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w
    return lambda k, f: weight(k, f)


def test_language_query_steps_against_brute_force(spark):
    """Counts over all training rows, the learner and the scores, each against plain Python on a small fixture."""
    import math

    said = {"en": ["the cat and the dog", "a dog and a cat ran", "when the rain is over"], "de": ["der hund und die katze", "ein hund lief weg", "wenn der regen vorbei ist"], "fr": ["le chat et le chien", "un chien est parti", "quand la pluie est finie"]}
    docs = [(3 * i + j, t, l) for i in range(3) for j, (l, ts) in enumerate(said.items()) for t in [ts[i]]]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    grams = {i: Counter(zip(*(x.tolist() for x in language.features(t)))) for i, t, _ in docs}
    grams = {i: {f: n for f, n in c} for i, c in grams.items()}
    df = Counter(f for g in grams.values() for f in g)
    idf = {f: math.log((1 + len(docs)) / (1 + n)) + 1 for f, n in df.items()}
    assert all(abs(model.idf[f] - v) < 1e-12 for f, v in idf.items())

    def x(text):
        at, n = language.features(text)
        raw = {f: (1 + math.log(c)) * idf.get(f, math.log(1 + len(docs)) + 1) for f, c in zip(at.tolist(), n.tolist())}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {f: v / norm for f, v in raw.items()}

    # The rows in the order that the fit draws them in; every fifth of a label calibrates (here none).
    order = {r.doc_id: r.h for r in spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("doc_id", "xxhash64(doc_id, text) as h").collect()}
    place = {}
    for l in said:
        for n, (i, _, _) in enumerate(sorted((d for d in docs if d[2] == l), key=lambda d: order[d[0]]), 1):
            place[i] = n
    drawn = sorted(docs, key=lambda d: (place[d[0]], d[2]))
    weight = plain_ftrl([x(t) for _, t, _ in drawn], [model.labels.index(l) for *_, l in drawn], 3)
    for text in ("the dog", "die katze und", "un chat", "xyz"):
        want = [sum(weight(k, f) * v for f, v in x(text).items()) for k in range(3)]
        assert np.allclose(model.scores(text), want)
        p = np.exp(np.array(want) / model.temperature)
        assert model.predict(text) == (model.labels[int(np.argmax(p))], pytest.approx(float(p.max() / p.sum())))


def test_language_of_copies(spark):
    """All rows of a label are copies with one hash: it is learned all the same."""
    docs = [(i, f"the cat and the dog {i}", "en") for i in range(50)] + [(7, "der hund und die katze", "de")] * 60
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most_rows=4)
    assert model.labels == ["de", "en"] and model.predict("der hund")[0] == "de"


def test_language_pieces():
    at, n = language.features("ab", 16, 2)
    assert n.sum() == 4 + 3  # " ab " has 4 single characters and 3 pairs
    y = np.array([0, 1, 0, 1])
    assert language.temperature(np.array([[5.0, 0], [0, 5.0], [0, 5.0], [0, 5.0]]), y) > 1
    json.dumps(language.NONE)
