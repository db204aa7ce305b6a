"""Operators on documents against brute force, with planted edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomlake.llm import decontaminate, jaccard, language, licenses, packing, queries, shards, suffixes
from tests.conftest import DATA

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
KIND = "doc_id long, text string, extra string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents with nulls, blanks, ties, repeats and a column that clashes with a result's name."""
    small = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").selectExpr("doc_id", "text", "source as extra")
    r = random.Random(5)
    base = " ".join(r.choice(["alpha", "Beta", "gamma", "delta", "été", "x1"]) + str(r.randrange(60)) for _ in range(400))
    words = base.split()
    edited = " ".join(words[:200] + ["changed"] + words[201:])
    texts = [None, "", "  \n", "one", "a b c d", "A b C d", base, base, edited, base + " tail", "z" * 1000, "y" * 400, "y" * 399 + "é", "long " * 30000, "ñ" * 900]
    rows = [(10_000 + i, t, None) for i, t in enumerate(texts)] + [(10_001, "", None), (10_006, base, "again")]
    return small.unionByName(spark.createDataFrame(rows, KIND)).withColumnsRenamed({"extra": "hits"}).cache()


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(tuple(r)[1:])
    return out


# -- packing


def check_packed(rows, capacity):
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_packing_documents(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 2048).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in collected(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[i, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_packed(got, 2048)
    assert n <= 1.01 * sum(r.length for r in got) / 2048 + 2


def test_tokens_that_are_not_plain():
    import public_tokenizers as P
    from loomlake.llm.tokens import WordEnds
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["ΟΔΟΣ Σ", "İstanbul", "étude", "a<|endoftext|>b", "x y", "don't I'll we've", "a.b,c!? 12,3. ...,", "日本語 テスト", "a\x0bb\x1cc", "ﬁne ſ", "word. word, word"]
    t = Tokenizer.from_file(path)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert WordEnds(path).ids(texts) == want
    small = WordEnds(path, most=2)
    assert [small.ids([x])[0] for x in texts * 2] == want * 2


@pytest.mark.parametrize("sizes", [[100] * 500, [7] * 5000 + [2048] * 3, list(range(1, 2049)), [1025] * 50 + [1023] * 40 + [1] * 90, [1], []])
def test_best_fit(spark, sizes):
    rows = [(i, 0, n, "clash") for i, n in enumerate(sizes)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string"), 2048).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(i, n) for i, n, in enumerate(sizes)]
    n = check_packed(got, 2048)
    least = max(-(-sum(sizes) // 2048), sum(s > 1024 for s in sizes))
    if len(set(sizes)) == 1 and sizes:
        least = -(-len(sizes) // (2048 // sizes[0]))
    assert least <= n <= least * 1.02 + 1


def test_best_fit_bad_lengths(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, 0), (3, 0, 3000), (4, 0, 5)], "doc_id long, piece int, length long")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.best_fit(df, 2048).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (0, 0)}


# -- decontamination and licenses


def windows(items, n=10):
    out = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            out[tuple(w[a : a + k])].add(str(i))
    return out


def hits(text, win):
    w, hit, items = ALNUM.findall(lower(text)), set(), set()
    for n in {len(x) for x in win}:
        for a in range(len(w) - n + 1):
            if (x := tuple(w[a : a + n])) in win:
                hit.update(range(a, a + n))
                items |= win[x]
    return (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("block", [4 << 20, 1500])
def test_decontamination(spark, docs, block):
    bench = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, "one"), (901, None), (902, ""), (903, "long " * 12), (904, "Long long long"), (None, "A b"), (0, "gamma1 x")], "item_id long, text string")
    bench = bench.unionByName(more).unionByName(more.limit(1))
    win = windows([(r.item_id, r.text) for r in bench.where("item_id is not null").collect()])
    got = by_id(decontaminate.digest(docs, bench, block_bytes=block))
    want = defaultdict(list)
    for i, t in collected(docs):
        want[i].append(hits(t, win))
    assert got == want
    clean = decontaminate.clean(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, v in want.items() for x in v if not x[4])


def test_decontamination_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in decontaminate.digest(docs, none).collect())
    assert not decontaminate.digest(docs.limit(0), none).collect()


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "gratis for all").replace("merge, ", "")
    texts = ["x " * 50 + mit + " y" * 50, changed, "no licence here", None, "", "Released UNDER the mit  License. And again: Released under the MIT License.", "é Licensed under CC BY-NC 4.0. " * 2]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    rows = licenses.scan_licenses(df).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    assert {i: sorted({r.license for r in v}) for i, v in found.items()} == {0: ["MIT"], 1: ["MIT"], 5: ["MIT-notice"], 6: ["CC-BY-NC-4.0-notice"]}
    whole = found[0][0]
    assert whole.coverage == 1.0 and texts[0].encode()[whole.byte_start : whole.byte_end].decode() + "." == mit
    assert 0.9 < found[1][0].coverage < 1.0
    assert len(found[5]) == 2 and len(found[6]) == 2
    data = texts[6].encode()
    assert all(data[r.byte_start : r.byte_end] == b"Licensed under CC BY-NC 4.0" for r in found[6])
    assert not licenses.scan_licenses(df.limit(0)).collect()


def test_short_notices(spark):
    """Wordings of notices with a word left out, changed or put in, and neighbours that stay apart."""
    mit, cc = "MIT-notice", "CC-BY-NC-4.0-notice"
    cases = [
        ("It is released under MIT License, so there.", [(mit, 4, "released under MIT License")]),
        ("x Released under the terms of the MIT License y", [(mit, 5, "Released under the terms of the MIT License")]),
        ("Licensed under CC XX-NC 4.0", [(cc, 6, "Licensed under CC XX-NC 4.0")]),
        ("Licensed under CC BY-NC 4.0 Licensed under CC BY-NC 4.0", [(cc, 7, "Licensed under CC BY-NC 4.0")] * 2),
        ("Released under the MIT. Released under the MIT License", [(mit, 4, "Released under the MIT"), (mit, 5, "Released under the MIT License")]),
        ("Released under MIT License " * 5, [(mit, 4, "Released under MIT License")] * 5),
        ("Licensed under the terms of the Apache License 2.0", [("Apache-2.0-notice", 7, "Licensed under the terms of the Apache License 2.0")]),
        ("Released the License", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(licenses.scan_licenses(df).collect(), key=lambda r: (r.doc_id, r.word_start)):
        got[r.doc_id].append((r.license, r.n_matched, cases[r.doc_id][0].encode()[r.byte_start : r.byte_end].decode()))
    assert {i: got[i] for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}
    one = licenses.scan_licenses(df, {"word": "terms"}).collect()
    assert sorted((r.doc_id, r.n_matched) for r in one) == [(1, 1), (6, 1)]


def test_whole_licences_before_their_parts(spark, tmp_path):
    """A licence is reported, not the notice that is part of it; the best of places that overlap goes first."""
    t = licenses.TEMPLATES
    weak = " ".join(w for i, w in enumerate(t["MIT"].split()) if i % 7)  # 6 of 7 words
    texts = [t["BSD-3-Clause"], t["BSD-2-Clause"], f"{t['BSD-opening']} nothing else", f"{t['ISC']} {t['ISC-disclaimer']}", t["GPL-3.0-or-later"] + " " + t["GPL-no-warranty"], weak + " " + t["MIT"], t["LGPL-2.1-or-later"], t["AGPL-3.0-or-later"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].append((r.license, r.coverage))
    names = {i: sorted(n for n, _ in v) for i, v in got.items()}
    assert names[0] == ["BSD-3-Clause"] and names[1] == ["BSD-2-Clause"] and names[2] == ["BSD-opening"] and names[3] == ["ISC", "ISC-disclaimer"]
    assert names[5] == ["MIT", "MIT"] and max(c for _, c in got[5]) == 1.0
    assert "GPL-3.0-or-later" in names[4] and "GPL-no-warranty" in names[4]
    assert max(got[6], key=lambda x: x[1])[0] == "LGPL-2.1-or-later" and max(got[7], key=lambda x: x[1])[0] == "AGPL-3.0-or-later"
    (tmp_path / "own.txt").write_text("These words are a template of mine, é")
    own = licenses.read_templates(spark, str(tmp_path))
    assert own == {"own": "These words are a template of mine, é"}
    assert [r.license for r in licenses.scan_licenses(spark.createDataFrame([(1, "x these words are a template of mine é y")], "doc_id long, text string"), own).collect()] == ["own"]


def best_place(template, words, more):
    """The most template words that a run of document words, ``more`` than the template's, has in order, over all runs."""
    return max((longest_common(template, words[a : a + len(template) + more]) for a in range(len(words))), default=0)


NEAR_MISSES = [
    ("licensed under cc by 4.0", ["CC-BY-4.0-notice"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0-notice"]), ("licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0-notice"]), ("licensed under CC BY-NC-SA 4.0", []), ("Licensed under CC BY-NC 3.0.", []),
    ("This work is licensed under the GNU General Public License, version 2.", []), ("This work is licensed under the GNU Lesser General Public License, version 3.", []), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", []), ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
    ("Licensed under the Apache License 2.0", ["Apache-2.0-notice"]), ("Licensed under the Apache License, Version 1.1.", []), ("This code is licensed under the terms of the Eclipse licence of 2.0", []),
]


def test_licenses_that_differ_in_a_word(spark):
    """Words that make a licence another one decide, whatever else is in common; so do versions."""
    df = spark.createDataFrame([(i, f"Some words before it. {t} And some after it.") for i, (t, _) in enumerate(NEAR_MISSES)], "doc_id long, text string")
    got = defaultdict(set)
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].add(r.license)
    assert {t: sorted(got[i]) for i, (t, _) in enumerate(NEAR_MISSES)} == dict(NEAR_MISSES)
    long = {n: t for n, t in licenses.TEMPLATES.items() if "or-later" in n}
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(long.values())], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in rows} == dict(enumerate(long)) and len(rows) == len(long)


def test_license_scan_of_plain_pairs(spark):
    """A text full of word pairs that templates have too takes time in proportion to its length."""
    import time

    took = {}
    for n in (2000, 2000, 8000):
        df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("it is licensed to go under the hill of the general public and so on "), F.lit(n)).alias("text")).cache()
        df.count()
        began = time.time()
        assert licenses.scan_licenses(df).count() == 0
        took[n] = time.time() - began
    assert took[8000] < 8 * took[2000] + 1, took


def test_license_scan_against_brute_force(spark):
    """Which templates a document holds, against alignments everywhere; words are left out, changed and put in."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = {f"t{n}": " ".join(r.choice(vocabulary) for _ in range(n)) for n in (3, 5, 8, 12, 15, 20, 40)}
    texts = []
    for _ in range(120):
        fill = lambda: [r.choice(vocabulary) for _ in range(r.randrange(5, 30))]
        words = fill()
        for name in r.sample(sorted(templates), 2):
            edited = templates[name].split()
            for _ in range(r.randrange(0, 3)):
                at = r.randrange(len(edited))
                edited[at : at + 1] = r.choice([[], ["changed"], [edited[at], "more"]])
            words += edited + fill()
        texts.append(" ".join(words))
    texts += [None, "", "w1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(x.doc_id, x.license) for x in licenses.scan_licenses(df, templates).collect()}
    near, far = defaultdict(dict), set()
    for i, t in enumerate(texts):
        for name, template in templates.items():
            words, least = template.split(), 0.8 * len(template.split())
            if (most := best_place(words, (t or "").split(), 8)) >= least:
                near[i][name] = most
            if best_place(words, (t or "").split(), 2 * max(8, len(words))) >= least:
                far.add((i, name))
    # A short template's place may lie in that of another with more words.
    missed = {(i, name) for i, v in near.items() for name in v if (i, name) not in found and not (len(templates[name].split()) <= 15 and any(m > v[name] for m in v.values()))}
    assert found <= far and not missed
    assert len(found) > 100


def test_license_query_against_brute_force(spark):
    """The registered query over the whole small table: each place has the words it says, and texts with a template's words whole are found."""
    rows = queries.op3_license_scan(spark, f"{DATA}/sf0.001").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    plain = {n: ALNUM.findall(lower(t)) for n, t in licenses.TEMPLATES.items()}
    found = defaultdict(set)
    for r in rows:
        words = ALNUM.findall(lower(docs[r.doc_id]))[r.word_start : r.word_end]
        assert ALNUM.findall(lower(docs[r.doc_id].encode()[r.byte_start : r.byte_end].decode())) == words
        assert longest_common(plain[r.license], words) == r.n_matched >= 0.8 * r.n_words and r.n_words == len(plain[r.license])
        found[r.doc_id].add(r.license)
    for i, text in docs.items():
        said = " " + " ".join(ALNUM.findall(lower(text))) + " "
        whole = {n for n, w in plain.items() if f" {' '.join(w)} " in said}
        inner = {n for n in whole if any(m != n and f" {' '.join(plain[n])} " in f" {' '.join(plain[m])} " for m in whole)}
        assert whole - inner <= found[i]
    assert sum(map(len, found.values())) > 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment_against_common_subsequence():
    r = random.Random(2)
    for _ in range(60):
        template = np.array([r.randrange(8) for _ in range(30)], np.uint64)
        doc = [x for x in template.tolist() if r.random() > 0.1]
        for _ in range(3):
            doc.insert(r.randrange(len(doc)), 9)
        same, a, b = licenses.align(template, np.array(doc, np.uint64), 0, 40)
        assert same == longest_common(template.tolist(), doc) == longest_common(template.tolist(), doc[a:b])
    # A narrow band, and words put in after more words than it is wide.
    template = np.arange(60, dtype=np.uint64)
    for at in range(1, 60, 7):
        doc = np.insert(template, at, [99, 99, 99])
        assert licenses.align(template, doc, 0, 4) == (60, 0, 63)
        assert licenses.align(template, np.delete(template, [at, 59 - at // 2]), 0, 4)[0] == 58


# -- near copies


def components(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * (c := len(a & b)) >= percent * (len(a) + len(b) - c):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("how", [{}, {"k": 5, "percent": 80, "frequent": 2, "most_frequent": 50, "fragments": 2}])
def test_jaccard_components(spark, docs, how):
    rows = collected(docs)
    want = components(rows, how.get("k", 4), how.get("percent", 85))
    got = jaccard.jaccard_components(docs, **how).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *v) for i, v in want.items()}
    assert want[10_008][1] == want[10_006][1] == 10_006 and want[10_005][1] == 10_004


@pytest.mark.parametrize("how", [{}, {"k": 5, "percent": 80}])
def test_jaccard_hot_shingles(spark, how):
    """Many documents share shingles that sort as ordinary ones; a few of them link."""
    r = random.Random(6)
    k = how.get("k", 4)
    common = [f"c{i}" for i in range(80)]
    texts = []
    for i in range(150):
        words = common[:]
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            words[r.randrange(80)] = f"own{r.randrange(10**6)}"
        texts.append(" ".join(words + [f"tail{i}x{j}" for j in range(r.randrange(12))]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, k, how.get("percent", 85))
    got = jaccard.jaccard_components(df, **how, most_frequent=3).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, *v) for i, v in want.items()}
    assert len({v[1] for v in want.values()}) > 3


@pytest.mark.parametrize("how", [{}, {"k": 5, "percent": 80}])
def test_jaccard_shared_lines_in_blocks(spark, monkeypatch, how):
    """Texts that don't link share rare words: rows are blocks and candidates, not a member's words times its words."""
    monkeypatch.setattr(jaccard, "_MEMBERS", 64)
    r = random.Random(8)
    common = [f"c{i}" for i in range(90)]
    texts = []
    for i in range(300):
        words = common[:]
        for at in r.sample(range(90), 3):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    texts += [texts[7] + " more", texts[11] + " more"]
    rows = list(enumerate(texts))
    made, out = [], type(spark.range(0))
    checkpoint = out.checkpoint

    def counted(self, eager=True):
        made.append((tuple(self.columns), (df := checkpoint(self, eager)).count()))
        return df

    monkeypatch.setattr(out, "checkpoint", counted)
    join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    got = join.result().collect()
    want = components(rows, how.get("k", 4), how.get("percent", 85))
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, *v) for i, v in want.items()}
    assert want[300][1] == 7 and want[301][1] == 11
    blocks = [n for c, n in made if "blocks" in c]
    assert blocks and 1 < sum(blocks) < 1000


def test_jaccard_chain_and_empty(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    chain = []
    for i in range(60):  # each links with the next only, more or less
        words = words[:]
        words[i * 3] = f"new{i}"
        chain.append((500 - i, " ".join(words), None))
    df = spark.createDataFrame([*chain, (None, chain[0][1], None), (None, "alone here", None)], KIND)
    got = jaccard.jaccard_components(df).collect()
    want = components([(i, t) for i, t, _ in chain])
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(i, v[1]) for i, v in want.items()}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[500][1]), "None"])
    assert not jaccard.jaccard_components(df.limit(0)).collect()


# -- shards


def check_shards(rows, texts, shards_=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    total = Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards_
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def test_shards(spark, docs):
    rows = shards.shard(docs).collect()
    texts = collected(docs)
    total = check_shards(rows, texts)
    largest = max(len((t or "").encode()) for _, t in texts) + 1
    mean = sum(total.values()) / 8
    assert max(total.values()) - mean <= largest and mean - min(total[s] for s in range(8)) <= largest


def test_shards_with_a_hot_text(spark):
    texts = [(i, "same text for all" if i % 3 else f"own {i} " * (i % 20)) for i in range(3000)]
    rows = shards.shard(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    total = check_shards(rows, texts)
    assert max(total.values()) < 1.05 * min(total.values())
    assert not shards.shard(spark.createDataFrame([], "doc_id long, text string")).collect()


# -- repeated strings


def repeats(rows, n=400):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(hash(b[a : a + n]) for a in range(len(b) - n + 1))
    out = defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - n + 1):
            if count[hash(b[a : a + n])] > 1:
                gone[a : a + n] = b"\1" * n
        spans = sum(1 for a in range(len(b)) if gone[a] and not (a and gone[a - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i].append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 32), (64, 16)])
def test_suffix_dedup(spark, docs, length, gram):
    want = repeats(collected(docs), length)
    got = by_id(suffixes.digest(docs, length, gram))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(x[:4] for x in v) for i, v in want.items()}
    out = suffixes.remove_repeats(docs, length, gram)
    assert out.columns == docs.columns
    kept = defaultdict(list)
    for r in out.collect():
        kept[r.doc_id].append(r.text)
    for i, v in want.items():
        assert sorted(x or "" for x in kept[i]) == sorted(x[4].decode(errors="ignore") for x in v)
    assert kept[10_000] == [None]


@pytest.mark.parametrize("part", [2, 7, 40])
def test_suffix_dedup_in_small_parts(spark, monkeypatch, part):
    """Strings that many texts share, in one surrounding, in two and in many, whose places are put together part by part."""
    monkeypatch.setattr(suffixes, "_PART", part)
    r = random.Random(part)
    fresh = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    hot, framed, pair = fresh(150), [fresh(40) + fresh(90) + fresh(40) for _ in range(2)], fresh(120)
    texts = [fresh(r.randrange(60)) + hot[r.randrange(30) :] + fresh(r.randrange(60)) for _ in range(60)]
    texts += [fresh(5) + r.choice(framed) + fresh(5) for _ in range(20)] + [pair + fresh(70), fresh(70) + pair] + [fresh(300) for _ in range(5)] + texts[:4]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_id(suffixes.digest(df, 64, 16))
    assert got == {i: [x[:4] for x in v] for i, v in repeats(rows, 64).items()}


def test_suffix_dedup_empty_and_bad(spark, docs):
    assert not suffixes.digest(docs.limit(0)).collect()
    with pytest.raises(ValueError):
        suffixes.Refinement(400, 30)


def without_passages(rows, n=400, passage=51):
    """Texts without strings of n bytes and without passages of so many words that occur twice, by brute force."""
    split = re.compile(rb"[^\x20\x09-\x0d]+")
    data = [(t or "").encode() for _, t in rows]
    places = [[m.span() for m in split.finditer(b)] for b in data]
    spell = [[b[s:e] for s, e in p] for b, p in zip(data, places)]
    strings = Counter(hash(b[a : a + n]) for b in data for a in range(len(b) - n + 1))
    passages = Counter(hash(tuple(w[a : a + passage])) for w in spell for a in range(len(w) - passage + 1))
    copies, out = Counter(data), defaultdict(list)
    for (i, _), b, p, w in zip(rows, data, places, spell):
        gone = bytearray(len(b))
        for a in range(len(b) - n + 1):
            if strings[hash(b[a : a + n])] > 1:
                gone[a : a + n] = b"\1" * n
        hit = bytearray(len(w) + 1)
        for a in range(len(w) - passage + 1):
            if passages[hash(tuple(w[a : a + passage]))] > 1:
                hit[a : a + passage] = b"\1" * passage
        for a, (s, e) in enumerate(p):
            if hit[a]:
                e = p[a + 1][0] if hit[a + 1] else e
                gone[s:e] = b"\1" * (e - s)
        if copies[b] > 1 and (len(b) >= n or len(w) >= passage):
            gone = b"\1" * len(b)
        out[i].append(bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"))
    return out


def test_passages_of_words(spark, docs):
    r = random.Random(8)
    fresh = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    short, less, tiny, wrapped = fresh(51), fresh(50), "a " * 20 + fresh(31), fresh(60)
    plant = [(f"{fresh(40)} {p} {fresh(k)}", f"{fresh(k)}\n{q}\t{fresh(40)}") for k, (p, q) in enumerate([(short, short), (less, less), (tiny, tiny), (wrapped, wrapped.replace(" ", "\n"))], 30)]
    assert len(short) < 450 and len(tiny) < 400
    texts = [t for pair in plant for t in pair] + ["x y " * 60, " " + "a b c " * 17, " " + "a b c " * 17]
    more = spark.createDataFrame([(20_000 + i, t, None) for i, t in enumerate(texts)], docs.schema)
    every = docs.unionByName(more)
    got = defaultdict(list)
    for row in suffixes.remove_repeats(every, passage=51).collect():
        got[row.doc_id].append(row.text or "")
    want = without_passages(collected(every))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert got[20_002] == [plant[1][0]] and got[20_003] == [plant[1][1]]


def passage_words(rows, passage=51):
    """Words of each text in runs of so many that occur twice, by brute force."""
    spell = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in rows]
    count = Counter(hash(tuple(w[a : a + passage])) for w in spell for a in range(len(w) - passage + 1))
    out = defaultdict(list)
    for (i, _), w in zip(rows, spell):
        hit = bytearray(len(w))
        for a in range(len(w) - passage + 1):
            if count[hash(tuple(w[a : a + passage]))] > 1:
                hit[a : a + passage] = b"\1" * passage
        out[i].append(sum(hit))
    return out


def test_suffix_query_reports_passages(spark, docs):
    """Removal goes by bytes, and passages of over 50 words are counted besides."""
    r = random.Random(12)
    fresh = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    short, less, copied = fresh(51), fresh(50), fresh(60)[:390]
    texts = [f"{fresh(90)} {short} {fresh(20)}", f"{fresh(3)} {short}", f"{less} {fresh(9)}", f"{fresh(9)} {less}", copied, copied, short + " " + fresh(80), ""]
    every = docs.unionByName(spark.createDataFrame([(30_000 + i, t, None) for i, t in enumerate(texts)], docs.schema))
    rows = collected(every)
    want, words = repeats(rows), passage_words(rows)
    got = by_id(suffixes.digest(every, passage=51))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted((*x[:4], n) for x, n in zip(v, words[i])) for i, v in want.items()}
    assert got[30_000][0][1:3] == (0, 0) and got[30_000][0][4] == 51 and got[30_002][0][4] == 0 and got[30_004][0][4] == len(copied.split())


def test_columns_of_any_name(spark, docs):
    """Helpers' own column names among the input's."""
    names = ["_name", "_data", "_place", "_spans", "_hits", "_id", "_items", "_lang", "_score", "_label", "text_", "_words"]
    wide = docs.limit(40).unionByName(docs.where("doc_id >= 10000"))
    for n in names:
        wide = wide.withColumn(n, F.lit(n))
    wide = wide.withColumn("lang", F.lit("en")).cache()
    bench = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    outs = [suffixes.remove_repeats(wide, passage=51), decontaminate.clean(wide, bench), decontaminate.clean(wide, bench, block_bytes=1500), corpus_pipeline.language_id(spark, wide, ""), corpus_pipeline.repeated_passages(spark, wide, ""), corpus_pipeline.decontamination(spark, wide, f"{DATA}/sf0.001"), jaccard.keep_one(wide, k=5, percent=80)]
    for out in outs:
        assert out.columns == wide.columns
        assert all(r[n] == n for r in out.collect() for n in names)


def test_shards_of_repeated_rows(spark):
    """A row that occurs thousands of times is parted too."""
    rows = [(1, "the same row")] * 4000 + [(2, None)] * 10
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = check_shards(got, rows)
    assert len(total) == 8 and max(total.values()) < 1.05 * min(total.values())
    few = shards.shard(spark.createDataFrame([(i, f"text {i}") for i in range(7)], "doc_id long, text string"), range_rows=2).collect()
    check_shards(few, [(i, f"text {i}") for i in range(7)])


def test_ranges_in_proportion(spark):
    """Many ranges give the same kind of result."""
    texts = [(i, f"own {i} " * (1 + i % 20)) for i in range(3000)]
    got = shards.shard(spark.createDataFrame(texts, "doc_id long, text string"), range_rows=1).collect()
    total = check_shards(got, texts)
    assert max(total.values()) < 1.02 * min(total.values())


# -- the pipeline


def test_pipeline_keeps_short_documents_in_doubt(spark, monkeypatch):
    """A model that gives four languages 0.25 each rejects only what has no letter."""
    model = language.Model(["de", "en", "es", "fr"], np.ones(1 << 16), np.zeros((1 << 16, 4)), 1.0, 16)
    monkeypatch.setattr(language, "fit", lambda docs: model)
    texts = ["Thtion.", "Re. Esea 4566095658496433 of at.", "é", "12 34", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [0, 1, 2]


def test_pipeline_cuts_short_passages(spark):
    """51 words of under 400 bytes that two otherwise different documents share; 50 words stay."""
    r = random.Random(9)
    fresh = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    passage, less = fresh(51), fresh(50)
    assert len(passage.encode()) < 400
    a, b, c, d = (fresh(200) for _ in range(4))
    texts = [f"{a} {passage} {b}", f"{c} {passage} {d}", f"{d[:300]} {less} {a[:300]}", f"{b[:300]} {less} {c[:300]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got[0] == f"{a}  {b}" and got[1] == f"{c}  {d}"
    assert less in got[2] and less in got[3]


def test_pipeline_stages(spark):
    """Each stage on its own input against what brute force says of that input."""
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert len(after) >= 0.98 * len(before)
        elif i == 1:
            want = components([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == {v[1] for v in want.values()}
        elif i == 2:
            want = without_passages([(r.doc_id, r.text) for r in before])
            assert {r.doc_id: r.text for r in after} == {k: v[0] for k, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in after)
        elif i == 3:
            win = windows(bench)
            assert ids == {r.doc_id for r in before if not hits(r.text, win)[4]}
        else:
            assert ids == {r.doc_id for r in before}
            check_packed(after, 2048)
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)
