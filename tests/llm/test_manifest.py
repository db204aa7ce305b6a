"""Mixing, whitening and manifests against plain Python, and odd tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import common, merkle, mixing, whitening
from tests.conftest import DATA, compare

KIND = "doc_id long, source string, lang string, n_chars long, text string"
#: Null fields, empty and very long texts, repeated rows, equal ids, and texts that lower-casing doesn't change.
ODD = [
    (1, "a", "en", 3, "One two"), (2, "a", "en", 1, None), (2, "a", "en", 1, None), (2, "b", None, None, "Again"), (None, None, "de", 4, "No id"), (None, "z", "de", 4, ""),
    (5, "a", "de", None, "Wörter  \t und\x0bmehr "), (-6, "é", "fr", 9, "Long " * 200_000), (7, "b", "fr", 0, "   "), (8, None, None, 2, "lower"),
]


def odd(spark, more=()):
    df = spark.createDataFrame([*ODD, *more], KIND)
    return df.withColumns({"size": F.lit("x"), "_source": F.lit(1), "tree": F.lit(2), "rows": F.lit(3), "Target": F.lit(4), "n": F.lit(5), "folded": F.lit(6)})


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_merkle_manifest"])
def test_as_in_sql(spark, name):
    got, want = compare(spark, name)
    assert got == want


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), sum(sizes.values()), [s for s in names if sizes[s]]
    while open_ and left > 1e-9:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            out[s] += left * weight[s] / total
            if out[s] >= most * sizes[s]:
                over += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.remove(s)
        left = over
    return out


def check_mix(rows, docs):
    """Every row is there with its size, and is taken whole, up to three times."""
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], len([w for w in (d[4] or "").replace("\t", " ").replace("\x0b", " ").split(" ") if w])) for d in docs)
    assert all(r.taken in [r.size * c for c in range(4)] for r in rows)


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    check_mix(rows, ODD)
    sizes = Counter()
    for d in ODD:
        sizes[d[1]] += len((d[4] or "").split())
    want = sorted((sizes[d[1]], round(water(sizes)[d[1]], 6)) for d in ODD)
    assert sorted((r.source_size, round(r.target, 6)) for r in rows) == want
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd(spark).repartition(7)).collect()))  # runs agree
    assert not mixing.mix(odd(spark).limit(0)).collect()
    blank = mixing.mix(spark.createDataFrame([(1, "a", "en", 0, None), (2, None, "en", 0, " ")], KIND)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("fan", [2, 7, 256])
def test_mix_comes_near_its_targets(spark, fan):
    """Trees of any width and depth; a source holds a third of the rows, another 40 copies of one row."""
    docs = [(i, "hot" if i % 3 else f"s{i % 11}", "en", 0, "w " * (1 + i * 37 % 90)) for i in range(900)] + [(5000, "s0", "en", 0, "copy " * 30)] * 40
    rows = mixing.mix(spark.createDataFrame(docs, KIND), fan=fan).collect()
    source = {d[0]: d[1] for d in docs}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes[s] + r.size, taken[s] + r.taken, r.target
        assert r.taken in [r.size * c for c in range(4)]
    assert len(rows) == len(docs) and all(r.source_size == sizes[source[r.doc_id]] for r in rows)
    want = water(sizes)
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()} and abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 45.5 for s in sizes), [(s, taken[s], want[s]) for s in sizes]


def test_mix_keeps_chances_right(spark):
    """Over many documents of a size, copies follow the ratio, also among the large ones."""
    docs = [(i, "a" if i % 2 else "b", "en", 0, "w " * (1 + i % 2 * 3 + i % 10 // 8 * 40)) for i in range(4000)]
    rows = mixing.mix(spark.createDataFrame(docs, KIND), fan=16).collect()
    for large in (False, True):
        mine = [r for r in rows if r.doc_id % 2 and (r.size > 40) == large]
        ratio = mine[0].target / mine[0].source_size
        assert abs(sum(r.taken / r.size for r in mine) / len(mine) - ratio) < 0.06, large


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(docs, fan=8):
    """The contract, row by row."""
    hash_of = lambda d, text: sha("".join(encoded(v) for v in (*d[:4], text)))
    low = lambda d: d[4] if d[4] is None or d[0] is None or zlib.crc32(str(d[0]).encode()) % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    groups = sorted({d[2] for d in docs}, key=lambda g: (g is not None, (g or "").encode()))
    rows = {g: sorted((d for d in docs if d[2] == g), key=lambda d: (d[0] is not None, d[0] or 0, hash_of(d, d[4]))) for g in groups}
    trees = {g: tree([hash_of(d, d[4]) for d in rows[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for o, g in enumerate(groups):
        for p, d in enumerate(rows[g]):
            fold, proof = hash_of(d, low(d)), ""
            for levels, at in ((trees[g], p), (top, o)):
                for level in levels[:-1]:
                    a = at // fan * fan
                    run = level[a : a + fan]
                    proof += "".join(run[: at - a] + run[at - a + 1 :])
                    fold, at = sha("".join([*run[: at - a], fold, *run[at - a + 1 :]])), at // fan
            out.append((d[0], hash_of(d, d[4]), trees[g][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [0, 4, 4096])
def test_manifest_of_odd_rows(spark, most):
    """Trees of one leaf, of one more than a full run, and of many; all levels by join, some, and all by broadcast."""
    more = [(i, "s", "xx", i, f"Text {i} {'UP' * (i % 2)}") for i in range(9)] + [(i, "s", "yy", i, f"Text {i}") for i in range(200, 333)] + [(3, "s", f"l{i}", 1, "T") for i in range(70)]
    got = merkle.verify(odd(spark, more), {"text": merkle.tampered()}, most_broadcast=most).collect()
    want = manifest([*ODD, *more])
    assert sorted(map(tuple, got), key=repr) == want and {w[-1] for w in want} == {True, False}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"  # as it was


def test_manifest_of_few_rows(spark):
    change = {"text": merkle.tampered()}
    for docs in ([], [(3, "s", None, 1, "One")], [(0, "s", "a", 1, "One"), (3, "s", "b", 1, "Two")], [(i, None, "a", None, None) for i in range(8)]):
        got = merkle.verify(spark.createDataFrame(docs, KIND), change).collect()
        assert sorted(map(tuple, got), key=repr) == (manifest(docs) if docs else [])


def test_untampered_rows_are_verified(spark):
    rows = merkle.verify(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.verified for r in rows)


def plain(rows, count=32):
    """Whitening in numpy: (deviation, whitened up to sign, explained) of each kept (key, vector)."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(count, int((e > 1e-12 * e[0]).sum()))
    return n, ((n * x - s) ** 2).sum(1), c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_white(got, rows, count=32):
    n, far, white, share = plain(rows, count)
    assert len(got) == len(rows) * white.shape[1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i, (key, _) in enumerate(rows):
        mine = sorted(by[key], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, white.shape[1] + 1)) and {(r.n, r.deviation) for r in mine} == {(n, far[i])}
        np.testing.assert_allclose(np.abs([r.whitened for r in mine]), np.abs(white[i]), atol=1e-6)
        np.testing.assert_allclose([r.explained for r in mine], share, rtol=1e-6)
    assert all(r.identity_error <= 1e-4 for r in got)
    signed = np.array([[r.whitened for r in sorted(by[k], key=lambda r: r.component)] for k, _ in rows])
    np.testing.assert_allclose(signed.T @ signed / n, np.eye(signed.shape[1]), atol=1e-6)


def test_whitening_against_numpy(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_white(whitening.whiten(table).collect(), rows)


def test_whitening_of_odd_rows(spark):
    """Null and non-finite vectors drop out; a third of the rows share one; columns may clash."""
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).round(3).tolist()) for i in range(60)] + [(100 + i, [0.5, -0.25, 0.0, 1.0, -1.0]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (204, [float("inf")] * 5), (205, [1.0, 2.0])]
    df = spark.createDataFrame([*good, *bad], "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "rows": F.lit(2), "n": F.lit(3), "Component": F.lit(4), "_key": F.lit(5)})
    check_white(whitening.whiten(df, components=3).collect(), [(k, [float(np.float32(c)) for c in v]) for k, v in good], 3)
    assert not whitening.whiten(df.limit(0)).collect() and not whitening.whiten(df.where("vec_id >= 100")).collect()


def test_whitening_of_flat_and_far_vectors(spark):
    """A dimension that never varies has no component; what is no long is null; equal keys keep their rows."""
    rng = np.random.default_rng(2)
    rows = [(i, [*rng.normal(size=3).tolist(), 7.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3}
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (1, [-3e38, 2.0]), (None, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 3 and all(r.identity_error < 1e-4 for r in far)  # beside it the other dimension is rounding
    assert {r.deviation is None for r in far} == {True, False}
    assert whitening.deviations(np.array([[1 << 40, 0], [1, 0]]), 2, np.array([0, 0])) == [None, 4]


def test_places_over_a_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 % 300).alias("a"), "id")
    got = common.ranked(df, [F.asc("a"), F.asc("id")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)


def test_package_is_served_whole():
    """Executors get every module of the package, so they need no copy of its folder."""
    import zipfile
    from pathlib import Path

    package = Path(common.__file__).resolve().parents[1]
    with zipfile.ZipFile(common.archive()) as z:
        assert set(z.namelist()) == {str(p.relative_to(package.parent)) for p in package.rglob("*.py")} and "loomlake/llm/common.py" in z.namelist()
