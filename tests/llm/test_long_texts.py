"""Suffix dedup of texts that are cut into pieces."""

import hashlib
import random
from collections import Counter

import pytest

from loomlake.llm import suffixes


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize(("in_words", "length"), [(False, 64), (True, 5), (True, 1)])
def test_pieces_hold_each_string_once(monkeypatch, in_words, length):
    monkeypatch.setattr(suffixes, "_PIECE", 500)
    r = random.Random(1)
    texts = [prose(r, n).encode() for n in (3, 150, 400, 2000)] + [b"", b"x" * 3000, b"y " * 2000, b" " * 1500 + b"z", b"long " + b"w" * 5000 + b" end of it " * 99]
    for i, t in enumerate(texts):
        places = t.split() if in_words else [t[k : k + 1] for k in range(len(t))]
        want = {k: places[k : k + length] for k in range(len(places) - length + 1)}
        got = {}
        for p in suffixes.pieces([t], length, in_words):
            own = p.data.split() if in_words else [p.data[k : k + 1] for k in range(len(p.data))]
            assert t[p.at : p.at + len(p.data)] == p.data
            for k in range(min(len(own) - length + 1, p.stop - p.base)):
                assert p.base + k not in got
                got[p.base + k] = own[k : k + length]
        assert got == want, i


def brute(texts, length):
    """Bytes of each text that stay."""
    seen = Counter(hash(t[k : k + length]) for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        kept, end = bytearray(), 0
        for k in range(len(t)):
            if k + length <= len(t) and seen[hash(t[k : k + length])] > 1:
                end = k + length
            if k >= end:
                kept.append(t[k])
        out.append(bytes(kept))
    return out


def test_long_texts_against_brute_force(spark):
    """Repeats within a long text, across its cuts, and between it and short ones."""
    r = random.Random(2)
    long = prose(r, 130_000)
    assert len(long) > 2.4 * suffixes._PIECE
    cut = suffixes._PIECE
    shared = long[cut - 350 : cut + 350]
    texts = [long, prose(r, 60) + shared + prose(r, 60), prose(r, 400_000 // 6) + long[100:900], "ab " * 1000, "short", prose(r, 100) + long[2 * cut - 401 : 2 * cut + 30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([t.encode() for t in texts], 400)
    for row in suffixes.digest(df, passage=51).collect():
        t, w = texts[row.doc_id].encode(), want[row.doc_id]
        assert (row.n_bytes, row.n_removed, row.kept_sha256) == (len(t), len(t) - len(w), hashlib.sha256(w).hexdigest()), row.doc_id
    assert len(want[0]) < len(long) and len(want[2]) < len(texts[2]) and len(want[5]) < len(texts[5])


def test_passages_of_long_texts(spark):
    """Words of repeated passages, by brute force; few of their words are in strings of 400 bytes."""
    r = random.Random(3)
    words = [prose(r, 1)[:3] for _ in range(200_000)]
    passage = words[90_000:90_060]
    texts = [" ".join(words), " ".join([*prose(r, 20).split(), *passage, *prose(r, 20).split()])]
    assert len(texts[0]) > 2 * suffixes._PIECE
    rows = {x.doc_id: x for x in suffixes.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passage=51).collect()}
    assert rows[0].n_passage_words == rows[1].n_passage_words == 60
    left = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passage=51).collect()
    assert [len(x.text.split()) for x in sorted(left, key=lambda x: x.doc_id)] == [200_000 - 60, 40]
