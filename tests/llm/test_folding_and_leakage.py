"""Equal-looking texts, and test passages in a corpus, against brute force."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest

from gristmill.llm import leakage as K
from gristmill.llm.folding import Folder, same_look_classes, same_look_pairs, with_folded

SAME = [
    ("ｍｅ ＡＢＣ １２", "me ABC 12"), ("café", "café"), ("so­ft​ly﻿", "softly"), ("a b　c d", "a b c d"),
    ("ﬁne ﬂat", "fine flat"), ("раssіоn", "passion"), ("10 µm", "10 μm"), ("a\r\nb\rc", "a\nb\nc"), ("ⅰⅿ Ⅻ", "im XII"), ("K", "K"),
    ("e​́", "é"), ("ό", "ó"), ("qu‍ite", "quite"),
    ("a\u2028b\x85c\x0bd\x0ce\u2029", "a\nb\nc\nd\ne\n"), ("a\u3164b\ufe00c\ufe0ed\u180be\U000e0041f\ufff9g", "abcdefg"), ("\u13aaB", "AB"), ("non\u2011stop", "non-stop"),
    ("\ufee7\ufead", "\u0646\u0631"), ("\ufdf2", "\u0627\u0644\u0644\u0647"), ("12\ufe0f", "12"), ("\ua4d0\ua4ee", "BA"), ("\ufb13", "\u0574\u0576"),
]
DIFFERENT = [
    ("m²", "m2"), ("½", "1/2"), ("Case", "case"), ("café", "cafe"), ("a b", "a\nb"), ("a  b", "a b"), ("👩‍🔧", "👩🔧"), ("a!", "a"), ("H₂O", "H2O"),
    ("\u2764\ufe0f", "\u2764"), ("\U0001f3f4\U000e0067\U000e007f", "\U0001f3f4"), ("1\ufe0f\u20e3", "1\u20e3"), ("\u0424", "O"), ("a-b", "a\u2013b"),
]


def fold(*texts):
    return Folder().fold(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    x, y = fold(a, b)
    assert x == y


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_look(a, b):
    x, y = fold(a, b)
    assert x != y


def test_folding_twice_changes_nothing():
    rng = random.Random(8)
    alphabet = "".join(a for a, _ in SAME) + "abc ȩ́́‍👩"
    texts = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(500)]
    once = fold(*texts)
    assert fold(*once) == once and all(unicodedata.is_normalized("NFC", t) for t in once)


def test_pairs(spark):
    rows = [(1, "ﬁne day"), (2, "fine day"), (3, "fine day"), (4, None), (5, ""), (6, " ​"), (7, "​ "), (8, "fine day"), (2, "fine day"), (9, "Fine day")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, __f string, __k int").repartition(3)
    got = {(r.id_a, r.id_b) for r in same_look_pairs(df, "id", "text").collect()}
    assert got == {(1, 2), (1, 3), (1, 8), (2, 8), (3, 8)}
    assert same_look_pairs(df.limit(0), "id", "text").count() == 0
    rows = same_look_classes(df, "id", "text").collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 8] and len({r.class_id for r in rows}) == 1
    assert len({r.stored_id for r in rows}) == 3


def test_column(spark):
    df = spark.createDataFrame([(1, "ﬁ" * 200_000), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.to for r in with_folded(df, "text", "to").collect()}
    assert got == {1: "fi" * 200_000, 2: None, 3: ""}
    with pytest.raises(ValueError):
        with_folded(df, "text", "id")


def brute(docs, items, span):
    cut = lambda rows: [(i, re.findall(r"[^\W_]+", (t or "").casefold())) for (i, _), t in zip(rows, fold(*[t for _, t in rows]))]
    out = {}
    tests = cut(items)
    for d, w in cut(docs):
        for i, v in tests:
            best, last = 0, [0] * (len(v) + 1)
            for x in w:
                row = [0] + [last[b] + 1 if x == y else 0 for b, y in enumerate(v)]
                best, last = max(best, *row), row
            if best >= span:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_leaks(spark, broadcast):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(8)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 2:
            q = rng.choice(items[:8])[1].split()
            a = rng.randint(0, 12)
            part = q[a : a + rng.randint(8, 13)]
            w[5:5] = [x.upper() + rng.choice([",", "", "​", "\n"]) for x in part]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "w1 " * 30_000), (1, docs[1][1])]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item string").repartition(4)
    tests = spark.createDataFrame([(i, q, 1) for i, q in items], "item_id long, question string, doc_id long")
    got = {(r.doc_id, r.item_id): r.words for r in K.leaked(df, "doc_id", "text", tests, "item_id", "question", broadcast_words=broadcast).collect()}
    want = brute(docs, items, 10)
    assert got == want and len(want) > 10


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tests = spark.createDataFrame([], "item_id long, question string")
    assert K.leaked(docs, "doc_id", "text", tests, "item_id", "question").count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert K.leaked(some, "doc_id", "text", tests, "item_id", "question").count() == 0
