"""Packed fields against a character-by-character reading, and the edge cases."""

import random
import re

from gristmill.operators.packed import CATEGORY, REVIEWS, Packing, unpack

SPACE = " \t\n\r\x0b\x0c\xa0　"


def brute(text, delimiter):
    """Read one value after another; an enclosing quote must be followed by a delimiter or the end."""
    d = re.compile(delimiter)
    out, at = [], 0
    while text is not None and at <= len(text):
        start = at
        while start < len(text) and text[start] in SPACE:
            start += 1
        end = None
        if start < len(text) and text[start] == '"':
            i = start + 1
            while i < len(text):
                if text[i] == '"':
                    if i + 1 < len(text) and text[i + 1] == '"':
                        i += 2
                        continue
                    j = i + 1
                    while j < len(text) and text[j] in " \xa0　":
                        j += 1
                    if j == len(text) or d.match(text, j):
                        end = j
                    break
                i += 1
        if end is None:
            end = at
            while end < len(text) and not d.match(text, end):
                end += 1
        v = text[at:end].strip(SPACE)
        if len(v) > 1 and re.fullmatch(r'"[^"]*(?:""[^"]*)*"', v):
            v = v[1:-1].replace('""', '"').strip(SPACE)
        if v:
            out.append(v)
        if end == len(text):
            break
        at = d.match(text, end).end()
    return out


def values(spark, texts, packing):
    rows = unpack(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, f string"), "id", {"f": packing}).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.pos, r.item_value))
    for v in got.values():
        assert [p for p, _ in v] == list(range(1, len(v) + 1))
    return [[v for _, v in got.get(i, [])] for i in range(len(texts))]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    for packing, alphabet in ((CATEGORY, 'ab "|>/;,& \n'), (REVIEWS, 'ab "|;~,/ \t\n\r')):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
        for t, got in zip(texts, values(spark, texts, packing)):
            assert got == brute(t, packing.delimiter), repr(t)


def test_quotes(spark):
    got = values(
        spark,
        ['"Audio|Music"|14" Bags', '"he said ""wow""";;x', '"never closed | b', '"a" b|c', '|| a | | "" | b |', "one; two;; three / four, five"],
        REVIEWS,
    )
    assert got == [
        ["Audio|Music", '14" Bags'],
        ['he said "wow"', "x"],
        ['"never closed', "b"],
        ['"a" b', "c"],
        ["a", "b"],
        ["one; two", "three / four, five"],
    ]


def test_brackets(spark):
    assert values(spark, ["[a|b]|c", "[a|b", "x[1]|y"], Packing(r"\|", brackets=True)) == [["a|b", "c"], ["[a", "b"], ["x[1]", "y"]]


def test_null_empty_blank_repeated_and_long(spark):
    long = "x" * 300_000
    quoted = '"' + "y|" * 100_000 + '"'
    many = "; ".join("z" for _ in range(50_000))
    got = values(spark, [None, "", "  \n", "|;|", long, quoted, many], REVIEWS)
    assert got[:4] == [[], [], [], [";"]]
    assert got[4] == [long] and got[5] == [quoted[1:-1]] and got[6] == [many]
    df = spark.createDataFrame([(1, "a|b", 5), (1, "a|b", 6), (1, "a|b", 5)], "id int, f string, item_value int")
    assert unpack(df, "id", {"f": REVIEWS}).count() == 2


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([], "id int, f string")
    assert unpack(df, "id", {"f": REVIEWS}).count() == 0
    df = spark.createDataFrame([(None, "a|b")], "id int, f string")
    assert [r.id for r in unpack(df, "id", {"f": REVIEWS}).collect()] == [None, None]


def test_flags(spark):
    df = spark.createDataFrame([(1, '"a"|"b c|d')], "id int, f string")
    rows = sorted(unpack(df, "id", {"f": REVIEWS}).collect(), key=lambda r: r.pos)
    assert [(r.item_value, r.kind, r.malformed) for r in rows] == [("a", "quoted", False), ('"b c', "bare", True), ("d", "bare", False)]


def test_flags_follow_the_alternative(spark):
    rows = [(1, 'tail"|"a" b|"x""y"|14" x'), (2, '"' + '""' * 60_000 + '"')]
    got = sorted(unpack(spark.createDataFrame(rows, "id int, f string"), "id", {"f": REVIEWS}).collect(), key=lambda r: (r.id, r.pos))
    assert [(r.item_value, r.kind, r.malformed) for r in got[:4]] == [('tail"', "bare", True), ('"a" b', "bare", True), ('x"y', "quoted", False), ('14" x', "bare", False)]
    assert got[4].kind == "quoted" and got[4].item_value == '"' * 60_000


def test_escapes(spark):
    texts = [r'"a \"b\" \\"|c', r'"a ""b"" \| c"|d', r'a\"b|c']
    assert values(spark, texts, Packing(r"\|", escapes=True)) == [['a "b" \\', "c"], ['a "b" | c', "d"], [r'a\"b', "c"]]
