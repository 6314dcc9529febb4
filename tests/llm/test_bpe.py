"""Byte-pair encoding against the public library and by exact round trip."""

import os
import random

import pytest

from gristmill.llm.bpe import TOKENIZERS, Bpe, corpus_ids, decode, encode_column, load_ranks

PATH = f"{TOKENIZERS}/byte_bpe_50k"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{PATH}.tiktoken"), reason="no vocabulary")
ALPHABET = "ab é½²  \x1c\x85‍\t\n😀ß的Ⅷ'st1 9<|endoftext|>　ʼ"


@pytest.fixture(scope="module")
def bpe():
    return Bpe(load_ranks(f"{PATH}.tiktoken"))


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(5)
    words = ["don't", "we'll", "the", "naïve", "ÇÃO", "12345", "::", "<|endoftext|>", "\r\n"]
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    out += [" ".join(rng.choice(words) for _ in range(12)) for _ in range(500)]
    return out + ["a" * 5000, "ab" * 2000, "", " ", "\n\n"]


def test_against_the_library(bpe, random_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{PATH}.json")
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(random_texts, add_special_tokens=False)]
    assert [bpe.encode(x) for x in random_texts] == want


def test_round_trip(bpe, random_texts):
    strings = bpe.decoder()
    assert all(decode(bpe.encode(x), strings) == x for x in random_texts)


def test_merging_equals_the_plain_loop(bpe):
    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranked = [(bpe.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            if not ranked or min(ranked)[0] == 1 << 30:
                return [bpe.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(6)
    for _ in range(500):
        w = bytes(rng.choice(b"abeinorst \xc3\xa9") for _ in range(rng.randint(1, 30)))
        assert bpe.merge(w) == plain(w) or w in bpe.ranks


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", ""), (4, "word " * 40_000, ""), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "id long, text string, __t string")
    got = {r.id: r.ids for r in corpus_ids(df, "id", "text").collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == [] and len(got[4]) == 40_001
    assert corpus_ids(df.limit(0), "id", "text").count() == 0
    assert dict(corpus_ids(df, "id", "text").dtypes)["ids"] == "array<int>"
    with pytest.raises(ValueError):
        encode_column(df, "text", "id")
