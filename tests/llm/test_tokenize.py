import random

import pytest

from codeweft.llm.automaton import Automaton, load
from codeweft.llm.tokenize import decode, default_ranks, encode, token_counts

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    a = load(default_ranks())
    return a, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=a.ranks, special_tokens={})


def test_random_texts_against_the_public_library(pair):
    a, enc = pair
    rnd = random.Random(5)
    bits = ["a", "aa", "aaa", "b", "th", " the", "in", "ing", "é", "ß", "日本", "1", "12", "-", "==", "\n", "\r\n", "\t", "  ", "'s", "'ll", "\u200b", "\xa0", "🙂", "_", "\x00", "\x1c", "<|endoftext|>", "\u3000"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        assert a.encode(t) == enc.encode_ordinary(t)
        assert a.decode(a.encode(t)) == t


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, "=" * 5000, "\n" * 3000 + "x", "é" * 4000, "x" * 80_000, "", "9" * 3000])
def test_long_words(pair, text):
    a, enc = pair
    assert a.encode(text) == enc.encode_ordinary(text)


def test_every_token_spells_itself(pair):
    a, enc = pair
    for token, rank in list(a.ranks.items())[::37]:
        assert a.encode_word(token) == [rank] == [enc.encode_single_token(token)]


def test_a_tiny_vocabulary_by_its_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"abc": 259, b"aaaa": 260}

    def by_merges(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    a = Automaton(ranks).compile()
    rnd = random.Random(2)
    for _ in range(2000):
        w = bytes(rnd.choice(b"aabc") for _ in range(rnd.randint(1, 12)))
        assert a.encode_word(w) == by_merges(w)


def test_columns(spark, pair):
    a, enc = pair
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (4, "<|endoftext|>", "x"), (5, " " * 700, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode(df).collect())
    assert got == sorted((i, enc.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(x) for i, x in got}
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert encode(df.limit(0)).count() == 0
    assert encode(df, ranks=P.path("byte_bpe_multi_50k.tiktoken")).count() == 6
