import random

import pytest

from codeweft.llm.quality import STATISTICS, Model, Words, document_statistics, natural, outlier_scores, statistics, tails

COMMON = [("en", w) for w in "the is a of to and in it was that for with not but".split()] + [("de", w) for w in "der die und ist nicht das wir zu".split()] + [("ko", "이"), ("ko", "그래서")]
WORDS = Words(COMMON)
PROSE = "The cache is cold when the first run starts. It was clear that the queue should wait for the lock, but nobody asked for it. "


def share(text):
    return statistics(text, None, WORDS)[2][list(STATISTICS).index("sentence_share")]


@pytest.mark.parametrize(
    "text",
    [PROSE * 3, PROSE.replace(". ", ".\n"), PROSE.lower().replace(".", "\n"), "# " + PROSE.replace(". ", ".\n# "), "/**\n * " + PROSE.replace(". ", ".\n * ") + "\n */", "<p>" + PROSE + "</p>", "> " + PROSE, PROSE.replace("\n", "\r\n"), "Das Haus ist alt und die Tür ist nicht zu. Wir gehen zu der Brücke.", "ca\u200bche: " + PROSE, "Это предложение написано по-русски. Оно короткое."],
)
def test_prose(text):
    assert share(text) > 5000


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n ", "- cold cache\n- warm queue\n* lock", "a,b,c\n1,2,3\n4,5,6", "column\tedge\n1\t2", "queue cache lock. Cache queue anchor lock.", "for i, x in enumerate(y):\n    self.a[i] = b(x)\nif not ok {\n", "    at Foo.bar (/srv/x/y.ts:1:2)\n" * 5, "2025-01-01T00:00:00Z INFO a[1] b=2\n" * 4, "xqz wvk prr tt zk " * 20, "key: value\nother: 1\n", "x" * 100_000],
)
def test_no_prose(text):
    assert share(text) <= 5000


def test_a_table_under_a_sentence_is_mostly_table():
    assert 0 < share("It was clear that the table is long.\n\n" + "alpha;beta;gamma\n1;2;3\n" * 10) < 5000


def test_language_and_empty():
    assert statistics(PROSE, "DE", WORDS)[0] == "en" and statistics("xyz", " De ", WORDS)[0] == "de" and statistics("xyz", "xx", WORDS)[0] == "und"
    assert statistics(None, None, WORDS) == ("und", 0, [0] * len(STATISTICS))


def test_ranks_are_exact(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), rnd.choice([0, 0, 0, 1, 2, 7, 9, 100])) for _ in range(500)] + [("c", 5)]
    counts = spark.createDataFrame(rows, "g string, v int").groupBy("g", "v").count()
    got = {(r.g, r.v): (r.count_at_most, r.count_at_least, r.count_of) for r in tails(counts, ["g"], "v", ["count"]).collect()}
    for (g, v), x in got.items():
        own = [b for a, b in rows if a == g]
        assert x == (sum(b <= v for b in own), sum(b >= v for b in own), len(own))
    assert set(got) == set(rows)


def table(spark, texts):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "EN", 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    return document_statistics(docs, spark.createDataFrame(COMMON, "lang string, word string"))


def test_scores_against_all_documents(spark):
    texts = [PROSE * k for k in range(1, 30)] + ["a,b\n" * 5, None, "", PROSE, PROSE]
    stats = table(spark, texts)
    got = {r.doc_id: r for r in outlier_scores(stats).collect()}
    assert len(got) == len(texts) and all(r.outlier_score >= 0 and r.other_score >= 0 for r in got.values())
    en = [r.log_words for r in got.values() if r.lang_found == "en"]
    assert got[3].low_log_words == pytest.approx(sum(x <= got[3].log_words for x in en) / len(en))
    assert outlier_scores(table(spark, ["x"]).limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert outlier_scores(document_statistics(docs, spark.createDataFrame([], "lang string, word string"))).count() == 1


def test_the_tails_decide(spark):
    """Of two documents with the same share of sentences, the one that lies out in the other statistics isn't prose; and
    what stands between the populations is told by the rest of its statistics."""
    rnd = random.Random(3)
    line = lambda: " ".join(rnd.choice(["the cache", "was cold", "a queue", "that waits", "for it", "not the lock"]) for _ in range(rnd.randint(4, 8))) + "."
    prose = ["\n".join(line() for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    junk = ["\n".join(f"k{rnd.randint(1, 99)}={rnd.randint(1, 10**6)}; x[{rnd.randint(1, 99)}]" for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    half = "\n".join([line(), line(), "k7=123456; x[5]\n" * 4])
    body = [line() for _ in range(5)]
    long = "\n".join(body + ["cold queue lock anchor cache waits"] * 9)
    odd = "\n".join(body + ["[7]=123456;[8]=99001234;{12}={34}"] * 9)
    got = {r.doc_id: r for r in outlier_scores(table(spark, [*prose, *junk, half, odd, long, PROSE.upper(), None])).withColumn("natural", natural(Model(lean=0.0))).collect()}
    assert all(got[i].natural for i in range(300)) and not any(got[i].natural for i in range(300, 600))
    half, odd, long, upper, none = (got[i] for i in range(600, 605))
    assert abs(odd.sentence_share - long.sentence_share) < 600 and 4000 < long.sentence_share < 6500, (odd, long)
    assert long.natural and not odd.natural
    assert not half.natural and upper.natural and not none.natural
