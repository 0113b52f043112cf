import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.textfilter import matches, parse

TEXT = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr."
CASES = [
    ("lore dol", True), ("lorem dolor", True), ("lorem aaaaa", False), ('aaa|dolor -aaa "sit"', True), ('dolor "sit"', True),
    ('"dolor sit" amet "consetetur sadipscing" -"aaaa"', True), ('"dolor sit" amet "consetetur sadipscing" "aaaa"|elitr|"bbbb"', True),
    ("-aaaaa", True), ('-"Lorem ipsum" -aaaa', False), ("aaa|dolor", True), ("aaa|dolor sit|aaa", True), ("aaa|bbb sit|lorem", False),
    ('"aaa"|"sit"', True), ('"aaa"|"dolor sit"', True), ('"aaa"|"dolor sit"|bbb', True), ('"aaa"|"dolor sit"|"bbb"', True),
    ('"aaa"|"dolo"', False), ('"aaa"|"dolor si"', False), ('"ipsum"', True), ('"lorem ipsum"', True), ('"lore"', False), ("lorem", True),
    ("aaaaa", False), ("ips", True), ("psum", True),
    ("", True), ("lorem ", True), ("-", True), ("a|", False), ("|ab", False), ("aaa||dolor", True), ("-aaa|dolor", True),
]


def test_cases(spark):
    df = spark.createDataFrame([(TEXT,)], "text string")
    got = df.select(*[matches("text", f).alias(str(i)) for i, (f, _) in enumerate(CASES)]).first()
    assert [(f, r) for (f, _), r in zip(CASES, got)] == CASES


def test_letters_beyond_ascii_bound_phrases(spark):
    df = spark.createDataFrame([("été chaud",), ("étés chauds",), ("x9 été9",), (None,)], "text string")
    assert [r[0] for r in df.select(matches("text", '"été"')).collect()] == [True, False, False, False]


def test_plain_words_stay_built_in(spark):
    plan = spark.range(1).select(F.lit("a").alias("t")).where(matches("t", "one two"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan.upper()


@pytest.mark.parametrize("seed", range(3))
def test_against_a_small_model(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "b", "abc", "c d", "ca"]

    def holds(text, token):
        if len(token) >= 2 and token[0] == token[-1] == '"':
            body = token[1:-1]
            return any(text.startswith(body, i) and (i == 0 or not text[i - 1].isalnum()) and (i + len(body) == len(text) or not text[i + len(body)].isalnum()) for i in range(len(text) - len(body) + 1))
        return token in text

    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))),) for _ in range(40)], "t string").cache()
    texts = [r.t for r in df.collect()]
    for _ in range(5):
        terms = []
        for _ in range(rng.randint(1, 3)):
            alt = [rng.choice((f'"{w}"', w.replace(" ", ""))) for w in rng.sample(words, rng.randint(1, 2))]
            terms.append(("-" if len(alt) == 1 and rng.random() < 0.3 else "", alt))
        text = " ".join(n + "|".join(a) for n, a in terms)
        want = [all(any(holds(t, w) for w in a) != bool(n) for n, a in terms) for t in texts]
        assert [r[0] for r in df.select(matches("t", text)).collect()] == want, text
    assert parse(None) == []
