import math
import zlib

import numpy as np
import pytest

from millrace.llm import kernels as K
from millrace.llm.langid import Model, grams, language_id, tree


def brute_bits(train, text, order=4, least=2):
    """Method C with exclusion, written out over all 256 bytes."""
    counts = {}
    for t in train:
        padded = [32] * order + list(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts.setdefault(tuple(padded[i - k : i]), {}).setdefault(padded[i], 0)
                counts[tuple(padded[i - k : i])][padded[i]] += 1

    def p(context):
        if context is None:
            return [1 / 256] * 256
        parent = p(context[1:] if context else None)
        c = counts.get(context)
        if not c or len(context) > 1 and sum(c.values()) < least:
            return parent
        n, q = sum(c.values()), len(c)
        left = 1 - sum(parent[s] for s in c)
        return [c[s] / (n + q) if s in c else q / (n + q) * parent[s] / left for s in range(256)]

    padded = [32] * order + list(text)
    return sum(-math.log2(p(tuple(padded[i - order : i]))[padded[i]]) for i in range(order, len(padded)))


def test_code_lengths_match_brute_force(monkeypatch):
    train = {"b": [b"xyzzy plugh", b"a", "\u0436\u0443\u043a \u0436\u0443\u043a".encode()], "a": [b"abracadabra abba", b"cab", b"", b"abracadabra"]}
    trees = {}
    for l, texts in train.items():
        offsets = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        trees[l] = tree(*np.unique(grams(data, np.unique(offsets[:-1][offsets[1:] > offsets[:-1]]), 0, len(data)), return_counts=True))
    m = Model(trees)
    texts = [b"abba", b"", b"zzz plugh cab", b"q", b"\xff\x00" * 3, "\u0436\u0443\u043a".encode(), b"", b"abracadabra " * 9]
    offsets = np.cumsum([0, *map(len, texts)])
    for at_once in (1 << 19, 7):  # texts may be cut anywhere
        monkeypatch.setattr(K, "SLICE_BYTES", at_once)
        got = m.code_lengths(offsets, np.frombuffer(b"".join(texts), np.uint8))
        for i, t in enumerate(texts):
            for l, name in enumerate("ab"):
                assert got[i, l] == pytest.approx(brute_bits(train[name], t), rel=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id(docs).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, "the quick brown fox", "en") for i in range(9)] + [(i + 20, "der schnelle braune fuchs", "de") for i in range(9)] + [(50, None, "en"), (51, "", None), (52, "123 !?", "de"), (None, "the fox", None), (53, "the", "en"), (53, "the", "en"), (54, "der " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as score", "2 as held_out")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id(df).collect())
    assert len(got) == len(rows)
    assert {("50", "und"), ("51", "und"), ("52", "und"), ("None", "en"), ("54", "de")} <= set(got) and got.count(("53", "en")) == 2
    nothing = language_id(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).collect()
    assert [tuple(r)[2:4] for r in nothing] == [("und", 0.0)]
    assert language_id(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_many_languages_and_scripts(spark):
    rng = np.random.default_rng(8)
    scripts = ["abcdefghij", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a", "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341"]
    words = {f"{s}{k}": ["".join(rng.choice(list(letters), 5)) for _ in range(40)] for s, letters in enumerate(scripts) for k in range(12)}
    rows = [(i * len(words) + j, " ".join(rng.choice(words[l], 12)), l) for i in range(12) for j, l in enumerate(words)]
    got = language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {d: l for d, _, l in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.held_out) >= 0.98 * sum(r.held_out for r in got)


def test_a_very_long_text():
    data = np.frombuffer(b"the quick brown fox " * 1_000_000, np.uint8)
    m = Model({"en": tree(*np.unique(grams(data[:2000], np.array([0]), 0, 2000), return_counts=True))})
    assert 0 < m.code_lengths(np.array([0, len(data)]), data)[0, 0] < len(data)
