import math

import numpy as np

from millrace.llm.ann import Block, nearest, nearest_every


def brute(rows, every=20, k=20):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            best = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w in ok.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = brute(rows)
    for options in ({}, {"block_rows": 300, "query_rows": 40}):
        got = grouped(nearest_every(df, **options))
        assert recall(got, want) >= 0.95 and all(len(g) == 20 for g in got.values())
        scores = {(q, i): s for q, w in brute(rows, k=len(rows)).items() for i, s in w}
        assert all(s == scores[q, i] for q, g in got.items() for i, s in g)


def test_norms_that_differ_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * rng.lognormal()).tolist()) for i in range(600)] + [(i, [1.0] * 8) for i in range(600, 900)]
    got, want = grouped(nearest_every(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))), brute(rows)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[620]][-1] <= [i for i, _ in want[620]][-1]


def test_sizes_at_the_edge_of_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * 10.0 ** rng.choice([-150, 0, 150])).tolist()) for i, v in enumerate(rng.standard_normal((400, 6)))]
    got, want = grouped(nearest_every(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))), brute(rows)
    assert recall(got, want) >= 0.9
    same = [(i, [0.3, 0.4]) for i in range(100)] + [(i, [1e-3 * i, -1.0]) for i in range(100, 140)]
    assert grouped(nearest_every(spark.createDataFrame(same, "vec_id bigint, embedding array<double>")))[20] == brute(same)[20]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank", "2 as query_id")
    assert grouped(nearest_every(df)) == brute(dict(rows).items())
    assert nearest_every(df.limit(0)).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_the_windows_miss_less_than_one_in_a_hundred(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 64))
    near = centres[rng.integers(0, 40, 6000)] + 0.7 * rng.standard_normal((6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id bigint, embedding array<double>")
    want = brute([(i, v.tolist()) for i, v in enumerate(near)], every=60)
    assert recall(grouped(nearest_every(df, every=60)), want) >= 0.99


def test_few_rows_are_verified():
    rng = np.random.default_rng(5)
    for n in (4000, 16000):
        x = rng.standard_normal((n, 64))
        x /= np.sqrt((x * x).sum(1))[:, None]
        block = Block(np.arange(n), x, 256, 0.6, 11)
        asked = np.arange(0, n, n // 12)
        got = list(block.search(asked, x[asked], 20, 1.05, 2.6))
        assert np.mean([checked for *_, checked in got]) < 0.5 * n
        hits = [len(set(ids) & set(np.argsort(-(x @ x[q]), kind="stable")[1:21])) / 20 for (i, ids, _, _), q in zip(got, asked)]
        assert np.mean(hits) >= 0.95


def test_rows_of_one_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 2.0]), (2, [0.5, 1.0]), (0, [1.0, 1.0]), (0, [3.0, 0.0])]
    got = grouped(nearest_every(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert got == {0: [(2, 1.5), (1, 1.0)]}
