import numpy as np

from millrace.llm.toxicity import label_model, toxicity


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    out = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    hit, caught = sum(t == p == 1 for t, p in out), sum(p for _, p in out)
    assert hit / caught > 0.97 and hit / sum(t for t, _ in out) > 0.7
    assert sum(p for t, p in out if t == 0) <= 0.005 * len(out)


def test_label_model_finds_rates_and_shares_weight():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    a, b = (np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.01) for _ in range(2))
    labels = np.where(rng.random(4000) < 0.1, ~y, y).astype(int)
    post, rates, weight, label_rate = label_model(np.stack([a, b, b], 1), labels)
    assert np.abs(rates[1] - 0.6).max() < 0.08 and rates[0].max() < 0.05
    assert weight[0] > 0.8 and abs(weight[1] - 0.5) < 0.05
    assert ((post > 0.5) == y).mean() > ((labels == 1) == y).mean()
    assert abs(label_rate[1] - 0.9) < 0.05


def test_odd_rows_and_no_labels(spark):
    rows = [(1, "what an idiot you are"), (2, None), (3, ""), (None, "a kind word"), (4, "IDIOT " * 50_000), (4, "IDIOT " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as toxic", "2 as score")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = sorted((str(r.doc_id), r.predicted) for r in toxicity(docs, none).collect())
    assert got == [("1", 1), ("2", 0), ("3", 0), ("4", 1), ("4", 1), ("None", 0)]
    some = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity(docs, some).count() == 6 and toxicity(docs.limit(0), some).count() == 0
