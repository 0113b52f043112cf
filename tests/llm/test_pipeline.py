import zlib
from collections import Counter

import numpy as np
from test_decontaminate import brute as brute_items
from test_mixing import water
from test_simhash import brute_groups
from test_tokens import plain

from millrace.llm.storage import Work
from millrace.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    steps, work = [docs], Work(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        steps.append(work.keep(stage(spark, steps[-1], SF), "stage"))
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    assert all(s.schema.simpleString() == docs.schema.simpleString() for s in steps[1:-1])

    toxic = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] not in toxic)
    heads = {c for *_, c in brute_groups([r[:2] for r in rows[1]])}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in heads)
    held = {d for d, _ in brute_items([r[:2] for r in rows[2]], bench)}
    assert held and sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in held)

    count = lambda t: len(t.split())
    before, after = Counter(), Counter()
    for r in rows[3]:
        before[r[3]] += count(r[1])
    for r in rows[4]:
        after[r[3]] += count(r[1])
    most = max(count(r[1]) for r in rows[3])
    assert all(abs(after[s] - t) <= most / 2 + 1 for s, t in water(before).items())
    assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 3

    ids = plain([r[1] for r in sorted(rows[4])])
    want = [(r[0], len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for r, i in zip(sorted(rows[4]), ids)]
    got = sorted(rows[5], key=lambda r: r[1])
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
