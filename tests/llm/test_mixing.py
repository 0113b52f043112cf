import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import mixing
from millrace.llm.mixing import hypergeometric, mix, split_tree
from millrace.llm.storage import Work


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
        free -= over
        left -= sum(out[s] for s in over)
    return out


def check(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((d, s, words(t)) for d, t, s in rows) == Counter((g.doc_id, g.source, g["size"]) for g in got)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want, taken, most = water(dict(sizes)), defaultdict(int), defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source])
        assert g.taken == g["size"] * len(g.draws) and len(g.draws) <= 3 and len({x["pass"] for x in g.draws}) == len(g.draws)
        taken[g.source] += g.taken
        most[g.source] = max(most[g.source], g["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1


def test_targets_are_met(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs).collect()
    check(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(3)).collect()))
    shards = Counter(x.shard for g in got for x in g.draws)
    assert set(shards) == set(range(16))


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "abé\U0001f600"[i % 4] if i % 5 else None) for i in range(300)] + [(1, None, "b"), (None, "x y", None), (4, "x\x0b\x1cy z", "b"), (4, "x\x0b\x1cy z", "b"), (9, "", "empty")]
    check(rows, mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as block", "3 as target")).collect())


def test_one_source_and_empty_table(spark):
    rows = [(i, "a b c", "s") for i in range(50)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert all(g.taken == 3 for g in got)
    assert mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_hypergeometric_law(spark):
    n = 4000
    df = spark.range(n).selectExpr("50D as n", "18D as k", "25D as d", f"(id + 0.5D) / {n} as u")
    got = Counter(int(r[0]) for r in df.selectExpr(hypergeometric("n", "k", "d", "u")).collect())
    from math import comb

    for x in range(19):
        assert abs(got[x] / n - comb(18, x) * comb(32, 25 - x) / comb(50, 25)) < 2 / n
    big = spark.range(2000).selectExpr("3000000D as n", "1000000D as k", "1500000D as d", "(id + 0.5D) / 2000 as u").selectExpr(f"{hypergeometric('n', 'k', 'd', 'u')} as x").toPandas().x
    assert abs(big.mean() - 500_000) < 10 and big.std() == pytest.approx(np.sqrt(1.5e6 * (1 / 3) * (2 / 3) * 0.5), rel=0.02)


def brute_tree(quotas, levels, seed, spark):
    """The tree written out for few sources: at each node the left half of the shards draws from one source after the other."""
    node = {0: dict(quotas)}
    for level in range(levels):
        out = {}
        for shard, have in node.items():
            total = sum(have.values())
            drawn, out[2 * shard], out[2 * shard + 1] = -(-total // 2), {}, {}
            for rank in sorted(have):
                u = f"((pmod(xxhash64({rank}L, {shard}, 0, {level}, {seed}), 4503599627370496) + 0.5D) / 4503599627370496D)"
                k = int(spark.sql(f"SELECT {hypergeometric(f'{total}D', f'{have[rank]}D', f'{drawn}D', u)}").first()[0])
                out[2 * shard][rank], out[2 * shard + 1][rank] = k, have[rank] - k
                total, drawn = total - have[rank], drawn - k
        node = out
    return {(r, s): n for s, have in node.items() for r, n in have.items()}


def test_the_tree_deals_exact_quotas(spark, monkeypatch):
    quotas = {0: 37, 1: 5, 2: 0, 3: 110}
    df = spark.createDataFrame(list(quotas.items()), "rank bigint, n bigint")
    got = {(r["rank"], r.shard): r.n for r in split_tree(df, 4, 2, 20, Work(spark, "test")).collect()}
    assert got == brute_tree(quotas, 2, 20, spark)
    # many sources: children of children
    monkeypatch.setattr(mixing, "FAN", 4)
    many = {i: (i * 7) % 23 for i in range(50)}
    df = spark.createDataFrame(list(many.items()), "rank bigint, n bigint")
    got = split_tree(df, 50, 2, 20, Work(spark, "test")).collect()
    assert len(got) == 200 and all(r.n >= 0 for r in got)
    by_rank, by_shard = Counter(), Counter()
    for r in got:
        by_rank[r["rank"]] += r.n
        by_shard[r.shard] += r.n
    assert all(by_rank[i] == n for i, n in many.items()) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_blocks_of_a_shard_are_disjoint(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 3 > 0]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs, blocks=32).collect()
    drawn = Counter((g.source, g.doc_id, x["pass"]) for g in got for x in g.draws)
    assert max(drawn.values()) == 1  # a pass draws a document for one shard
    from pyspark.sql import functions as F

    block = {r.doc_id: r.b for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(20), "doc_id", "text"), F.lit(32)).alias("b")).collect()}
    of = {}
    for g in got:
        for x in g.draws:
            assert of.setdefault((g.source, block[g.doc_id], x["pass"]), x.shard) == x.shard  # a block goes to one shard whole
    blocks = Counter(of.values())
    assert len(blocks) == 16 and max(blocks.values()) - min(blocks.values()) <= 1
