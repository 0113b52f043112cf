import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm.simhash import ball_links, fingerprint, simhash_groups


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids[r] = min(ids.get(r, d), d)
    return sorted((d, f"{f:016x}", ids[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def test_groups_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One two"), (904, "One two"), (905, "é x É y z"), (906, "word " * 50_000), (907, "word " * 49_999)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


@pytest.mark.parametrize("prefix_bits", [4, 10, 16])
def test_ball_links_find_every_close_pair(spark, prefix_bits):
    rng = np.random.default_rng(prefix_bits)
    centres = rng.integers(0, 2**63, 40)
    fps = set(map(int, centres))
    for c in centres[:20]:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(63, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = [tuple(r) for r in ball_links(df, len(fps), 4, prefix_bits, 5).collect()]
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    got = {f: find(f) for f in fps}
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                root[find(a)] = find(b)
    want = {f: find(f) for f in fps}
    assert {frozenset(g for g in fps if got[g] == got[f]) for f in fps} == {frozenset(g for g in fps if want[g] == want[f]) for f in fps}


def test_odd_radius_and_empty_table(spark):
    with pytest.raises(ValueError):
        ball_links(spark.range(0).select(F.col("id").alias("fp")), 0, 3)
    assert simhash_groups(spark.createDataFrame([], "doc_id bigint, text string, fp string, root int")).count() == 0


def test_fingerprint_lower_cases_ascii_only():
    assert fingerprint("ÀB c".encode()) == fingerprint("Àb C".encode()) != fingerprint("àb c".encode())
