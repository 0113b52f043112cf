import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm.suffix import remove_repeats, repeated_starts


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raw):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as h")
    return sorted((tuple(r)[:5] + (bytes(r.kept),) for r in remove_repeats(df, **options).collect()), key=str)


@pytest.mark.parametrize("crowded", [4096, 1])
def test_tables_match_brute_force(spark, crowded):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(230))
    rows += [(1000 + i, "".join(rng.choice("xyzö ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 30) :] + str(i)) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 199), (2003, "b" * 200), (2004, "c" * 201), (2005, "ab" * 900), (None, passage), (2006, "z" * 5000), (2007, "unique " + "z" * 400)]
    rows += [(2008, rows[0][1]), (2008, rows[0][1])]
    assert run(spark, rows, crowded=crowded) == brute(rows, 200)


def test_other_lengths(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    assert run(spark, rows, length=64) == brute(rows, 64)
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=20)


@pytest.mark.parametrize("length", [3, 8, 20])
def test_transform_against_brute_force(length):
    rng = random.Random(length)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab\xf4") for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 9))]
        seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        got = repeated_starts(pieces, length)
        assert [g.tolist() for g in got] == [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]
    assert np.concatenate(repeated_starts([b"abcdefgh" * 4], 3)).any()


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_texts_are_read_in_parts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 << 20))
    cut = (1 << 19) - 120  # across the border of two parts
    rows = [(1, long), (2, "x" + long[cut : cut + 250] + "y"), (3, long[-300:] + "!"), (4, "z" * 150)]
    got = {r[0]: r for r in run(spark, rows)}
    assert [got[d][2:4] for d in (1, 2, 3, 4)] == [(550, 2), (250, 1), (300, 1), (0, 0)]
    assert got[1][5] == (long[:cut] + long[cut + 250 : -300]).encode()


def test_anchors_do_not_depend_on_what_is_around():
    from millrace.llm.suffix import segments, windows

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 1 << 19, dtype=np.uint8)
    whole = segments(np.array([0, len(data)]), data, 200)
    part = segments(np.array([0, 5000]), data[1000:6000], 200)
    anchors = {(a + k): h for h, a, n in zip(whole[0].tolist(), whole[2].tolist(), whole[3].tolist()) for k in range(n)}
    assert all(anchors[1000 + a + k] == h for h, a, n in zip(part[0].tolist(), part[2].tolist(), part[3].tolist()) for k in range(n))
    assert [len(p) for _, p, _ in windows(np.array([0, 3 << 19]), np.zeros(3 << 19, np.uint8), 200)] == [(1 << 19) + 199] * 2 + [1 << 19]
