import random
import re

import numpy as np
import pytest

from millrace.llm.kernels import local_roots
from millrace.llm.paragraphs import near_links, paragraph_duplicates, paragraph_report, remove_paragraphs


def shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return {text}
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    paras = [(d, i, p) for d, t in rows for i, p in enumerate(x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))]
    sets = [shingles(p) for *_, p in paras]
    root = list(range(len(paras)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        close = {j for g in s for j in by.get(g, ())}
        for j in close:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                root[find(i)] = find(j)
        for g in s:
            by.setdefault(g, []).append(i)
    first = {}
    for i, (d, k, _) in enumerate(paras):
        key = (d is None, d or 0, k)
        if key < first.get(find(i), ((True, 1 << 60), None))[0] or find(i) not in first:
            first[find(i)] = (key, i)
    keep = {i for _, i in first.values()}
    out = {}
    for i, (d, k, _) in enumerate(paras):
        out.setdefault(d, []).append((k, i in keep))
    return {d: (len(v), sorted(k for k, x in v if not x)) for d, v in out.items()}


@pytest.mark.parametrize("crowded", [4096, 5])
def test_report_matches_brute_force(spark, crowded):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(70)]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(70)] = rng.choice(words)
        rows.append((5000 + i, f"own line {i} of this text here\n" + " ".join(copy) + "\n\n  \nshort\n" + "é" * (i % 3)))
    rows += [(6000, None), (6001, ""), (6002, " \n\t\n"), (None, "short"), (6003, "a b c d e\nA, b; c d e."), (6004, "!!!\n???\n!!!"), (6005, "word " * 80_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as pid", "2 as component")
    found = {}
    for r in paragraph_duplicates(df, crowded=crowded).collect():
        found.setdefault(r.doc_id, []).append((r.place, r.keep))
    assert {d: (len(v), sorted(k for k, x in v if not x)) for d, v in found.items()} == brute(rows)


def test_report_and_texts(spark):
    rows = [(1, "one two three four five six\nkeep me here now please"), (2, "x\n\none two three four five six\ny"), (3, "one  TWO three, four five six")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r)[:6] for r in paragraph_report(df).collect()) == [(1, 2, 1, 0, [], []), (2, 3, 1, 1, [1], [1]), (3, 1, 1, 1, [0], [1])]
    assert sorted((r.doc_id, r.text) for r in remove_paragraphs(df).collect()) == [(1, rows[0][1]), (2, "x\n\ny"), (3, "")]
    assert paragraph_report(df.limit(0)).count() == 0
    twice = spark.createDataFrame(rows[:1] * 2, "doc_id bigint, text string")
    assert sorted(r.n_removed for r in paragraph_report(twice).collect()) == [0, 2]


def test_crowded_bands_lose_no_links(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # each near the first, none near another
        copy = list(base)
        for at in rng.sample(range(8, 192, 8), 4):
            copy[at] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {r.doc_id: r.keep for r in paragraph_duplicates(df).collect()}
    shares = {r.doc_id: r.keep for r in paragraph_duplicates(df, crowded=6).collect()}
    assert sum(whole.values()) == 1 and shares == whole


def test_links_between_shares_match_all_pairs():
    rng = np.random.default_rng(5)
    for many in (0, 300):  # shingles that all sets draw from, then mostly rare ones
        pool = np.sort(rng.integers(1, 1 << 62, 60 + many * 30).astype(np.uint64))
        bases = [rng.choice(pool, 40, False) for _ in range(12)]
        sets = [np.unique(np.concatenate([rng.choice(bases[i % 12], 37, False), rng.choice(pool, 2)])) for i in range(90)]
        ids = np.arange(90) * 7
        a, b = near_links(ids[:50], sets[:50], ids[50:], sets[50:], 0.8)
        near = [(ids[i], ids[j]) for i in range(50) for j in range(50, 90) if len(x := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(x)) - 1e-9]
        want = local_roots(*np.array(near, np.int64).T)
        got = local_roots(a, b)
        assert near and all(map(np.array_equal, got, want))


def test_passages_inside_other_lines(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = " ".join(words(70))
    rows = [(i, f"{' '.join(words(60))} {passage} {' '.join(words(60))}\n{' '.join(words(8))}") for i in range(1, 6)]
    rows += [(6, " ".join(words(150))), (7, " ".join(words(20)) + " " + " ".join(passage.split()[:12]) + " " + " ".join(words(40))), (None, "é\n" + " ".join(words(55)) + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as pieces", "2 as first")
    got = {r.doc_id: r for r in paragraph_report(df).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0, None: 1}
    assert all(r.removed == [] and r.kept_in == ([1] if r.n_removed else []) for r in got.values())
    for d, text in rows:
        for a, b in got[d].passages:
            assert text.encode()[a:b].decode().strip() in passage and b - a > len(passage) / 2
    left = {r.doc_id: r for r in remove_paragraphs(df).collect()}
    assert left[None].pieces == 1 and left[1].text == rows[0][1] and left[7].text == rows[6][1]
    for d, text in rows:
        raw = text.encode()
        for a, b in sorted(map(tuple, got[d].passages), reverse=True):
            raw = raw[:a] + raw[b:]
        assert left[d].text == raw.decode()


def test_members_of_a_crowded_band_that_are_all_unlike(spark):
    rng = random.Random(13)
    common = " ".join(f"c{i}" for i in range(9))
    rows = [(i, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(60)]  # bands collide, paragraphs do not resemble
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {d: k == [] for d, (_, k) in brute(rows).items()}
    assert {r.doc_id: r.keep for r in paragraph_duplicates(df, crowded=3).collect()} == want and not all(want.values())


def test_a_very_long_text(spark):
    line = "all the words of this one line are here again and again "
    rows = [(1, "\n".join(line + str(i) for i in range(60_000))), (2, line + "77\n" + "x" * 3_000_000), (3, "one two three four five six " * 50_000)]
    got = {r.doc_id: r for r in paragraph_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_paragraphs, got[2].removed, got[3].n_paragraphs) == (60_000, [0], 1) and got[1].n_removed > 0
