import re

import pytest

from millrace.llm.decontaminate import UNITS, contamination, without_contaminated


def tokens(text):
    """(value, form) pairs, written out with a regular expression."""
    out, last = [], 0
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        t, opens = m[0], not out or re.search(r"[.!?:\n\r]", text[last : m.start()])
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        form = low
        if t[0].isascii() and t[0].isdigit():
            form = "#num"
        elif out and out[-1][1] == "#num" and low in UNITS:
            form = "#unit"
        elif len(t) > 1 and not opens and ("A" <= t[0] <= "Z" or "À" <= t[0] <= "Þ") and not "A" <= t[1] <= "Z":
            form = "#name"
        out.append((low, form))
        last = m.end()
    return out


def grams(text, size=5, lines=False):
    t = tokens(text)
    k = min(size, len(t))
    spans = [(i, k) for i in range(len(t) - k + 1 if t else 0)]
    if lines:
        at = 0
        for line in (text or "").split("\n"):
            n = len(tokens(line))
            if 0 < n < size and n < len(t):
                spans.append((at, n))
            at += n
    out = []
    for i, k in spans:
        w = t[i : i + k]
        literal = sum(not f.startswith("#") for _, f in w)
        out.append((i, tuple(f for _, f in w) if literal >= min(2, k) else tuple(("=", v) for v, _ in w), [v for v, f in w if f.startswith("#")]))
    return out


def brute(docs, items):
    out = {}
    for i, text in items:
        mine = {}
        for at, w, s in grams(text):
            mine.setdefault(w, (at, s))
        for d, doc in docs:
            hits, lines = set(), {}
            for at, w, s in grams(doc, lines=True):
                if w in mine:
                    hits.add(w)
                    lines.setdefault(at - mine[w][0], set()).update(zip(mine[w][1], s))
            values = sum(len({b for b, _ in p}) for p in lines.values())
            conflicts = sum(len(p) - len({b for b, _ in p}) for p in lines.values())
            if hits and len(hits) >= 0.8 * len(mine) and conflicts <= 0.2 * values + 1e-9:
                out[d, i] = (len(mine), len(hits))
    return out


def run(spark, docs, items, **options):
    got = contamination(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as w"), spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id"), **options)
    return {(r.doc_id, r.item_id): (r.item_windows, r.matched) for r in got.collect()}


@pytest.mark.parametrize("most_sent", [1 << 22, 0])
def test_tables_match_brute_force(spark, most_sent):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute(docs, items)
    assert want and run(spark, docs, items, most_sent=most_sent) == want


ITEM = "A train leaves Paris with 120 people. In Lyon 35 people get off and 120 kg of mail come on. How many people of Paris were left in Lyon?"


def test_reparameterised_and_inconsistent(spark):
    other = ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "77").replace("35", "2,500").replace("kg", "lbs")
    mixed = "A train leaves Paris with 1 people. In Lyon 35 people get off and 2 kg of mail come on. How many people of Rome were left in Turin?"
    docs = [(1, "Before. " + ITEM + " After."), (2, other), (3, mixed), (4, ITEM[:60]), (5, None), (6, ""), (7, other + "\n" + ITEM), (8, "word " * 60_000 + ITEM), (8, "again"), (9, "Short item"), (10, "a Short item here"), (None, other)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "short item"), (5, "1 2 3 4 5 6 7"), (None, ITEM)]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert set(got) == {(1, 1), (2, 1), (7, 1), (8, 1), (9, 4), (None, 1)} | {(d, None) for d in (1, 2, 7, 8, None)}


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_rows_are_told_apart(spark):
    a, b = ITEM[: len(ITEM) // 2], ITEM[len(ITEM) // 2 :]
    docs = spark.createDataFrame([(None, a, 1), (None, b, 2), (None, "nothing of it here at all", 3), (7, a, 4), (7, b, 5), (7, ITEM, 6), (7, ITEM, 7), (8, None, 8)], "doc_id bigint, text string, __of int")
    docs = docs.selectExpr("*", "1 as __rid", "2 as digest", "3 as item", "4 as `a.b`")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, b + " And then, what else was there?"), (None, "what of the other half now?")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in contamination(docs, items).collect()) == [(7, 1), (7, 1)]
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["__of"] for r in kept.collect()) == [1, 2, 3, 4, 5, 8]
    assert without_contaminated(docs.limit(0), items).count() == 0 and without_contaminated(docs, items.limit(0)).count() == 8


def test_short_items_are_found_by_line(spark):
    docs = [(1, "some words before\nWho is it?\nand some after it"), (2, "who is it? a line that goes on"), (3, "Who is it"), (4, "x\nwho is\nit"), (5, "a b\nc")]
    items = [(1, "Who is it?"), (2, "a b c")]
    assert set(run(spark, docs, items)) == {(1, 1), (3, 1), (5, 2)} and run(spark, docs, items) == brute(docs, items)


def test_names_that_open_sentences(spark):
    tom = "Tom has 12 apples and 5 pears. Tom gives 3 apples to Mary. How many apples does Tom have left?"
    betty = "Betty is saving money for a new wallet. Betty has only half of the money. Betty needs 100 dollars in total. How much more money does Betty need?"
    maria = "Maria bakes 12 cakes in the morning. Maria sells 5 cakes at noon. How many cakes are left in the evening?"
    ann = tom.replace("Tom", "Ann").replace("Mary", "Joe").replace("12", "40").replace("5", "9").replace("3", "8")
    docs = [
        (1, "Before. " + ann), (2, betty.replace("Betty", "Carla").replace("100", "2,500")), (3, "He said: " + maria.replace("Maria", "Zoe").replace("12", "7")),
        (4, "Ann has 1 apples and 2 pears. Bob gives 3 apples to Mary. How many apples does Cyd have left?"), (5, tom), (6, "Ann has 7 dogs"), (7, "so then, " + ann),
        (8, "The has 12 apples and 5 pears. Of gives 3 apples to Mary. How many apples does The have left?"), (9, "Tom has 12 oranges. Nobody knows how many pears Mary gives to Tom in the evening."),
    ]
    items = [(1, tom), (2, betty), (3, maria), (4, "Tom has 5 dogs")]
    got = run(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 1), (6, 4), (7, 1)}
    assert all(matched <= windows for windows, matched in got.values())
