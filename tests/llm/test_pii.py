import datetime
import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm.pii import HINT, KINDS, ROUNDS, feistel, pseudonymise

KEY = "k|'\\x"


def brute(x, a, b, tag, key):
    left, right = divmod(x, b)
    for i in range(1, ROUNDS + 1):
        half = right if i % 2 else left
        f = int(hashlib.sha256(f"{key}|{tag}|{i}|{half}".encode()).hexdigest()[:14], 16)
        if i % 2:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left * b + right


def test_feistel_is_the_permutation_written_out(spark):
    got = [r[0] for r in spark.range(7 * 12).select(F.expr(feistel("id", "7", "12", "'t'", KEY))).collect()]
    assert got == [brute(x, 7, 12, "t", KEY) for x in range(84)] and sorted(got) == list(range(84))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def card(i):
    return next(f"{i:015d}{c}" for c in range(10) if luhn(f"{i:015d}{c}"))


def one(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' as n_card", "7 as kind")
    return pseudonymise(df, KEY).orderBy("doc_id").collect()


def test_formats_links_and_validity(spark):
    cards = [card(4_000_000_000_000 + i) for i in range(300)]
    got = one(spark, [f"a {c} b" for c in cards] + [f"again {cards[7][:4]} {cards[7][4:8]}-{cards[7][8:12]} {cards[7][12:]}."])
    new = [r.text.split()[1] for r in got[:-1]]
    assert len(set(new)) == 300 and all(luhn(n) and len(n) == 16 for n in new) and sum(a == b for a, b in zip(new, cards)) == 0
    assert re.sub(r"\D", "", got[-1].text) == new[7] and re.fullmatch(r"again \d{4} \d{4}-\d{4} \d{4}\.", got[-1].text)
    body = int(cards[7][:-1])
    assert int(new[7][:-1]) == brute(body, 10**7, 10**8, "card16", KEY)

    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(400)]
    new = [datetime.date.fromisoformat(r.text) for r in one(spark, [d.isoformat() for d in days])]
    zero = datetime.date(1800, 1, 1)
    assert [(n - zero).days for n in new] == [brute((d - zero).days, 189, 773, "date", KEY) for d in days]
    a, b, c = (r.text for r in one(spark, ["2024-02-29", "02/29/2024", "29.02.2024"]))
    y, m, d = a.split("-")
    assert b == f"{m}/{d}/{y}" and c == f"{d}.{m}.{y}"

    ends = ["0001-01-01", "0199-12-31", "0200-01-01", "1799-12-31", "2200-01-01", "9999-12-31"]
    new = [r.text for r in one(spark, ends)]
    assert all(datetime.date.fromisoformat(n) for n in new) and len(set(new) - set(ends)) == 6
    assert [n < "0200" for n in new] == [True, True] + [False] * 4 and [n >= "2200" for n in new] == [False] * 4 + [True] * 2
    assert all((datetime.date(a + 1, 1, 1) - datetime.date(b, 1, 1)).days == size for a, b, size in ((2199, 1800, 189 * 773), (199, 1, 13 * 5591), (1799, 200, 756 * 773)))
    assert (datetime.date(9999, 12, 31) - datetime.date(2200, 1, 1)).days + 1 == 233 * 12227

    phones = [f"({200 + i % 800}) 555-{1000 + i}" for i in range(300)] + [f"({100 + i % 90}) 555-{1000 + i}" for i in range(300)]
    new = [r.text for r in one(spark, phones)]
    assert len(set(new)) == 600 and all(re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", n) for n in new)
    valid = lambda p: p[1] >= "2" and p[6] >= "2"
    assert list(map(valid, new)) == list(map(valid, phones))

    ssns = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]
    new = [r.text for r in one(spark, ssns)]
    assert len(set(new)) == len(ssns) and all(n[:3] not in ("000", "666") and n[:3] < "900" and n[4:6] != "00" and n[7:] != "0000" for n in new)
    new = [r.text for r in one(spark, [f"10.0.{i}.255" for i in range(200)])]
    assert len(set(new)) == 200 and all(all(int(o) < 256 for o in n.split(".")) for n in new)


def test_what_stays_and_odd_rows(spark):
    same = ["4785380592391138", "2024-02-30", "0000-01-01", "666-12-1234", "999.1.1.1", "1.2.3", "no data", "", "12345", "deadbeef", "a@b", "1234567890123456789012345"]
    assert [r.text for r in one(spark, same)] == same
    mail = [r.text for r in one(spark, ["x Bob.A@Mail.example.com", "y bob.a@mail.example.com.", "token=24be64439e3e49cf46b2d7c90f3602a3d0b907ff"])]
    assert mail[0].split("@")[0][2:] == mail[1].split("@")[0][2:] and "ob" not in mail[0].split("@")[0] and "24be6443" not in mail[2] and len(mail[2]) == 46
    long = "word " * 100_000 + card(5) + " end " + card(5)
    rows = [(1, None), (None, card(5)), (2, long), (2, long)]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), KEY).collect()
    assert Counter((r.doc_id, r.text is None, r.n_card) for r in got) == Counter([(1, True, 0), (None, False, 1), (2, False, 2), (2, False, 2)])
    assert all(r.text.startswith("word word") and r.text.count(" end ") == 1 and card(5) not in r.text for r in got if r.doc_id == 2)
    assert pseudonymise(spark.createDataFrame([], "doc_id bigint, text string"), KEY).count() == 0


def test_cards_beside_other_numbers(spark):
    visa, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [f"{visa} 12/26", f"{visa} 123", f"12 {visa}", f"1234 {visa} 2024-02-29", f"{visa} {visa}", f"7 {amex} 1234", "4111111111111111 123", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    got = one(spark, texts)
    new = one(spark, [visa, amex])
    assert [r.n_card for r in got] == [1, 1, 1, 1, 2, 1, 1, 1] and [r.n_date for r in got] == [0, 0, 0, 1, 0, 0, 0, 0]
    assert [r.text for r in got[:3]] == [f"{new[0].text} 12/26", f"{new[0].text} 123", f"12 {new[0].text}"]
    assert got[3].text.startswith(f"1234 {new[0].text} ") and got[4].text == f"{new[0].text} {new[0].text}" and got[5].text == f"7 {new[1].text} 1234"
    assert got[6].text.replace(" ", "") == new[0].text.replace(" ", "") + "123" and got[7].text.replace(" ", "") == new[0].text.replace(" ", "")


def test_every_match_holds_the_hint():
    rng = random.Random(12)
    hint, kinds = re.compile(HINT), {k: re.compile(p) for k, p in KINDS.items()}
    seen = Counter()
    for _ in range(60_000):
        parts = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))]
        sep = rng.choice([" ", "-", ".", "/", "", " -", "./"])
        text = rng.choice(["", "+1 ", "(", "a@b.", "x"]) + "".join(p + (rng.choice(sep) if sep else "") for p in parts) + rng.choice(["", ")", "@mail.org", "ab12"])
        if rng.random() < 0.1:
            text = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(10, 70)))
        for k, p in kinds.items():
            if p.search(text):
                seen[k] += 1
                assert hint.search(text), (k, text)
    assert len(seen) == len(KINDS) and min(seen.values()) > 5


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, card(5), 7, 8, 9)], "doc_id bigint, text string, any int, pii int, __pii int")
    got = pseudonymise(df, KEY).first()
    assert (got["any"], got["pii"], got["__pii"], got.n_card) == (7, 8, 9, 1) and got.text != card(5)
