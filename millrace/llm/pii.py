"""Format-preserving pseudonyms of personal data.

Card numbers, phone and social-security numbers, addresses of machines and dates are validated and then
permuted by a keyed Feistel network over exactly the valid values of their format: a card number stays
a valid card number of the same grouping, a date a date. Equal values get equal pseudonyms in every
document and different values different ones. The local part of a mail address and long hexadecimal
secrets, which have no small domain, get keyed digests of the same kind instead. Only SQL functions are
used, and only on what the patterns found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import fresh

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: the usual groupings of a card, looked for at every place where digits begin: other numbers may stand beside it
GROUPED = (r"[0-9]{13,19}", r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}")
SECRET = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,64}(?![A-Za-z0-9])"
#: in the order in which they are tried at a place
KINDS = {"email": EMAIL, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "ipv4": IPV4, "secret": SECRET}
ANY = "|".join(KINDS.values())
#: what every match holds; texts without it are passed through after one cheap scan
HINT = r"[0-9]{3}|[0-9][. -][0-9]|@|[0-9a-f]{16}"
ROUNDS = 8
#: dates are permuted within ranges of days, told by the first one, from FIRST_DAY on, and two factors of the number
#: of days: the calendar's cycle of 400 years from 1800 on, the years after it up to 9999, and those before from 200 and 1 on
FIRST_DAY = "1800-01-01"
DAYS = ((0, 189, 773), (146097, 233, 12227), (-584388, 756, 773), (-657071, 13, 5591))


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(x: str, a: str, b: str, tag: str, key: str) -> str:
    """SQL for a keyed permutation of 0 .. a*b-1 at ``x`` (a bigint): halves of sizes a and b are shifted by turns."""
    mask = "cast(conv(substr(sha2(concat_ws('|', {key}, {tag}, i, {half}), 256), 1, 14), 16, 10) as bigint)"
    left, right = (mask.format(key=_lit(key), tag=tag, half=f"s.{h}") for h in "rl")
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({x} as bigint) div cast({b} as bigint), 'r', pmod(cast({x} as bigint), cast({b} as bigint))), "
        f"(s, i) -> if(i % 2 = 1, named_struct('l', pmod(s.l + {left}, cast({a} as bigint)), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + {right}, cast({b} as bigint)))), "
        f"s -> s.l * cast({b} as bigint) + s.r)"
    )


def luhn_sum(digits: str) -> str:
    return f"aggregate(sequence(1, length({digits})), 0, (t, j) -> t + element_at(if((length({digits}) - j) % 2 = 1, array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), sequence(0, 9)), cast(substr({digits}, j, 1) as int) + 1))"


def _fill(form: str, digits: str) -> str:
    """SQL that puts ``digits`` in the places of the digits of ``form``."""
    return f"aggregate(split({form}, ''), named_struct('o', '', 'k', 1), (f, c) -> if(c rlike '[0-9]', named_struct('o', concat(f.o, substr({digits}, f.k, 1)), 'k', f.k + 1), named_struct('o', concat(f.o, c), 'k', f.k)), f -> f.o)"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym(m: str, key: str) -> str:
    """SQL for a struct (kind, value) of the match ``m``; kind is null and value ``m`` itself where validation fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    keep = f"named_struct('kind', cast(null as string), 'value', {m})"

    def out(kind: str, value: str) -> str:
        return f"named_struct('kind', '{kind}', 'value', {value})"

    def full(pattern: str) -> str:
        return f"{m} rlike {_lit('^(?:' + pattern + ')$')}"

    email = out("email", f"concat('u', substr(sha2(concat_ws('|', {_lit(key)}, 'email', lower({m})), 256), 1, 12), substr({m}, instr({m}, '@')))")
    iso = f"case when {m} like '____-%' then {m} when {m} like '%/%' then concat_ws('-', substr({m}, 7, 4), substr({m}, 1, 2), substr({m}, 4, 2)) else concat_ws('-', substr({m}, 7, 4), substr({m}, 4, 2), substr({m}, 1, 2)) end"
    ranges = " ".join(f"when n >= {at} and n < {at + a * b} then {at} + {feistel(f'(n - ({at}))', a, b, chr(39) + 'date' + chr(39), key)}" for at, a, b in DAYS)
    written = f"date_format(date_add(date'{FIRST_DAY}', cast(e as int)), case when {m} like '____-%' then 'yyyy-MM-dd' when {m} like '%/%' then 'MM/dd/yyyy' else 'dd.MM.yyyy' end)"
    date = _let(f"datediff(try_cast({iso} as date), date'{FIRST_DAY}')", "n", _let(f"case {ranges} end", "e", f"if(e is null, {keep}, {out('date', written)})"))
    area, group, serial = (f"cast(substr({m}, {i}, {n}) as bigint)" for i, n in ((1, 3), (5, 2), (8, 4)))
    index = f"(({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    ssn_text = "concat_ws('-', lpad(cast(y div 989901 + 1 + if(y div 989901 >= 665, 1, 0) as string), 3, '0'), lpad(cast(y div 9999 % 99 + 1 as string), 2, '0'), lpad(cast(y % 9999 + 1 as string), 4, '0'))"
    ssn = f"if({area} in (0, 666) or {area} >= 900 or {group} = 0 or {serial} = 0, {keep}, {out('ssn', _let(feistel(index, '88902', '9999', _lit('ssn'), key), 'y', ssn_text))})"
    national = f"right({digits}, 10)"
    ten = _let(
        f"cast({national} as bigint)", "n",
        f"if(n div 10000000 >= 200 and n div 10000 % 1000 >= 200, "
        + _let(feistel("((n div 10000000 - 200) * 800 + n div 10000 % 1000 - 200) * 10000 + n % 10000", "640000", "10000", "'phone'", key), "y", "(y div 8000000 + 200) * 10000000 + (y div 10000 % 800 + 200) * 10000 + y % 10000")
        + ", " + _unlike_valid(key) + ")",
    )
    phone = out("phone", _let(f"concat(left({digits}, length({digits}) - 10), lpad(cast({ten} as string), 10, '0'))", "d", _fill(m, "d")))
    body = f"left({digits}, length({digits}) - 1)"
    half_a, half_b = f"pow(10, (length({digits}) - 1) div 2)", f"pow(10, length({digits}) - 1 - (length({digits}) - 1) div 2)"
    new_body = f"lpad(cast({feistel(body, half_a, half_b, f'''concat('card', length({digits}))''', key)} as string), length({digits}) - 1, '0')"
    card_text = _let(new_body, "p", _let(f"concat(p, cast(pmod(10 - {luhn_sum('concat(p, 0)')} % 10, 10) as string))", "d", _fill(m, "d")))
    card = f"if({luhn_sum(digits)} % 10 <> 0, {keep}, {out('card', card_text)})"
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip = _let(octets, "v", f"if(exists(v, o -> o > 255), {keep}, " + out("ipv4", _let(feistel("((v[0] * 256 + v[1]) * 256 + v[2]) * 256 + v[3]", "65536", "65536", "'ipv4'", key), "y", "concat_ws('.', y div 16777216, y div 65536 % 256, y div 256 % 256, y % 256)")) + ")")
    secret = out("secret", f"substr(sha2(concat_ws('|', {_lit(key)}, 'secret', {m}), 256), 1, length({m}))")
    return (
        f"case when {m} like '%@%' then {email} when {full(DATE)} then {date} when {full(SSN)} then {ssn} when {full(PHONE)} then {phone} "
        f"when {full(IPV4)} then {ip} when {full(CARD)} then {card} else {secret} end"
    )


def _unlike_valid(key: str) -> str:
    """Ten digits ``n`` that are no valid phone number, permuted among such: those of a low area code come first, then those of a low exchange."""
    area, exchange = "(n div 10000000)", "(n div 10000 % 1000)"
    place = f"(if({area} < 200, {area} * 1000 + {exchange}, 200000 + ({area} - 200) * 200 + {exchange}) * 10000 + n % 10000)"
    back = "if(p < 200000, (p div 1000) * 1000 + p % 1000, (200 + (p - 200000) div 200) * 1000 + (p - 200000) % 200)"
    return _let(feistel(place, "360000", "10000", "'digits'", key), "y", f"{_let('y div 10000', 'p', back)} * 10000 + y % 10000")


def _around_cards() -> str:
    """SQL for the pattern of ``text``: where it holds valid cards in usual groupings, with these ahead of all kinds and kept out of longer runs of digits."""
    found = ", ".join(f"regexp_extract_all(text, {_lit(f'(?<![0-9])(?=({form})(?![0-9]))[0-9]')}, 1)" for form in GROUPED)
    cards = f"array_distinct(filter(concat({found}), c -> {_let("regexp_replace(c, '[^0-9]', '')", "d", luhn_sum('d') + ' % 10 = 0')}))"
    before, after = (CARD.split("[ -]?")[i] for i in (0, 1))
    tempered = (before + r"(?![ -]\0)[ -]?" + after).split(r"\0")
    kinds = "|".join(r"\0" if k == "card" else pattern for k, pattern in KINDS.items()).split(r"\0")
    whole = f"concat(v, '|', {_lit(kinds[0] + tempered[0])}, v, {_lit(tempered[1] + kinds[1])})"
    named = _let("concat('(?:(?<![0-9])(?:', array_join(cards, '|'), ')(?![0-9]))')", "v", whole)
    return f"if(text rlike '[0-9](?:[ -]?[0-9]){{12}}', {_let(cards, 'cards', f'if(size(cards) = 0, {_lit(ANY)}, {named})')}, {_lit(ANY)})"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_<kind>`` counts of what was replaced.

    A null text stays null with counts of 0; ids, repeated rows, order and other columns are kept, whatever their
    names, but columns of the counts' names are replaced. Matches that fail validation stay as they are. A text is
    read whole, within a row's memory; an empty table gives an empty result.
    """
    each, hits = fresh(docs, "any"), fresh(docs, "pii")
    found = docs.withColumn(each, F.expr(_around_cards()))
    found = found.withColumn(hits, F.expr(f"if(text rlike {_lit(HINT)}, regexp_extract_all(text, `{each}`, 0), cast(array() as array<string>))"))
    found = found.withColumn(hits, F.expr(f"coalesce(transform({hits}, m -> {pseudonym('m', key)}), array())"))
    pieces = f"zip_with(split(text, `{each}`, -1), {hits}, (a, h) -> concat(a, coalesce(h.value, '')))"
    out = found.withColumn("text", F.expr(f"if(text is null or size({hits}) = 0, text, array_join({pieces}, ''))"))
    for k in KINDS:
        out = out.withColumn(f"n_{k}", F.expr(f"size(filter({hits}, h -> h.kind = '{k}'))"))
    return out.drop(hits, each)
