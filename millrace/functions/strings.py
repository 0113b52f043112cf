"""String helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_array(arr: Column, sep: str, prefix: str = "", suffix: str = "", line_prefix: str = "", line_suffix: str = "") -> Column:
    """Elements between ``prefix`` and ``suffix``, separated, the whole between ``line_prefix`` and ``line_suffix``; null prints ``null``."""
    each = F.transform(arr, lambda x: F.concat(F.lit(prefix), F.coalesce(x.cast("string"), F.lit("null")), F.lit(suffix)))
    return F.concat(F.lit(line_prefix), F.array_join(each, sep), F.lit(line_suffix))


def split_char(text: Column, sep: str) -> Column:
    """Parts at a literal separator without trailing empty parts; nothing for an empty text."""
    parts = F.split(text, re.escape(sep), -1)
    last = F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0)))), F.lit(0))
    return F.slice(parts, F.lit(1), last)


def tokenize(text: Column, delims: str, return_delims: bool = False, ignore_empty: bool = True) -> Column:
    """Parts between any of the characters ``delims``; with ``return_delims`` the characters are parts too. Null has none."""
    one = "[" + re.escape(delims) + "]"
    text = F.coalesce(text, F.lit(""))
    if return_delims:
        rest = "[^" + re.escape(delims) + "]"
        return F.regexp_extract_all(text, F.lit(f"({one}|{rest}+)"), F.lit(1))
    parts = F.split(text, one, -1)
    return F.filter(parts, lambda x: x != "") if ignore_empty else parts


def interleave(text: Column, pattern: str, each) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``each(match)``, in one pass."""
    hits = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda a, b: F.concat(a, b)), "")


def replace_all(text: Column, search: list[str], replacement: list[str]) -> Column:
    """Literal terms replaced from left to right; at a place the first term of the list wins and results are not scanned again.

    A term without a replacement becomes U+0000.
    """
    if len(replacement) > len(search):
        raise ValueError("more replacements than terms")
    to = dict(reversed([(s, replacement[i] if i < len(replacement) else "\0") for i, s in enumerate(search) if s]))
    if not to:
        return text
    table = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return interleave(text, "|".join(re.escape(s) for s in search if s), lambda m: F.element_at(table, m))


def replace_one(text: Column, search: str, replacement: str | None) -> Column:
    """A literal replaced everywhere; without a replacement U+0000 takes its place."""
    return F.replace(text, F.lit(search), F.lit("\0" if replacement is None else replacement)) if search else text


#: stands for a distance beyond the bound
FAR = 2**31 - 1


def levenshtein(a: Column, b: Column, bound: int | None = None) -> Column:
    """Edit distance; with a bound, ``FAR`` for every distance above it, which ends the computation early."""
    if bound is None:
        return F.levenshtein(a, b)
    distance = F.levenshtein(a, b, bound)
    return F.when(distance < 0, F.lit(FAR)).otherwise(distance)


def not_null(text: Column, otherwise: str = "") -> Column:
    return F.coalesce(text, F.lit(otherwise))


def is_printable(code: Column) -> Column:
    """Whether a byte is a printing ASCII character or a blank."""
    return code.between(32, 126)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The reverse of ``escape``; an unknown escape is dropped, and so is a lone backslash at the end."""
    to = F.create_map(*[F.lit(x) for x in ("\\\\", "\\", "\\t", "\t", "\\n", "\n")])
    return interleave(text, r"\\[\s\S]?", lambda m: F.coalesce(F.try_element_at(to, m), F.lit("")))


def indent(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit("\n" + prefix)))


def trim_to_null(text: Column) -> Column:
    """Without characters up to U+0020 at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), F.lit(""))


def left_crop(text: Column, n: int) -> Column:
    return F.substring(text, 1, n) if n > 0 else F.when(text.isNotNull(), F.lit(""))


def right_crop(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n)) if n > 0 else F.when(text.isNotNull(), F.lit(""))


def center_crop(text: Column, n: int) -> Column:
    """The middle ``n`` characters, from floor(length / 2) - floor(n / 2) on; shorter texts as they are."""
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    start = F.floor(F.length(text) / 2).cast("int") - n // 2 + 1
    return F.when(F.length(text) > n, text.substr(start, F.lit(n))).otherwise(text)


def _fill(text: Column, n: int, fill: str) -> Column:
    return F.repeat(F.lit(fill), F.greatest(n - F.length(text), F.lit(0)))


def left_tab(text: Column, n: int, fill: str = " ") -> Column:
    """Left-aligned in ``n`` characters; ``fill`` is repeated once per missing character, then cropped."""
    return left_crop(F.concat(text, _fill(text, n, fill)), n)


def right_tab(text: Column, n: int, fill: str = " ") -> Column:
    return right_crop(F.concat(_fill(text, n, fill), text), n)


def center_tab(text: Column, n: int, fill: str = " ") -> Column:
    side = F.repeat(F.lit(fill), F.greatest(F.ceil((n - F.length(text)) / 2), F.lit(0)).cast("int"))
    return center_crop(F.concat(side, text, side), n)


def strip_terminal_codes(text: Column) -> Column:
    out = F.replace(text, F.lit("\x1b(B\x1b)0"), F.lit(""))
    out = F.regexp_replace(out, "\x1b\\[[0-9;?]*[^0-9;]", "")
    return F.replace(F.replace(out, F.lit("\x0f"), F.lit("")), F.lit("\x1b=*"), F.lit(""))


def completions(text: Column, prefix: str) -> Column:
    """Distinct identifiers of the text that begin with ``prefix`` and are longer, in order."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1))))
    return F.filter(words, lambda w: w.startswith(prefix) & (w != prefix))


def search_hits(text: Column, needle: str) -> Column:
    """Places where a needle of more than one character stands, case ignored, as written in the text."""
    if len(needle) < 2:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit("(?i)(" + re.escape(needle) + ")"), F.lit(1))


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def hex_dump(text: Column) -> Column:
    """Sixteen characters a line as hex of their low bytes, then the printable ones; the last line is filled and unended."""
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / 16) - 1, F.lit(0)).cast("int")), lambda i: F.substring(text, i * 16 + 1, F.lit(16)))

    def line(s: Column) -> Column:
        cells = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.concat(F.lower(F.lpad(F.hex(F.ascii(c).bitwiseAND(F.lit(255))), 2, "0")), F.lit(" ")))
        hexes = F.rpad(F.array_join(cells, ""), 48, " ")
        return F.concat(hexes, F.lit(" "), F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.when(is_printable(F.ascii(c)), c).otherwise(F.lit("."))), ""), F.when(F.length(s) == 16, F.lit("\n")).otherwise(F.lit("")))

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(lines, line), ""))
