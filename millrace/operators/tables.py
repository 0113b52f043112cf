"""Table and tree views: column specifications, exports as text, and the filter that keeps a tree's paths."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import center_tab, left_tab, right_tab
from millrace.plans.lineage import cut
from millrace.plans.textfilter import matches


@dataclass(frozen=True)
class ColumnSpec:
    """A shown column: its expression, what it sorts by, what stands for null, and whether searches see it."""

    name: str
    expr: Column
    sort_expr: Column | None = None
    null_value: str | None = ""
    use_in_filter: bool = True
    default: bool = True
    index: int = 0

    def shown(self) -> Column:
        text = self.expr.cast("string")
        return text if self.null_value is None else F.coalesce(text, F.lit(self.null_value))


def ordered(specs: list[ColumnSpec]) -> list[ColumnSpec]:
    """By index; names must differ."""
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("column names must differ")
    return sorted(specs, key=lambda s: s.index)


def project(df: DataFrame, specs: list[ColumnSpec], chosen: list[str] | None = None) -> DataFrame:
    """The chosen columns, or else the default ones, in declared order."""
    known = {s.name for s in specs}
    if chosen is not None and not set(chosen) <= known:
        raise ValueError(f"unknown columns {sorted(set(chosen) - known)}")
    return df.select(*[s.shown().alias(s.name) for s in ordered(specs) if (s.default if chosen is None else s.name in chosen)])


def map_column(name: str, values: Column, key: str) -> ColumnSpec:
    """A column read from a map by key; a missing value stays null."""
    return ColumnSpec(name, F.try_element_at(values, F.lit(key)), null_value=None)


def search_columns(df: DataFrame, specs: list[ColumnSpec], filter_text: str) -> DataFrame:
    """Rows whose searchable columns, each after a blank, pass the filter."""
    seen = [F.concat(F.lit(" "), F.coalesce(s.shown(), F.lit(""))) for s in specs if s.use_in_filter]
    return df.where(matches(F.concat(*seen), filter_text))


def all_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def sort_view(df: DataFrame, spec: ColumnSpec, tie: Column, ascending: bool = True) -> DataFrame:
    """By one column; texts ignore case, null sorts as its substitute, ``tie`` keeps the order of equals."""
    key = spec.sort_expr if spec.sort_expr is not None else F.lower(spec.shown())
    return df.orderBy(key.asc() if ascending else key.desc(), tie)


def tsv_lines(df: DataFrame) -> Column:
    """A row's cells joined by tabs; null is empty."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])


def caption_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, line): ``caption: value`` for every other column of a row."""
    lines = [F.concat(F.lit(c + ": "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns if c != key]
    return df.select(key, F.explode(F.array(*lines)).alias("line"))


def text_table(df: DataFrame, layout: list[tuple[str, str, int]]) -> tuple[str, Column]:
    """Header (with its rule) and a Column of lines; ``layout``: (column, Left|Right|Center, width), wide cells are cropped."""
    align = {"Left": left_tab, "Right": right_tab, "Center": center_tab}
    heads = []
    for name, _, width in layout:
        side = " " * max(0, -(-(width - len(name)) // 2))
        text = side + name + side
        start = len(text) // 2 - width // 2
        heads.append(text[start : start + width] if len(text) > width else text)
    rule = "-+-".join("-" * w for *_, w in layout)
    cells = [align[how](F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, how, w in layout]
    return " | ".join(heads) + "\n" + rule + "\n", F.concat_ws(" | ", *cells)


def tree_filter(nodes: DataFrame, matching: Column) -> DataFrame:
    """Nodes (id, parent_id, ...) that match, lie below one that matches or above one; roots always stay.

    Climbs and descends from the matches at once, a level a round, until no node is new; each round is a join on
    ids and its result is written, so no round repeats the ones before. Nodes in a circle are reached once.
    """
    base = cut(nodes.select("id", "parent_id"))
    hit = nodes.where(matching).select("id").distinct()
    level = seen = cut(hit.select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("up")))
    while True:
        below = base.join(level.where("not up").select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", F.lit(False).alias("up"))
        above = base.where("parent_id is not null").join(level.where("up").select("id"), "id", "left_semi").select(F.col("parent_id").alias("id"), F.lit(True).alias("up"))
        level = cut(below.unionByName(above).distinct().join(seen, ["id", "up"], "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    keep = seen.select("id").unionByName(base.where("parent_id is null").select("id")).distinct()
    return nodes.join(keep, "id", "left_semi")
