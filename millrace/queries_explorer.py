"""Queries of the record explorer and its filter language."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import explorer as X
from millrace.plans.textfilter import matches
from millrace.registry import query, table
from millrace.sources import records as R

_L, _R = "(^|[^\\p{L}\\p{Nd}])", "($|[^\\p{L}\\p{Nd}])"


def _phrase(p: str) -> str:
    return f"regexp_matches(lower(text), '{_L}{p}{_R}')"


def _filter(name: str, text: str, where: str):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").where(matches("text", text)).select("doc_id", "lang")

    run.__name__ = name
    query(f"SELECT doc_id, lang FROM documents WHERE {where}")(run)


_C = "contains(lower(text), '%s')"
_filter("filter_and", "the THING ion", " AND ".join(_C % w for w in ("the", "thing", "ion")))
_filter("filter_not", 'the -idiot -"que"', f"{_C % 'the'} AND NOT {_C % 'idiot'} AND NOT {_phrase('que')}")
_filter("filter_or", 'idiot|clown|"licensed under"', f"{_C % 'idiot'} OR {_C % 'clown'} OR {_phrase('licensed under')}")
_filter("filter_phrase", '"of the" "à"|"de la"|"in"', f"{_phrase('of the')} AND ({_phrase('à')} OR {_phrase('de la')} OR {_phrase('in')})")
_filter("filter_mixed", 'license|apache "the" -scum  er -', f"({_C % 'license'} OR {_C % 'apache'}) AND {_phrase('the')} AND NOT {_C % 'scum'} AND {_C % 'er'}")
_filter("filter_literal_bar", "|e a|", f"{_C % '|e'} AND {_C % 'a|'}")

_filter("filter_empty", " ", "true")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(' ' || c_custkey || ' ' || c_name || ' ' || c_nationkey || ' ' || c_mktsegment), 'build') AND regexp_matches(lower(' ' || c_custkey || ' ' || c_name || ' ' || c_nationkey || ' ' || c_mktsegment), '(^|[^0-9a-z])7($|[^0-9a-z])')")
def filter_all_fields(spark, sf_dir):
    return X.search(table(spark, sf_dir, "customer"), 'build "7"', ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_type FROM part WHERE contains(' ' || p_type || ' ', ' STEEL ')")
def filter_token(spark, sf_dir):
    return table(spark, sf_dir, "part").where(X.contains_token(F.col("p_type"), "STEEL", " ")).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42")
def lookup_int(spark, sf_dir):
    return X.lookup(table(spark, sf_dir, "orders"), "o_custkey", "42").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def lookup_string(spark, sf_dir):
    return X.lookup(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 17")
def lookup_scan_cast(spark, sf_dir):
    return X.lookup(table(spark, sf_dir, "lineitem"), "l_quantity", "17.0").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE false")
def lookup_bad_key(spark, sf_dir):
    return X.lookup(table(spark, sf_dir, "orders"), "o_custkey", "4x").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def lookup_keys(spark, sf_dir):
    return X.lookup_keys(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")).select("o_orderkey", "o_custkey")


def _places(ordered, key):
    """Where the rows of a sorted table stand; equal keys share the first place among them."""
    at = R.positions(ordered)
    return at.withColumn("nth", F.min("row_id").over(Window.partitionBy(key)))


def _sort(name, ascending):
    sql = f"SELECT o_orderkey, rank() OVER (ORDER BY nullif(o_custkey, 7) {'ASC NULLS FIRST' if ascending else 'DESC NULLS LAST'}) - 1 AS nth FROM orders"

    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_custkey, 7L)").alias("k"))
        return _places(X.sort_by(o, "k", ascending), "k").select("o_orderkey", "nth")

    run.__name__ = name
    query(sql)(run)


_sort("sort_nulls_small_asc", True)
_sort("sort_nulls_small_desc", False)


@query("SELECT p_partkey, rank() OVER (ORDER BY lower(p_name)) - 1 AS nth FROM part")
def sort_ignore_case(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return _places(X.sort_by(p, "p_name", ignore_case=True), F.lower("p_name")).select("p_partkey", "nth")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, lower(p_name), p_partkey) - 1 AS nth FROM part")
def sort_weight_then_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return R.positions(X.sort_keys(p, ("p_size", False, False), ("p_name", True, True), ("p_partkey", True, False))).select("p_partkey", F.col("row_id").alias("nth"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def record_positions(spark, sf_dir):
    return R.with_row_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_id FROM customer")
def record_positions_by_key(spark, sf_dir):
    return R.with_row_id(R.open_table(spark, f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey").select("c_custkey", "row_id")


_CELLS = "sum(strlen(c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(9) || c_mktsegment) + 1)::BIGINT"


@query(f"SELECT n AS n_rows, CASE WHEN b > 536870912 THEN (b // 1073741824) || ' GB' WHEN b > 524288 THEN (b // 1048576) || ' MB' WHEN b > 512 THEN (b // 1024) || ' kB' ELSE b || ' B' END AS size FROM (SELECT count(*) AS n, {_CELLS} AS b FROM customer)")
def dump_stats(spark, sf_dir):
    return X.dump_stats(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_cell(spark, sf_dir):
    return X.update_cell(table(spark, sf_dir, "nation"), F.col("n_nationkey") == 5, "n_name", "renamed")


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def delete_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return X.delete_rows(n, n.where("n_regionkey = 2"), "n_nationkey").select("n_nationkey", "n_name", "n_regionkey")
