"""Queries over string and time helpers, projections, exports and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import strings as S
from millrace.functions import timing as T
from millrace.operators import tables as V
from millrace.registry import query, table
from millrace.sources import records as R
from millrace.sources import stats as D


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT p_partkey, '<' || array_to_string(list_transform(string_split(p_type, ' '), lambda x: '[' || x || ']'), ';') || '>' AS joined FROM part")
def str_join(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", S.join_array(F.split("p_type", " "), ";", "[", "]", "<", ">").alias("joined"))


@query("SELECT p_partkey, len(string_split(regexp_replace(p_type, 'E+$', ''), 'E')) AS n, array_to_string(string_split(regexp_replace(p_type, 'E+$', ''), 'E'), '|') AS parts FROM part")
def str_split(spark, sf_dir):
    parts = S.split_char(F.col("p_type"), "E")
    return _part(spark, sf_dir).select("p_partkey", F.size(parts).cast("bigint").alias("n"), F.array_join(parts, "|").alias("parts"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[ .,\\n]'), lambda x: x <> '')) AS n, list_filter(string_split_regex(text, '[ .,\\n]'), lambda x: x <> '')[1] AS head FROM documents")
def str_tokenize(spark, sf_dir):
    parts = S.tokenize(F.col("text"), " .,\n")
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("bigint").alias("n"), F.try_element_at(parts, F.lit(1)).alias("head"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.,]|[^.,]+')) AS n FROM documents")
def str_tokenize_delims(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(S.tokenize(F.col("text"), ".,", return_delims=True)).cast("bigint").alias("n"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(text, 'the', chr(1)), 'he', chr(2)), 'e', chr(3)), chr(1), 'THE'), chr(2), 'e'), chr(3), 'the')) AS digest FROM documents")
def str_replace_many(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(S.replace_all(F.col("text"), ["the", "he", "e"], ["THE", "e", "the"]).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n')) AS digest, true AS back FROM documents")
def str_escape(spark, sf_dir):
    out = S.escape(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(out.cast("binary")).alias("digest"), (S.unescape(out) == F.col("text")).alias("back"))


@query("SELECT doc_id, md5('> ' || replace(text, chr(10), chr(10) || '> ')) AS digest FROM documents")
def str_indent(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(S.indent(F.col("text"), "> ").cast("binary")).alias("digest"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def str_levenshtein(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", S.levenshtein(F.col("p_name"), F.col("p_type")).cast("bigint").alias("distance"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_name, p_type) > 14 THEN 2147483647 ELSE levenshtein(p_name, p_type) END AS distance FROM part")
def str_levenshtein_bound(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", S.levenshtein(F.col("p_name"), F.col("p_type"), 14).cast("bigint").alias("distance"))


@query("SELECT p_partkey, replace(p_type, 'STEEL', 'tin') AS other, replace(p_type, 'E', chr(0)) AS zero, coalesce(nullif(p_brand, 'Brand#11'), '') AS brand, coalesce(nullif(p_brand, 'Brand#11'), '-') AS dash FROM part")
def str_replace_one(spark, sf_dir):
    t, b = F.col("p_type"), F.expr("nullif(p_brand, 'Brand#11')")
    return _part(spark, sf_dir).select("p_partkey", S.replace_one(t, "STEEL", "tin").alias("other"), S.replace_one(t, "E", None).alias("zero"), S.not_null(b).alias("brand"), S.not_null(b, "-").alias("dash"))


@query("SELECT p_partkey, p_partkey % 256 BETWEEN 32 AND 126 AS printable FROM part")
def str_printable(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", S.is_printable(F.col("p_partkey") % 256).alias("printable"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS trimmed FROM part")
def str_trim_to_null(spark, sf_dir):
    text = F.when(F.col("p_size") % 5 == 0, F.lit(" \t\r\n\x00")).otherwise(F.concat(F.lit("\x01\t "), "p_name", F.lit(" \n")))
    return _part(spark, sf_dir).select("p_partkey", S.trim_to_null(text).alias("trimmed"))


@query("SELECT p_partkey, left(p_name, 7) AS l, right(p_name, 7) AS r, CASE WHEN length(p_name) > 7 THEN substring(p_name, length(p_name) // 2 - 3 + 1, 7) ELSE p_name END AS c, '' AS z FROM part")
def str_crop(spark, sf_dir):
    n = F.col("p_name")
    return _part(spark, sf_dir).select("p_partkey", S.left_crop(n, 7).alias("l"), S.right_crop(n, 7).alias("r"), S.center_crop(n, 7).alias("c"), S.left_crop(n, 0).alias("z"))


_SIDE = "repeat('*', greatest(ceil((30 - length(p_name)) / 2.0), 0)::BIGINT)"


@query(f"SELECT p_partkey, rpad(p_name, 30, '.') AS l, lpad(p_name, 30, '.') AS r, left(p_name || repeat('ab', greatest(30 - length(p_name), 0)), 30) AS s, substring({_SIDE} || p_name || {_SIDE}, CASE WHEN length({_SIDE} || p_name || {_SIDE}) > 30 THEN length({_SIDE} || p_name || {_SIDE}) // 2 - 15 + 1 ELSE 1 END, 30) AS c FROM part")
def str_tab(spark, sf_dir):
    n = F.col("p_name")
    return _part(spark, sf_dir).select("p_partkey", S.left_tab(n, 30, ".").alias("l"), S.right_tab(n, 30, ".").alias("r"), S.left_tab(n, 30, "ab").alias("s"), S.center_tab(n, 30, "*").alias("c"))


@query("SELECT p_partkey, p_name AS clean FROM part")
def str_terminal_codes(spark, sf_dir):
    text = F.concat(F.lit("\x1b[1;31m"), "p_name", F.lit("\x1b[0m\x0f\x1b[?25h\x1b(B\x1b)0"))
    return _part(spark, sf_dir).select("p_partkey", S.strip_terminal_codes(text).alias("clean"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*')), lambda w: starts_with(w, 'th') AND w <> 'th')), ',') AS words FROM documents")
def str_completions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(S.completions(F.col("text"), "th"), ",").alias("words"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS n FROM documents")
def str_search_hits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(S.search_hits(F.col("text"), "the")).cast("bigint").alias("n"))


@query("SELECT p_partkey, p_name AS text, coalesce(nullif(p_brand, 'Brand#11'), '-') AS brand FROM part")
def str_latin1(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", S.latin1(F.encode("p_name", "ISO-8859-1")).alias("text"), S.not_null(F.expr("nullif(p_brand, 'Brand#11')"), "-").alias("brand"))


@query("SELECT n_nationkey, rpad(lower(regexp_replace(hex(left(n_name, 16)), '(..)', '\\1 ', 'g')), 48, ' ') || ' ' || left(n_name, 16) || CASE WHEN length(n_name) >= 16 THEN chr(10) ELSE '' END AS dump FROM nation")
def str_hex_dump(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.hex_dump(F.col("n_name")).alias("dump"))


@query("SELECT event_id, epoch_us(date_trunc('hour', ts)) AS h, epoch_us(date_trunc('day', ts)) AS d, epoch_us(date_trunc('week', ts)) AS w, epoch_us(date_trunc('month', ts)) AS m FROM events")
def time_round(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *[F.unix_micros(T.round_down(F.col("ts"), u).cast("timestamp")).alias(u[0]) for u in ("hour", "day", "week", "month")])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, day(ts) AS dom, hour(ts) AS hour FROM events")
def time_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.day_key(F.unix_millis(F.col("ts").cast("timestamp"))).alias("day"), T.field(F.col("ts"), "day").cast("bigint").alias("dom"), T.field(F.col("ts"), "hour").cast("bigint").alias("hour"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-03-31 01:00:00' THEN 3600000 ELSE 7200000 END AS berlin, 19800000 AS kolkata FROM events")
def time_zone_offset(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.zone_offset_ms(F.col("ts"), "Europe/Berlin").alias("berlin"), T.zone_offset_ms(F.col("ts"), "Asia/Kolkata").alias("kolkata"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def time_older_than(spark, sf_dir):
    return table(spark, sf_dir, "events").where(T.older_than(F.col("ts"), 10, F.lit("2024-01-31 00:00:00").cast("timestamp"))).select("event_id")


_MS = "(event_id * event_id * 37 - 1000000)"
_ABS = f"abs({_MS})"
_FRAC = "regexp_replace(lpad((%s %% 1000)::VARCHAR, 3, '0'), '^(.)(.*?)0+$', '\\1\\2')"


@query(
    f"SELECT event_id, CASE WHEN {_MS} < 0 THEN '-' ELSE '' END || CASE WHEN {_ABS} // 86400000 = 0 THEN '' WHEN {_ABS} // 86400000 = 1 THEN '1 day ' ELSE ({_ABS} // 86400000) || ' days ' END || "
    f"CASE WHEN r >= 60000 THEN CASE WHEN r >= 3600000 THEN lpad((r // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((r // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((r // 1000 % 60)::VARCHAR, 2, '0') || '.' || {_FRAC % 'r'} || CASE WHEN r >= 3600000 THEN ' h' ELSE ' min' END "
    f"WHEN r >= 1000 THEN (r // 1000) || '.' || {_FRAC % 'r'} || ' s' ELSE r || ' ms' END AS duration FROM (SELECT event_id, {_ABS} % 86400000 AS r FROM events)"
)
def time_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.human_duration(F.expr("event_id * event_id * 37 - 1000000")).alias("duration"))


def _specs():
    return [
        V.ColumnSpec("key", F.col("c_custkey"), index=2, use_in_filter=False),
        V.ColumnSpec("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"), null_value="none", index=1),
        V.ColumnSpec("rounded", F.floor("c_acctbal"), default=False, index=3),
    ]


@query("SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, c_custkey::VARCHAR AS key FROM customer")
def project_null_value(spark, sf_dir):
    return V.project(table(spark, sf_dir, "customer"), _specs())


@query("SELECT c_custkey::VARCHAR AS key, floor(c_acctbal)::BIGINT::VARCHAR AS rounded FROM customer")
def project_chosen(spark, sf_dir):
    return V.project(table(spark, sf_dir, "customer"), _specs(), ["rounded", "key"])


@query("SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def project_map_column(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return V.project(e, [V.ColumnSpec("id", F.col("event_id")), V.map_column("k", F.col("m"), "k"), V.map_column("missing", F.col("m"), "other")])


@query("SELECT c_custkey FROM customer WHERE contains(lower(' ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') || ' ' || floor(c_acctbal)::BIGINT), 'none')")
def search_columns(spark, sf_dir):
    return V.search_columns(table(spark, sf_dir, "customer"), _specs(), "NONE").select("c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')), c_custkey) - 1 AS nth FROM customer WHERE c_nationkey > 3 AND c_acctbal > 0")
def sort_view(spark, sf_dir):
    df = V.all_of(table(spark, sf_dir, "customer"), [F.col("c_nationkey") > 3, F.col("c_acctbal") > 0])
    return R.positions(V.sort_view(df, _specs()[1], F.col("c_custkey"))).select("c_custkey", F.col("row_id").alias("nth"))


@query("SELECT n_nationkey || chr(9) || n_name || chr(9) || coalesce(nullif(n_regionkey, 2)::VARCHAR, '') AS line FROM nation")
def export_tsv(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 2)").alias("n_regionkey"))
    return n.select(V.tsv_lines(n).alias("line"))


@query("SELECT n_nationkey, 'n_name: ' || n_name AS line FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey: ' || n_regionkey FROM nation")
def export_caption_value(spark, sf_dir):
    return V.caption_lines(table(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT rpad(n_name, 10, ' ') || ' | ' || lpad(n_regionkey::VARCHAR, 4, ' ') AS line, '  n_name   | n_re' || chr(10) || '-----------+-----' || chr(10) AS head FROM nation")
def export_text_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "n_re")
    head, line = V.text_table(n, [("n_name", "Left", 10), ("n_re", "Right", 4)])
    return n.select(line.alias("line"), F.lit(head).alias("head"))


@query("""
WITH hit AS (SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'a') AND n_regionkey < 3)
SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM hit) OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 97 = 0)
UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 97 = 0 OR c_nationkey IN (SELECT n_nationkey FROM hit)""")
def tree_filter(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(False).alias("hit"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), (F.lower("n_name").contains("a") & (F.col("n_regionkey") < 3)).alias("hit")))
    nodes = nodes.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), (F.col("c_custkey") % 97 == 0).alias("hit")))
    return V.tree_filter(nodes, F.col("hit")).select("id")
