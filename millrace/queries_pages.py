"""Queries over pages, proxies, classification and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import markup as M
from millrace.operators import crawl as C
from millrace.operators import proxies as P
from millrace.operators import svm as S
from millrace.plans.lineage import scratch
from millrace.registry import ORACLES, query, table
from millrace.sources import records as R
from millrace.sources import texts as L
from millrace.streaming import usage as U

import millrace.queries_metrics  # noqa: F401,E402  registers the batch form of the stream

_STATS_SQL = ORACLES["usage_bucket_stats"]

_HREFS = "regexp_extract_all(replace(html, chr(10), ''), '(?i)<a .*?href=\"(.*?)\"[^>]*?(?:>|/>)', 1)"


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/.*)?$", 1).alias("path"), "html")


@query(f"SELECT page_id, unnest({_HREFS}) AS href FROM pages")
def links_extract(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(C.links(F.col("html"))).alias("l")).select("page_id", "l.href")


@query(f"SELECT page_id, count(*) AS n, count(DISTINCT h) AS n_distinct FROM (SELECT page_id, unnest({_HREFS}) AS h FROM pages) GROUP BY 1")
def links_counts(spark, sf_dir):
    return links_extract(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_distinct"))


@query(f"SELECT link_path, count(*) AS n FROM (SELECT unnest({_HREFS}) AS link_path FROM pages) WHERE starts_with(link_path, '/') GROUP BY 1")
def links_absolute(spark, sf_dir):
    return C.page_links(_pages(spark, sf_dir)).where(F.col("link_host") == F.col("host")).groupBy("link_path").agg(F.count("*").alias("n"))


@query(f"SELECT link_path, count(*) AS n FROM (SELECT unnest({_HREFS}) AS link_path FROM pages) WHERE regexp_full_match(link_path, '/.*[0-9].*') AND NOT regexp_full_match(link_path, '.*7.*') GROUP BY 1")
def links_follow(spark, sf_dir):
    found = C.page_links(_pages(spark, sf_dir), compat=True)
    return found.where(C.follows(F.col("link_path"), ["/.*[0-9].*"], [".*7.*"])).groupBy("link_path").agg(F.count("*").alias("n"))


@query("SELECT page_id, replace(replace(replace(trim(url || ' a|b&amp;c '), ' ', '+'), '|', '%7C'), '&amp;', '&') AS link FROM pages")
def links_normalise(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.normalise(F.concat("url", F.lit(" a|b&amp;c "))).alias("link"))


@query("SELECT page_id, CASE WHEN NOT contains(html, '<html') OR contains(html, 'idiot') THEN 'insane' WHEN contains(html, 'erer') THEN 'retry' ELSE 'ok' END AS status FROM pages")
def page_sanity(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.sanity(F.col("html"), ["<html"], ["idiot"], ["erer"]).alias("status"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[0-9]+', '#', 'g')) AS digest FROM pages")
def page_rewrite(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(C.rewrite(F.col("html"), [("<[^>]*>", " "), ("[0-9]+", "#")]).cast("binary")).alias("digest"))


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 3 = 1")
def page_accepted(spark, sf_dir):
    return _pages(spark, sf_dir).where(C.accepted(F.expr("case page_id % 3 when 0 then 200 when 1 then 404 else 500 end"))).select("page_id")


@query("SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&') AS title FROM pages")
def page_to_rows(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", "html", M.extract(F.col("html"), {"title": "."}, ".//title").alias("m"))
    first = F.coalesce(F.get("m", F.lit(0))["title"], F.when(F.col("html").isNotNull(), F.lit("")))
    return rows.select("page_id", first.alias("title"))


@query("SELECT page_id, '1F8B' AS magic, md5(html) AS digest FROM pages")
def page_gzip(spark, sf_dir):
    packed = _pages(spark, sf_dir).select("page_id", M.gzip_page("html").alias("z"))
    return packed.select("page_id", F.hex(F.substring("z", 1, 2)).alias("magic"), F.md5(M.gunzip_page("z").cast("binary")).alias("digest"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def page_charset(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(M.decode_page(F.encode("html", "UTF-8"), F.lit("utf-8"), "utf-8").cast("binary")).alias("digest"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def xml_to_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    xml = F.format_string("<r><row><name>x</name><name>%s</name><in><region>%d</region></in></row><empty/></r>", "n_name", "n_regionkey")
    return n.select("n_nationkey", F.explode(M.xml_rows(xml)).alias("m")).select("n_nationkey", F.col("m")["name"].alias("name"), F.col("m")["region"].alias("region"))


@query("SELECT n_nationkey, n_name || chr(10) || n_regionkey AS texts FROM nation")
def xpath_texts(spark, sf_dir):
    xml = F.format_string("<r><a>%s</a><b/><a>%d</a></r>", "n_name", "n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", M.xpath_text(xml, "/r/a/text()").alias("texts"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[^>]*>|[A-Za-z]+')) AS n, md5(array_to_string(regexp_extract_all(html, '<[^>]*>|[A-Za-z]+'), chr(1))) AS texts, len(list_filter(regexp_extract_all(html, '<[^>]*>|[A-Za-z]+'), lambda x: starts_with(x, '<'))) AS tags FROM pages")
def first_matches(spark, sf_dir):
    found = _pages(spark, sf_dir).select("page_id", M.first_matches(F.col("html"), {"tag": "<[^>]*>", "word": "[A-Za-z]+"}).alias("m"))
    tags = F.size(F.filter("m", lambda x: x["kind"] == "tag"))
    return found.select("page_id", F.size("m").cast("bigint").alias("n"), F.md5(F.array_join(F.col("m")["text"], "\x01").cast("binary")).alias("texts"), tags.cast("bigint").alias("tags"))


# a graph over customers: each links to twice its number and to the next one; numbers that end in 7 are closed
_GRAPH = "SELECT c_custkey AS i, unnest([c_custkey * 2, c_custkey * 2 + 1]) AS j FROM customer"


@query(f"""WITH RECURSIVE g AS ({_GRAPH}), walk(i, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT g.j, depth + 1 FROM walk JOIN g USING (i) WHERE g.j % 10 <> 7)
SELECT '/p/' || i AS path, min(depth) AS depth FROM walk GROUP BY 1""")
def crawl_levels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    html = F.format_string('<html><a href="%d">double</a>\n<A class=x href="../p/./%d">next</A><a href="1">top</a></html>', F.col("c_custkey") * 2, F.col("c_custkey") * 2 + 1)
    pages = c.select(F.lit("h").alias("host"), F.concat(F.lit("/p/"), "c_custkey").alias("path"), html.alias("html"))
    seeds = spark.createDataFrame([("h", "/p/1")], "host string, path string")
    return C.crawl(pages, seeds, ["/p/[0-9]+"], ["/p/[0-9]*7"]).select("path", "depth")


# each event is a request for one of 50 items; an item's requests are numbered as they come
_ASKED = "(SELECT event_id % 50 AS item, row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS attempt, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 404 ELSE 503 END AS status, user_id % 2 = 0 AS sane FROM events)"


@query(f"""SELECT '/' || item AS path, CASE WHEN won IS NOT NULL THEN 'ok' WHEN n < 3 THEN 'retry' ELSE 'failed' END AS state, coalesce(won, n) AS attempts, CASE WHEN won IS NULL AND last <> 404 AND last <> 200 THEN last END AS error_status
FROM (SELECT item, min(attempt) FILTER (status IN (200, 404) AND sane) AS won, count(*) AS n, max_by(status, attempt) AS last FROM {_ASKED} WHERE attempt <= 3 GROUP BY 1)""")
def crawl_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("item", F.col("event_id") % 50)
    status = F.expr("case event_type when 'click' then 200 when 'view' then 404 else 503 end")
    asked = R.with_row_id(e, "item", "event_id").select(F.lit("h").alias("host"), F.concat(F.lit("/"), "item").alias("path"), (F.col("row_id") + 1).alias("attempt"), status.alias("status"), F.when(F.col("user_id") % 2 == 0, F.lit("<html>")).otherwise(F.lit("blocked")).alias("html"))
    return C.outcomes(asked, sane=["<html"], max_retries=3).select("path", "state", "attempts", "error_status")


@query("SELECT page_id, url AS deeplink, '2' AS depth, md5(html) AS page, page_id::VARCHAR AS own FROM pages")
def page_result_rows(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("values", F.create_map(F.lit("own"), F.col("page_id").cast("string"), F.lit("deeplink"), F.lit("old"))).withColumn("depth", F.lit(2))
    v = F.col("values")
    out = C.result_rows(rows.withColumn("host", F.regexp_extract("url", "^(https?://[^/]+)", 1)))
    return out.select("page_id", v["deeplink"].alias("deeplink"), v["crawlItem.depth"].alias("depth"), F.md5(v["originalPage"].cast("binary")).alias("page"), v["own"].alias("own"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name ELSE 'own' END AS name, 'kept' AS other FROM nation")
def page_rows_follow(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.create_map(F.lit("name"), F.lit("own"), F.lit("other"), F.lit("kept"), F.lit("link"), F.when(F.col("n_regionkey") == 2, F.concat(F.lit("$followurl$/n/"), "n_nationkey")).otherwise(F.lit("/n"))).alias("values"))
    pages = n.select(F.concat(F.lit("/n/"), "n_nationkey").alias("url"), F.create_map(F.lit("name"), "n_name", F.lit("other"), F.lit(" ")).alias("values"))
    out = C.overlay_rows(rows, pages)
    return out.select("n_nationkey", F.col("values")["name"].alias("name"), F.col("values")["other"].alias("other"))


_REQ = "SELECT user_id AS proxy, event_type <> 'error' AS ok, floor(value)::BIGINT AS ms FROM events"
_STATS = f"""SELECT proxy, count(*) FILTER (ok) AS gets, count(*) FILTER (NOT ok) AS faults, coalesce(sum(ms) FILTER (ok), 0) // greatest(count(*) FILTER (ok), 1) AS mean_ok_ms,
coalesce(sum(ms) FILTER (NOT ok), 0) // greatest(count(*) FILTER (NOT ok), 1) AS mean_fault_ms, sum(ms) // count(*) AS mean_ms, round(count(*) FILTER (NOT ok) / count(*), 6) AS fault_ratio FROM ({_REQ}) GROUP BY 1"""


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("proxy"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("bigint").alias("ms"))


@query(_STATS)
def proxy_stats(spark, sf_dir):
    return P.proxy_stats(_requests(spark, sf_dir)).withColumn("fault_ratio", F.round("fault_ratio", 6))


@query(f"SELECT proxy, row_number() OVER (PARTITION BY proxy % 4 ORDER BY gets + 50 * faults, proxy) AS place FROM ({_STATS})")
def proxy_least_loaded(spark, sf_dir):
    s = P.proxy_stats(_requests(spark, sf_dir)).withColumn("part", F.col("proxy") % 4)
    return P.ranked(s, P.least_loaded(s), "part").select("proxy", F.col("place").cast("bigint").alias("place"))


@query(f"SELECT proxy, row_number() OVER (PARTITION BY proxy % 4 ORDER BY (mean_ok_ms / log10(gets + 9) * (1 + faults / 2.0::DOUBLE))::FLOAT, proxy) AS place FROM ({_STATS})")
def proxy_fastest(spark, sf_dir):
    s = P.proxy_stats(_requests(spark, sf_dir)).withColumn("part", F.col("proxy") % 4)
    return P.ranked(s, P.fastest_first(s), "part").select("proxy", F.col("place").cast("bigint").alias("place"))


@query("SELECT '10.0.0.' || n_nationkey AS ip, 8000 + n_regionkey AS port, 1700000000000::BIGINT AS refreshed FROM nation")
def proxy_list(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.format_string("10.0.0.%d:%d", F.col("n_nationkey"), F.col("n_regionkey") + 8000).alias("value"))
    other = spark.createDataFrame([("lastRefreshTime=1700000000000",), ("no port",), ("1.2.3.4:x",), (":80",)], "value string")
    return L.parse_proxy_lines(lines.unionByName(other))


@query("SELECT page_id FROM pages WHERE page_id % 2 = 0 AND contains(html, '<html') AND NOT contains(html, 'idiot') AND page_id % 900 > 0 AND page_id % 900 < 150")
def proxy_latency(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("status", F.when(F.col("page_id") % 2 == 0, F.lit(200)).otherwise(F.lit(503))).withColumn("latency", F.col("page_id") % 900)
    return P.fast_enough(P.judged(p, ["<html"], ["idiot"], 150), 150).select("page_id")


@query("SELECT page_id, 0 + min(page_id) OVER () AS first FROM pages QUALIFY page_id = min(page_id) OVER ()")
def proxy_checkout(spark, sf_dir):
    s = _pages(spark, sf_dir).select(F.col("page_id").alias("proxy"), F.lit(0).alias("gets"), F.lit(0).alias("faults"), F.lit(0).alias("mean_ok_ms"), F.lit(5).alias("latency"))
    return P.checkout(s, P.fastest_first(s)).select(F.col("proxy").alias("page_id"), F.col("proxy").alias("first"))


@query("SELECT '10.0.0.' || n_nationkey || ':8' || n_regionkey AS address FROM nation")
def proxy_scraped(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.concat(F.lit(" 10.0.0."), "n_nationkey").alias("ip"), F.concat(F.lit("h"), F.translate(F.col("n_regionkey").cast("string"), "01", "zo")).alias("port"))
    return P.scraped(nodes.unionByName(nodes.select(F.lit(" ").alias("ip"), "port")), {"h": "8", "z": "0", "o": "1"})


@query("SELECT n_nationkey, '/dir' || n_regionkey || '//p' || n_nationkey AS path, '/a/' || n_nationkey AS other, 'h' AS host FROM nation")
def links_base_tag(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    page = lambda head, link: F.concat(F.lit(head), F.lit('<a href="'), F.lit(link), F.col("n_nationkey").cast("string"), F.lit('">x</a>'))
    based = n.select("n_nationkey", F.lit("h").alias("host"), F.concat(F.lit("/a/b/"), "n_nationkey").alias("path"), F.concat(F.format_string('<base href="http://o/dir%d/">', "n_regionkey"), page("", "p")).alias("html"))
    plain = n.select(F.lit("h").alias("host"), F.concat(F.lit("/a/b/"), "n_nationkey").alias("path"), page("", "./../").alias("html"))
    of = F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("n_nationkey")
    left, right = C.page_links(based).select(of, "host", F.col("link_path").alias("path2")), C.page_links(plain).select(of, F.col("link_path").alias("other"))
    return left.join(right, "n_nationkey").select("n_nationkey", F.col("path2").alias("path"), "other", "host")


@query("SELECT n_nationkey, '/x%' || lower(hex(33 + n_nationkey)) AS entity, '/a+b/A/' || replace(n_name, ' ', '+') || '?c d' AS encoded FROM nation")
def links_encoded(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", C.decode_entities(F.concat(F.lit("/x&#"), (F.col("n_nationkey") + 33).cast("string"), F.lit(";"))).alias("entity"), C.encode_path(F.concat(F.lit("/a b/%41/"), "n_name", F.lit("?c d"))).alias("encoded"))


@query("SELECT n_nationkey, '/main/' || n_nationkey AS link_path FROM nation")
def links_restricted(spark, sf_dir):
    html = F.format_string('<div id="nav"><a href="/nav/%d">n</a></div><div id="main"><p><a href="/main/%d">m</a></div>', "n_nationkey", "n_nationkey")
    pages = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(C.links(M.restrict(html, [".//div[@id='main']"]))).alias("l"))
    return pages.select("n_nationkey", F.col("l.href").alias("link_path"))


@query("SELECT CASE WHEN n_regionkey > 1 THEN 1 ELSE -1 END::DOUBLE AS label, count(*) AS n, sum(n_nationkey + 1)::DOUBLE AS first, sum(n_regionkey + 1)::DOUBLE AS third FROM nation GROUP BY 1")
def svm_libsvm_file(spark, sf_dir):
    path = scratch(spark, "libsvm")
    n = table(spark, sf_dir, "nation")
    n.select(F.format_string("%s 1:%d  3:%d", F.when(F.col("n_regionkey") > 1, F.lit("+1")).otherwise(F.lit("-1")), F.col("n_nationkey") + 1, F.col("n_regionkey") + 1)).write.text(path)
    v = S.vector_to_array("features")
    return L.read_libsvm(spark, path, 3).groupBy("label").agg(F.count("*").alias("n"), F.sum(v[0]).alias("first"), F.sum(v[2]).alias("third"))


@query("SELECT '10.1.0.' || n_nationkey AS ip, 9000 + n_regionkey AS port, 1700000000001::BIGINT AS refreshed FROM nation")
def proxy_list_file(spark, sf_dir):
    path = scratch(spark, "proxies")
    lines = table(spark, sf_dir, "nation").select(F.format_string("10.1.0.%d:%d", F.col("n_nationkey"), F.col("n_regionkey") + 9000).alias("value"))
    lines.unionByName(spark.createDataFrame([("lastRefreshTime=1700000000001",)], "value string")).write.text(path)
    return L.read_proxy_list(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def table_repaired(spark, sf_dir):
    path = scratch(spark, "damaged")
    table(spark, sf_dir, "nation").write.parquet(f"{path}/table")
    spark.createDataFrame([("not a table",)], "value string").coalesce(1).write.text(f"{path}/junk")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    junk = fs.Path(f"{path}/junk")
    bad = next(f.getPath() for f in junk.getFileSystem(conf).listStatus(junk) if f.getPath().getName().startswith("part"))
    junk.getFileSystem(conf).rename(bad, fs.Path(f"{path}/table/part-00000-bad.parquet"))
    return R.repair(spark, f"{path}/table", f"{path}/repaired").select("n_nationkey", "n_name")


@query("SELECT 'a' || chr(10) || 'b' || chr(10) || count(*) AS value FROM nation")
def text_file_whole(spark, sf_dir):
    path = scratch(spark, "text")
    n = table(spark, sf_dir, "nation").count()
    spark.createDataFrame([(f"a\r\nb\r{n}",)], "value string").coalesce(1).write.text(path, lineSep="\r\n")
    return L.read_whole(spark, f"{path}/part-*").select(F.regexp_replace("value", "\n$", "").alias("value"))


@query("SELECT '@relation r' || chr(10) || chr(10) || string_agg('@attribute ' || replace(n_name, ' ', 'KOMMA') || ' numeric' || chr(10), '' ORDER BY n_nationkey) || '@attribute class {class0,class1}' || chr(10) || chr(10) || '@data' || chr(10) AS header FROM nation")
def svm_arff_header(spark, sf_dir):
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.replace("n_name", F.lit(" "), F.lit(","))).collect()]
    return spark.createDataFrame([(S.arff_header("r", names, 2),)], "header string")


# sparse rows from the embeddings: entries of small size are absent
_ENTRIES = "(SELECT vec_id AS id, i AS idx, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i) WHERE abs(embedding[i]) >= 0.05)"
_RANGE = f"(SELECT idx, CASE WHEN count(*) < (SELECT count(*) FROM embeddings) THEN least(min(value), 0) ELSE min(value) END AS low, CASE WHEN count(*) < (SELECT count(*) FROM embeddings) THEN greatest(max(value), 0) ELSE max(value) END AS high FROM {_ENTRIES} GROUP BY 1)"


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "v"))
    return e.select("id", "label", (F.col("pos") + 1).alias("idx"), F.col("v").cast("double").alias("value")).where("abs(value) >= cast(0.05 as double)")


@query(f"SELECT id, idx, round(CASE WHEN v = low THEN -1 WHEN v = high THEN 1 ELSE -1 + 2 * (v - low) / (high - low) END, 6) AS value FROM (SELECT e.vec_id AS id, r.idx, r.low, r.high, coalesce(n.value, 0) AS v FROM embeddings e CROSS JOIN {_RANGE} r LEFT JOIN {_ENTRIES} n ON n.id = e.vec_id AND n.idx = r.idx) WHERE high > low AND CASE WHEN v = low THEN -1 WHEN v = high THEN 1 ELSE -1 + 2 * (v - low) / (high - low) END <> 0")
def svm_scale(spark, sf_dir):
    e, ids = _entries(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return S.apply_scale(e, ids, S.fit_scale(e, ids.count())).withColumn("value", F.round("value", 6))


@query(f"SELECT count(DISTINCT idx) AS n_features FROM {_ENTRIES}")
def svm_feature_count(spark, sf_dir):
    return S.feature_count(_entries(spark, sf_dir))


@query("SELECT event_type AS feature, row_number() OVER (ORDER BY min(event_id), event_type) AS idx FROM events GROUP BY 1")
def svm_features(spark, sf_dir):
    return S.feature_dictionary(table(spark, sf_dir, "events"), "event_type", "event_id").withColumn("idx", F.col("idx").cast("bigint"))


@query("SELECT (CASE WHEN label = 9 THEN 1 ELSE 0 END)::DOUBLE AS label, count(*) AS n FROM embeddings WHERE label IN (3, 9) GROUP BY 1")
def svm_training_set(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = S.training_set(e.where("label = 3").drop("label"), e.where("label = 9").drop("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


_W = "((idx * 37) % 11 - 5) / 10.0::DOUBLE"


@query(f"SELECT id, round(sum(w), 5) AS total, round(sum(abs(w)), 5) AS absolute, 50 + least(trunc(sum(w) / sum(abs(w)) * 100)::BIGINT, 50) AS confidence FROM (SELECT id, idx, {_W} * value AS w FROM {_ENTRIES}) GROUP BY 1")
def svm_explain(spark, sf_dir):
    w = spark.range(1, 65).select(F.col("id").cast("int").alias("idx"), (((F.col("id") * 37) % 11 - 5) / 10).alias("coefficient"))
    out = S.confidence(S.explain(_entries(spark, sf_dir), w))
    return out.select("id", F.round("total", 5).alias("total"), F.round("absolute", 5).alias("absolute"), "confidence")


_NUM = "regexp_replace(regexp_replace(printf('%.5f', round_even(value, 5)), '0+$', ''), '\\.$', '')"


@query(f"SELECT id, '{{' || coalesce(string_agg(idx || ' ' || {_NUM}, ',' ORDER BY idx), '') || ',65 class' || any_value(cls) || '}}' AS line FROM (SELECT e.vec_id AS id, e.label AS cls, n.idx, n.value FROM embeddings e LEFT JOIN (SELECT * FROM {_ENTRIES} WHERE value > 0) n ON n.id = e.vec_id) GROUP BY 1")
def svm_arff(spark, sf_dir):
    e = _entries(spark, sf_dir)
    rows = e.groupBy("id").agg(F.first("label").alias("cls"), F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("entries"))
    return S.arff_lines(rows, 64)


@query()
def svm_linear_cv(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label in (3, 9)")
    rows = S.vectors(e.withColumn("label", (F.col("label") == 9).cast("double")), "embedding").select("vec_id", "label", "features")
    return S.correct(S.cross_validate(rows, "vec_id", folds=3)[0])


@query(f"SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY {_W} * value DESC, idx) AS place FROM {_ENTRIES}")
def svm_explain_sorted(spark, sf_dir):
    w = spark.range(1, 65).select(F.col("id").cast("int").alias("idx"), (((F.col("id") * 37) % 11 - 5) / 10).alias("coefficient"))
    return S.by_weight(S.explain(_entries(spark, sf_dir), w)).select("id", "idx", F.col("place").cast("bigint").alias("place"))


@query(f"SELECT idx, round(low, 6) AS low, round(high, 6) AS high FROM {_RANGE}")
def svm_scale_saved(spark, sf_dir):
    path = scratch(spark, "scale")
    S.save_table(table(spark, sf_dir, "nation"), path)  # what was there goes
    S.save_table(S.fit_scale(_entries(spark, sf_dir), table(spark, sf_dir, "embeddings").count()), path)
    return S.load_table(spark, path).select("idx", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT event_type AS feature, row_number() OVER (ORDER BY min(event_id), event_type) AS idx FROM events GROUP BY 1")
def svm_features_saved(spark, sf_dir):
    path = scratch(spark, "features")
    S.save_table(svm_features(spark, sf_dir), path)
    return S.load_table(spark, path)


def _separable(spark, sf_dir):
    """Rows whose class is the sign of their first component, without those near the border."""
    e = table(spark, sf_dir, "embeddings").where("abs(embedding[0]) > 0.05")
    return S.vectors(e.withColumn("label", (F.col("embedding")[0] > 0).cast("double")), "embedding").select("vec_id", "label", "features")


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END::DOUBLE AS prediction, true AS sure, 2 AS n FROM embeddings WHERE abs(embedding[1]) > 0.05")
def svm_probabilities(spark, sf_dir):
    rows, path = _separable(spark, sf_dir), scratch(spark, "model")
    S.save_model(S.train_probabilities(rows), path)
    p = F.col("probabilities")
    return S.probabilities(S.load_model(path), rows).select("vec_id", "prediction", ((p[F.col("prediction").cast("int")] > 0.5) & (F.abs(p[0] + p[1] - 1) < 1e-9)).alias("sure"), F.size(p).alias("n"))


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END::DOUBLE AS prediction, 64 AS n_features FROM embeddings WHERE abs(embedding[1]) > 0.05")
def svm_linear(spark, sf_dir):
    rows, path = _separable(spark, sf_dir), scratch(spark, "model")
    S.save_model(S.train_linear(rows), path)
    model = S.load_model(path)
    return model.transform(rows).select("vec_id", "prediction", F.lit(S.accessors(model)["n_features"]).alias("n_features"))


def _samples(df):
    return df.select("ts", F.col("event_type").alias("metric"), F.floor("value").cast("bigint").alias("value"))


def _stream(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    work = scratch(spark, "stream")
    U.run_to_files(_samples(spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)), f"{work}/out", f"{work}/state", "1 day", "1 day")
    return work, _samples(batch)


@query()
def stream_bucket_stats(spark, sf_dir):
    work, batch = _stream(spark, sf_dir)
    return U.flushed(spark, f"{work}/out", batch, "1 day")


ORACLES["stream_bucket_stats"] = _STATS_SQL
#: days that end at least the lateness before the newest event
_CLOSED = f"SELECT * FROM ({_STATS_SQL}) WHERE bucket + 86400000 <= (SELECT max(epoch_us(ts)) // 1000 - 86400000 FROM events)"


@query(_CLOSED)
def stream_closed(spark, sf_dir):
    """What the stream alone has written."""
    return U.closed(spark, f"{_stream(spark, sf_dir)[0]}/out")


@query(_CLOSED)
def stream_late_rows(spark, sf_dir):
    """Rows of long closed days that come in a later batch, after a restart, change nothing."""
    batch, work = table(spark, sf_dir, "events"), scratch(spark, "late")
    run = lambda: U.run_to_files(_samples(spark.readStream.schema(batch.schema).parquet(f"{work}/in")), f"{work}/out", f"{work}/state", "1 day", "1 day")
    batch.write.parquet(f"{work}/in")
    run()
    batch.where("ts < timestamp_ntz'2024-01-04'").write.mode("append").parquet(f"{work}/in")
    run()
    return U.closed(spark, f"{work}/out")
