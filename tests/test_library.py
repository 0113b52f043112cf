"""Behaviours and traps that the queries over the tables do not reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import markup, strings, timing
from millrace.operators import crawl, explorer, svm, tables, usage
from millrace.plans.running import running
from millrace.queries import ORACLES, QUERIES
from millrace.sources import records, stats, texts
from millrace.streaming import usage as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_merge_of_two_stores(spark):
    left, right = {2: 2, 4: 4, 5: 5}, {1: 1, 2: 2, 3: 3, 4: 4}
    rows = [(i, b, 3, "Sum", v) for i, s in enumerate((left, right)) for b, v in s.items()]
    df = spark.createDataFrame(rows, "shard int, bucket bigint, metric int, how string, value bigint")
    assert {r.bucket: r.value for r in usage.merge_shards(df).collect()} == {1: 1, 2: 4, 3: 3, 4: 8, 5: 5}
    tail = spark.createDataFrame([(0, b, 3, "Sum", 1) for b in (2, 4)] + [(1, b, 3, "Sum", 1) for b in (1, 2, 5, 6)], df.schema)
    assert sorted(r.bucket for r in usage.merge_shards(tail).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r.bucket for r in usage.merge_shards(tail, compat=True).collect()) == [1, 2, 4]
    assert usage.merge_shards(tail.where("shard = 9")).count() == 0
    p = spark.createDataFrame([(0, 1, 3, "Percentile90", 10, 1.0), (1, 1, 3, "Percentile90", 20, 3.0)], "shard int, bucket bigint, metric int, how string, value bigint, weight double")
    assert usage.merge_shards(p).first().value == 18
    assert usage.merge_shards(p.drop("weight")).first().value == 15


def test_percentiles_take_the_element_at_the_index(spark):
    df = spark.range(1, 11).select(F.lit(0).alias("bucket"), F.lit("m").alias("metric"), F.col("id").alias("value"))
    r = usage.bucket_stats(df).first()
    assert (r.p90_value, r.p99_value, r.sum_value) == (10, 10, 55)
    assert usage.bucket_stats(df.withColumn("value", -F.col("value"))).first().max_value == 0
    with pytest.raises(ValueError):
        usage.aggregate("1", "Median")


def test_stat_store(spark, tmp_path):
    path = str(tmp_path / "stats")
    assert stats.read_stats(spark, path).count() == 0
    day = 1_700_000_000_000
    stats.append_stats(spark.createDataFrame([(day, [1, 2]), (day + 86_400_000, [3])], "t bigint, data array<bigint>"), path)
    stats.append_startup_marker(spark, path, day + 5)
    assert [r.day for r in stats.stat_days(spark, path).collect()] == ["2023-11-15", "2023-11-14"]
    data, markers = usage.split_markers(stats.read_stats(spark, path, "2023-11-14"))
    assert [r.data for r in data.collect()] == [[1, 2]] and markers.count() == 1


@pytest.mark.parametrize("ms, text", [(0, "0 ms"), (999, "999 ms"), (1000, "1.0 s"), (59999, "59.999 s"), (60000, "01:00.0 min"), (478871, "07:58.871 min"), (3600000, "01:00:00.0 h"), (86400000, "1 day 0 ms"), (2 * 86400000 + 3723004, "2 days 01:02:03.004 h"), (-1500, "-1.5 s"), (61050, "01:01.05 min")])
def test_durations(spark, ms, text):
    assert one(spark, timing.human_duration(F.lit(ms))) == text


def test_strings(spark):
    f = F.lit
    assert one(spark, strings.split_char(f("a,b,,"), ",")) == ["a", "b"] and one(spark, strings.split_char(f(""), ",")) == [] and one(spark, strings.split_char(f(",a"), ",")) == ["", "a"]
    assert one(spark, strings.join_array(F.array(f("a"), f(None)), ",")) == "a,null"
    assert one(spark, strings.tokenize(f("a;,b"), ";,")) == ["a", "b"] and one(spark, strings.tokenize(f("a;,b"), ";,", True)) == ["a", ";", ",", "b"]
    assert one(spark, strings.tokenize(f(None).cast("string"), ",")) == []
    assert one(spark, strings.replace_all(f("abcab"), ["ab", "a", "b"], ["b", "x"])) == "bcb" and one(spark, strings.replace_all(f("b"), ["a", "b"], ["x"])) == "\0"
    with pytest.raises(ValueError):
        strings.replace_all(f("a"), ["a"], ["b", "c"])
    text = "a\\t\tb\n\\"
    assert one(spark, strings.escape(f(text))) == "a\\\\t\\tb\\n\\\\" and one(spark, strings.unescape(strings.escape(f(text)))) == text
    assert one(spark, strings.unescape(f("a\\xb\\"))) == "ab"
    assert one(spark, strings.trim_to_null(f(" \t\x01"))) is None and one(spark, strings.trim_to_null(f("\x00 a b\n"))) == "a b"
    assert [one(spark, strings.center_crop(f(s), n)) for s, n in (("abcdef", 3), ("abcde", 2), ("ab", 5), ("abc", 0))] == ["cde", "bc", "ab", ""]
    assert one(spark, strings.left_tab(f("ab"), 6, "xy")) == "abxyxy" and one(spark, strings.right_tab(f("ab"), 5, "xy")) == "yxyab"[-5:]
    assert one(spark, strings.center_tab(f("ab"), 5)) == " ab  "
    assert one(spark, strings.hex_dump(f("AB\n"))) == "41 42 0a " + " " * 39 + " AB."
    assert one(spark, strings.hex_dump(f("x" * 16))) == "78 " * 16 + " " + "x" * 16 + "\n"
    assert one(spark, strings.indent(f("a\nb"), "> ")) == "> a\n> b"
    assert one(spark, strings.levenshtein(f("abcdef"), f("abc"))) == 3 and one(spark, strings.levenshtein(f("abcdef"), f("abc"), 2)) == strings.FAR
    assert one(spark, strings.replace_one(f("aba"), "a", None)) == "\0b\0" and one(spark, strings.not_null(f(None).cast("string"), "x")) == "x"


def absolute(spark, link, path="/a/b/page.html?x", compat=False):
    return tuple(one(spark, crawl.absolute(F.lit(link), F.lit("h"), F.lit(path), crawl.directory(F.lit(path)), compat)))


@pytest.mark.parametrize(
    "link, want, compat",
    [("/x/../y", ("h", "/y", None), ("h", "/x/../y", None)), ("c", ("h", "/a/b/c", None), None), ("./c/", ("h", "/a/b/c/", None), None), ("../c", ("h", "/a/c", None), None),
     ("../../c", ("h", "/c", None), ("h", "/a/b/c", None)), ("?q=1", ("h", "/a/b/page.html?q=1", None), None), ("https://o.org", ("o.org", "/", "https"), ("https://o.org", "/", "https")),
     ("http://o.org/p?q", ("o.org", "/p?q", "http"), None), ("//o.org/p", ("o.org", "/p", None), ("h", "//o.org/p", None)), ("..", ("h", "/a/", None), ("h", "/a", None))],
)
def test_urls(spark, link, want, compat):
    assert absolute(spark, link) == want
    if compat:
        assert absolute(spark, link, compat=True) == compat


def test_links_and_base(spark):
    html = '<base href="http://o.org/dir/"><a class=x\n href="p&#124;q&amp;r s">  La\nbel </a><A HREF="/z"/>'
    got = spark.createDataFrame([("h", "/a/b", html)], "host string, path string, html string")
    rows = [(r.link_host, r.link_path, r.label) for r in crawl.page_links(got).collect()]
    assert rows == [("h", "/dir//p%7cq&r+s", "Label"), ("h", "/z", "")]
    assert one(spark, crawl.encode_path(F.lit("/a b/%41?c d"))) == "/a+b/A?c d"
    assert one(spark, crawl.follows(F.lit("/ab"), ["/a"])) is False
    assert one(spark, crawl.post_request(F.lit("/p?a=1&b:POST"))).asDict(True) == {"url": "/p", "form": [{"name": "a", "value": "1"}, {"name": "b", "value": ""}]}


def test_crawl_of_a_small_graph(spark):
    link = lambda *to: "".join(f'<a href="{t}">{t}</a>' for t in to)
    pages = spark.createDataFrame([("h", "/1", link("2", "3", "2", "/no")), ("h", "/2", link("./1", "4")), ("h", "/3", link("../4", "?q")), ("h", "/4", link("1")), ("h", "/9", link("1"))], "host string, path string, html string")
    got = crawl.crawl(pages, spark.createDataFrame([("h", "/1")], "host string, path string"), [".*"], ["/no"])
    assert sorted((r.path, r.depth, r.parent) for r in got.collect()) == [("/1", 0, None), ("/2", 1, "/1"), ("/3", 1, "/1"), ("/3?q", 2, "/3"), ("/4", 2, "/2")]


def test_markup(spark):
    df = spark.createDataFrame([("<table><tr><td class=a>1<td>2</tr><tr><td class=a>3</table>",), (None,)], "h string")
    got = [r[0] for r in df.select(markup.extract(F.col("h"), {"a": "./td[@class='a']", "c": ".//td@class"}, ".//tr")).collect()]
    assert [m["c"] for m in got[0]] == ["a", "a"] and got[0][1]["a"] == "3" and got[1] == []
    xml = "<r><x><n>1</n><n>2\xa0</n></x><e/><y>t</y></r>"
    assert one(spark, markup.xml_rows(F.lit(xml))) == [{"n": "2 "}, {"#text": "t"}] and one(spark, markup.xml_rows(F.lit("<r>"))) == []
    raw = F.lit(bytearray("<meta charset=iso-8859-1>€".encode("cp1252")))
    assert one(spark, markup.decode_page(raw, F.lit("utf-8"))).endswith("€")
    assert one(spark, markup.decode_page(F.lit(bytearray("﻿ü".encode())), F.lit("x" * 20))) == "ü"
    assert one(spark, markup.indent_xml(F.lit("<a><b/></a>"))) == "<a>\n  <b />\n</a>" and one(spark, markup.indent_xml(F.lit("<a"))) == "<a"
    assert [tuple(x) for x in one(spark, markup.first_matches(F.lit("/*a*/ 12"), {"comment": r"/\*.*?\*/", "word": "[a-z]+", "n": "[0-9]+"}))] == [("comment", 0, "/*a*/"), ("n", 6, "12")]


def test_restricted_links(spark):
    html = '<div id="nav"><a href="/n">n</a></div><div id="main"><p><a href="/m">m</a></div>'
    df = spark.createDataFrame([("h", "/", html)], "host string, path string, html string")
    kept = df.withColumn("html", markup.restrict(F.col("html"), [".//div[@id='main']"]))
    assert [r.link_path for r in crawl.page_links(kept).collect()] == ["/m"]


def test_repair(spark, tmp_path):
    source = tmp_path / "t"
    spark.range(10).repartition(2).write.parquet(str(source))
    (source / "part-00000-bad.parquet").write_bytes(b"PAR1 not a table PAR1")
    assert records.repair(spark, str(source), str(tmp_path / "fixed")).count() == 10
    with pytest.raises(ValueError):
        records.with_row_id(spark.range(1))
    assert [r.row_id for r in records.with_row_id(spark.range(50).repartition(7), "id").orderBy("id").collect()] == list(range(50))
    numbered = records.with_row_id(spark.range(6).selectExpr("id % 2 as k", "id"), "k", "id")
    assert sorted((r.k, r.row_id) for r in numbered.collect()) == [(k, i) for k in (0, 1) for i in range(3)]


def test_explorer_and_tables(spark):
    df = spark.createDataFrame([(1, "a", 1.5, [1, 2], None), (2, None, None, None, None)], "i int, s string, d double, l array<int>, m map<string,int>")
    assert [explorer.lookup(df, c, k).count() for c, k in (("i", "1"), ("i", ""), ("i", "99999999999"), ("s", "a"), ("d", "1.5"), ("d", "x"))] == [1, 0, 0, 1, 1, 0]
    assert [r[0] for r in df.select(explorer.cell_text(df, "l")).collect()] == ["{1, 2}", ""]
    with pytest.raises(ValueError):
        explorer.sort_by(df, "m")
    assert [r.i for r in explorer.sort_by(df, "s").collect()] == [2, 1] and [r.i for r in explorer.sort_by(df, "s", False).collect()] == [1, 2]
    assert [one(spark, explorer.size_text(F.lit(n))) for n in (512, 513, 600_000, 600_000_000)] == ["512 B", "0 kB", "0 MB", "0 GB"]
    with pytest.raises(ValueError):
        tables.ordered([tables.ColumnSpec("a", F.lit(1)), tables.ColumnSpec("a", F.lit(2))])
    assert one(spark, timing.older_than(F.lit(datetime.datetime(2024, 1, 1)), 1, F.lit(datetime.datetime(2024, 1, 2)))) is False


def test_svm(spark, tmp_path):
    rows = [(1, 1, 1.0), (1, 2, 5.0), (2, 1, 3.0), (2, 2, 5.0), (3, 1, 2.0), (1, 3, 4.0), (2, 3, 4.0), (3, 3, 4.0)]
    e = spark.createDataFrame(rows, "id int, idx int, value double")
    ids = e.select("id").distinct()
    got = svm.apply_scale(e, ids, svm.fit_scale(e, 3))
    assert sorted(map(tuple, got.collect())) == [(1, 1, -1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 2, -1.0)]
    file = tmp_path / "x.train"
    file.write_text("+1 1:0.5  3:2\n-1 2:1\n")
    back = texts.read_libsvm(spark, str(file)).collect()
    assert [(r.label, r.features.size, list(r.features.indices)) for r in back] == [(1.0, 3, [0, 2]), (-1.0, 3, [1])]
    assert svm.arff_header("r", ["a,b", "c"], 2) == "@relation r\n\n@attribute aKOMMAb numeric\n@attribute c numeric\n@attribute class {class0,class1}\n\n@data\n"
    lines = spark.createDataFrame([(1, 0, [(1, -2.0), (2, 0.1234567), (3, 7.0)])], "id int, cls int, entries array<struct<idx:int,value:double>>")
    assert svm.arff_lines(lines, 3).first().line == "{2 0.12346,3 7,4 class0}" and svm.arff_lines(lines, 3, False).first().line == "{1 -2,2 0.12346,3 7,4 class0}"
    model = svm.train_linear(svm.vectors(spark.createDataFrame([(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])] * 5, "label double, v array<double>"), "v"))
    model.save(str(tmp_path / "model"))
    from pyspark.ml.classification import LinearSVCModel

    assert LinearSVCModel.load(str(tmp_path / "model")).coefficients == model.coefficients


def test_trees_of_any_depth(spark):
    rows = [("n0", None, True)] + [(f"n{i}", f"n{i - 1}", False) for i in range(1, 36)] + [("r", None, False), ("x", "r", False), ("c1", "c2", True), ("c2", "c1", False)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, hit boolean")
    assert {r.id for r in tables.tree_filter(nodes, F.col("hit")).collect()} == {f"n{i}" for i in range(36)} | {"r", "c1", "c2"}
    assert {r.id for r in tables.tree_filter(nodes, F.col("id") == "n35").collect()} == {f"n{i}" for i in range(36)} | {"r"}


def test_outcomes_of_requests(spark):
    rows = [("h", "/a", 1, 503, "x"), ("h", "/a", 2, 200, "<p>"), ("h", "/b", 1, 200, "bad"), ("h", "/b", 2, 500, None), ("h", "/b", 3, 200, "<p>"), ("h", "/c", 1, None, None), ("h", "/d", 1, 404, "<p>"), ("h", "/e", 1, 200, "again <p>"), ("h", "/e", 2, 200, "bad")]
    asked = spark.createDataFrame(rows, "host string, path string, attempt int, status int, html string")
    got = lambda **o: {r.path: (r.state, r.attempts, r.error_status) for r in crawl.outcomes(asked, ["<p>"], ["bad"], ["again"], **o).collect()}
    assert got(max_retries=2) == {"/a": ("ok", 2, None), "/b": ("failed", 2, 500), "/c": ("retry", 1, None), "/d": ("ok", 1, None), "/e": ("failed", 2, None)}
    assert got() == {"/a": ("failed", 1, 503), "/b": ("failed", 1, None), "/c": ("failed", 1, None), "/d": ("ok", 1, None), "/e": ("failed", 1, None)}
    assert got(use_proxies=True)["/b"] == ("ok", 3, None)


def test_running_sums_and_positions(spark):
    df = spark.range(0, 200, 1, 9).select((F.col("id") * 37 % 200).alias("k"), F.col("id").alias("before0"), F.lit(2).alias("part"))
    got = running(df, [F.col("k")], "at", {"sum": F.col("k")}).orderBy("k").collect()
    assert [(r.at, r["sum"], r.before0 * 37 % 200, r.part) for r in got] == [(k, k * (k + 1) // 2, k, 2) for k in range(200)]
    assert running(df.limit(0), [F.col("k")], "at").count() == 0
    assert [r.row_id for r in records.positions(df.orderBy(F.desc("k"))).orderBy(F.desc("k")).collect()] == list(range(200))


def test_models_and_what_they_hold(spark, tmp_path):
    rows = svm.vectors(spark.createDataFrame([(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])] * 5, "label double, v array<double>"), "v")
    plain, sure = svm.train_linear(rows), svm.train_probabilities(rows)
    with pytest.raises(ValueError):
        svm.probabilities(plain, rows)
    assert all(max(r.probabilities) > 0.9 and r.prediction == r.label for r in svm.probabilities(sure, rows).collect())
    held = svm.accessors(sure)
    assert (held["n_classes"], held["labels"], held["n_features"]) == (2, [0.0, 1.0], 2) and held["parameters"]["maxIter"] == 50
    assert [r.idx for r in svm.weight_table(plain, spark).collect()] == [1, 2]
    svm.save_model(plain, str(tmp_path / "m"))
    svm.save_model(sure, str(tmp_path / "m"))
    assert svm.load_model(str(tmp_path / "m")).coefficients == sure.coefficients


def test_stream_by_interval_with_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda m, v: (datetime.datetime(2024, 1, 1, 0, m), "x", v)
    put = lambda *rows: spark.createDataFrame(list(rows), "ts timestamp, metric string, value bigint").coalesce(1).write.mode("append").parquet(source)
    seen = []

    def run():
        q = stream.start(spark.readStream.schema("ts timestamp, metric string, value bigint").parquet(source), out, state, listener=lambda rows, i: seen.append(i), every="1 second")
        q.processAllAvailable()
        q.stop()

    put(at(0, 5), at(0, 7), at(9, 1))
    run()
    put(at(0, 100), at(20, 1))  # the first is late by then
    run()
    got = {r.bucket // 60_000 % 60: r.sum_value for r in stream.closed(spark, out).collect()}
    assert got == {0: 12, 9: 1} and seen == sorted(seen)


def test_small_helpers(spark):
    assert one(spark, markup.indent_xml(F.lit("<a><!-- c --><b/></a>"))) == "<a>\n  <!-- c -->\n  <b />\n</a>"
    summer = F.lit("2024-07-01 12:00:00").cast("timestamp")
    assert one(spark, timing.zone_offset_ms(summer, "Europe/Berlin")) == 7_200_000
    with pytest.raises(ValueError):
        timing.field(summer, "era")


def test_references_without_a_semicolon_stay(spark):
    html = "<title>a&amp; b&amp</title><script>1 &amp;&lt x</script><a href='?a=1&copy=2&amp;c=3' t='&auml;&quot'>&lt &lt; &notit; &amp;amp; &#228;&#xe4; &#228 &#" + "9" * 5000 + ";</a>&am"
    got = one(spark, markup.extract(F.lit(html), {"title": ".//title", "script": ".//script", "href": ".//a@href", "t": ".//a@t", "a": ".//a", "all": "."}))[0]
    assert got["title"] == "a& b&amp" and got["script"] == "1 &amp;&lt x" and got["href"] == "?a=1&copy=2&c=3" and got["t"] == "ä&quot"
    assert got["a"] == "&lt < &notit; &amp; ää &#228 &#" + "9" * 5000 + ";" and got["all"].endswith(";&am")


def test_page_to_rows_as_its_sql(spark, tmp_path):
    import duckdb

    heads = ["<title>a&amp;&amp</title>", "<title> &lt;b&gt; &quot;&#39;&amp;lt; &quo</title>", "<TITLE>c&lt</TITLE>", "<title>d</title><svg><title>e</title></svg>", "<p>no title", "", None, "<title></title>"]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["page_to_rows"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.title) for r in got) == sorted(duckdb.sql(ORACLES["page_to_rows"]).fetchall())
