"""Pages as a dataflow: link extraction, URL resolution, follow rules, validation and level-by-level expansion."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import interleave
from millrace.plans.lineage import cut

# fixed values: the patterns that decide what counts as a link and as a base
HREF = r'(?i)<a .*?href="(.*?)"[^>]*?(?:>(?s)(.{0,2500}?)</a|/>)'
BASE = r'(?i)<base.+?href="(.*?)".*?>'


def links(html: Column) -> Column:
    """Array of (href, label) of a page, in order."""
    flat = F.regexp_replace(html, r"\r?\n", "")
    pair = F.arrays_zip(F.regexp_extract_all(flat, F.lit(HREF), F.lit(1)).alias("href"), F.regexp_extract_all(flat, F.lit(HREF), F.lit(2)).alias("label"))
    return F.transform(pair, lambda p: F.struct(decode_entities(p["href"]).alias("href"), F.trim(F.coalesce(p["label"], F.lit(""))).alias("label")))


def decode_entities(url: Column) -> Column:
    """``&#n;`` as percent and hexadecimal digits."""
    return interleave(url, r"&#[0-9]{1,18};", lambda m: F.concat(F.lit("%"), F.lower(F.hex(F.regexp_replace(m, "[^0-9]", "").cast("bigint")))))


def normalise(path: Column) -> Column:
    out = F.replace(F.replace(F.trim(path), F.lit(" "), F.lit("+")), F.lit("|"), F.lit("%7C"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def remove_dots(path: Column) -> Column:
    """Dot segments resolved from the left, as RFC 3986 says; a trailing slash stays."""
    empty = F.array().cast("array<string>")
    done = F.aggregate(
        F.split(path, "/", -1), empty,
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.array_join(done, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def _skip_dots(path: Column) -> Column:
    """From the right, ``..`` drops the segment before it whatever that is; ``.`` and the first segment go."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    parts = F.reverse(F.slice(F.split(F.regexp_replace(path, "/+$", ""), "/", -1), 2, 1 << 20))

    def step(s, x):
        stay = F.struct(s["out"].alias("out"), F.lit(False).alias("skip"))
        add = F.struct(F.concat(F.array(x), s["out"]).alias("out"), F.lit(False).alias("skip"))
        return F.when(s["skip"] | (x == "."), stay).when(x == "..", F.struct(s["out"].alias("out"), F.lit(True).alias("skip"))).otherwise(add)

    return F.concat(F.aggregate(parts, start, step, lambda s: F.array_join(F.transform(s["out"], lambda x: F.concat(F.lit("/"), x)), "")), F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit("")))


def directory(path: Column) -> Column:
    """The path without query and last segment, and without its slash."""
    return F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), "/[^/]*$", "")


def base_directory(html: Column, otherwise: Column) -> Column:
    """The directory that links are relative to: the page's base tag, else ``otherwise``."""
    base = F.regexp_extract(html, BASE, 1)
    path = F.when(base.contains("//"), F.regexp_extract(base, "//[^/]+(/.*)?$", 1)).otherwise(base)
    return F.when(base == "", otherwise).otherwise(F.when(path == "/", F.lit("")).otherwise(path))


def absolute(link: Column, host: Column, path: Column, path_dir: Column, compat: bool = False) -> Column:
    """(host, path, scheme) of a normalised link on the page ``path`` of ``host``; scheme is null if the link names none.

    ``compat``: a link of only scheme and host gives the whole link as host, ``//h/x`` is a path of the page's
    host, and dot segments are taken from the right, where ``..`` drops whatever stands before it.
    """
    scheme = F.regexp_extract(link, "^(https?)://", 1)
    full = F.struct(
        (F.when(link.rlike("^https?://[^/]*$"), link) if compat else F.when(F.lit(False), link)).otherwise(F.regexp_extract(link, "^https?://([^/?]*)", 1)).alias("host"),
        F.when(link.rlike("^https?://[^/]*/" if compat else "^https?://[^/?]*/"), F.regexp_extract(link, "^https?://[^/]*(/.*)$", 1)).when(link.rlike(r"^https?://[^/]*\?") & F.lit(not compat), F.concat(F.lit("/"), F.regexp_extract(link, r"^https?://[^/?]*(\?.*)$", 1))).otherwise(F.lit("/")).alias("path"),
        scheme.alias("scheme"),
    )
    here = lambda p: F.struct(host.alias("host"), p.alias("path"), F.lit(None).cast("string").alias("scheme"))
    name = F.regexp_extract(path, r"([^/?]*)(\?.*)?$", 1)
    relative = F.concat(path_dir, F.lit("/"), F.when(link.startswith("?"), F.concat(name, link)).otherwise(link))
    if compat:
        return F.when(link.startswith("/"), here(link)).when(scheme != "", full).otherwise(here(_skip_dots(relative)))
    tidy = lambda p: F.concat(remove_dots(F.regexp_extract(p, r"^([^?]*)", 1)), F.regexp_extract(p, r"(\?.*)$", 1))
    other = F.struct(F.regexp_extract(link, "^//([^/?]*)", 1).alias("host"), F.when(link.rlike("^//[^/?]*/"), tidy(F.regexp_extract(link, "^//[^/?]*(/.*)$", 1))).otherwise(F.lit("/")).alias("path"), F.lit(None).cast("string").alias("scheme"))
    return F.when(link.startswith("//"), other).when(link.startswith("/"), here(tidy(link))).when(scheme != "", full).otherwise(here(tidy(relative)))


def encode_path(path: Column) -> Column:
    """Every segment decoded and encoded again; the query is left alone."""
    body = F.transform(F.split(F.regexp_extract(path, r"^([^?]*)", 1), "/", -1), lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x)))
    return F.concat(F.array_join(body, "/"), F.regexp_extract(path, r"(\?.*)$", 1))


def _any(patterns: list[str], test) -> Column:
    return reduce(lambda a, b: a | b, map(test, patterns), F.lit(False))


def follows(path: Column, follow: list[str], dont_follow: list[str] = ()) -> Column:
    """Whether the whole path matches a pattern of ``follow`` and none of ``dont_follow``."""
    whole = lambda p: path.rlike(rf"\A(?:{p})\z")
    return _any(list(follow), whole) & ~_any(list(dont_follow), whole)


def sanity(html: Column, sane: list[str] = (), insane: list[str] = (), retry: list[str] = ()) -> Column:
    """``insane`` if a sane pattern is missing or an insane one found, else ``retry`` if such is found, else ``ok``."""
    bad = _any(list(sane), lambda p: ~html.rlike(p)) | _any(list(insane), html.rlike)
    return F.when(bad, F.lit("insane")).when(_any(list(retry), html.rlike), F.lit("retry")).otherwise(F.lit("ok"))


def rewrite(html: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expressions replaced one rule after the other."""
    return reduce(lambda h, r: F.regexp_replace(h, *r), rules, html)


def accepted(status: Column) -> Column:
    return status.isin(200, 404)


def post_request(url: Column) -> Column:
    """(url, form) of a ``:POST`` url: its query becomes the form's fields, in order; form is null for other urls."""
    bare = F.regexp_replace(url, ":POST$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, r"\?([^?]*)$", 1), "&"), lambda p: p.rlike("^=*[^=]"))
    form = F.transform(fields, lambda p: F.struct(F.regexp_extract(p, "^=*([^=]*)", 1).alias("name"), F.regexp_extract(p, "^=*[^=]*=+([^=]*)", 1).alias("value")))
    return F.when(url.endswith(":POST"), F.struct(F.regexp_replace(bare, r"(?<=.)\?[^?]*$", "").alias("url"), form.alias("form"))).otherwise(F.struct(url.alias("url"), F.lit(None).cast("array<struct<name:string,value:string>>").alias("form")))


def page_links(pages: DataFrame, compat: bool = False) -> DataFrame:
    """(host, path, link_host, link_path, scheme, label) for every link of pages (host, path, html)."""
    found = pages.select("host", "path", base_directory(F.col("html"), directory(F.col("path"))).alias("dir"), F.explode(links(F.col("html"))).alias("l"))
    to = absolute(normalise(F.col("l.href")), F.col("host"), F.col("path"), F.col("dir"), compat)
    return found.select("host", "path", to.alias("to"), "l.label").select("host", "path", F.col("to.host").alias("link_host"), F.col("to.path").alias("link_path"), "to.scheme", "label")


def crawl(pages: DataFrame, seeds: DataFrame, follow: list[str], dont_follow: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """(host, path, label, depth, parent) of all items reached from ``seeds`` (host, path) over the links of ``pages``.

    An item is a (host, path) and is reached once, at its least depth; a page that is not in ``pages`` has no
    links. The parent and label are the smallest of those that reach it first. Levels follow until none is new,
    or up to ``max_depth`` where that is given.
    """
    link = cut(page_links(pages).where(follows(F.col("link_path"), follow, dont_follow)))
    none = F.lit(None).cast("string")
    level = cut(seeds.select("host", "path").distinct().select("host", "path", none.alias("label"), F.lit(0).alias("depth"), none.alias("parent")))
    seen = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        out = link.join(level.select("host", "path"), ["host", "path"])
        best = F.min(F.struct(F.col("path").alias("parent"), "label"))
        new = out.groupBy(F.col("link_host").alias("host"), F.col("link_path").alias("path")).agg(best.alias("b")).join(seen.select("host", "path"), ["host", "path"], "left_anti")
        level = cut(new.select("host", "path", "b.label", F.lit(depth).alias("depth"), "b.parent"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return seen


def outcomes(attempts: DataFrame, sane: list[str] = (), insane: list[str] = (), retry: list[str] = (), max_retries: int = -1, use_proxies: bool = False) -> DataFrame:
    """(host, path, state, attempts, error_status, html): what became of each item, from requests (host, path, attempt, status, html).

    An item is tried ``max_retries`` times, or 20 times with proxies and once without where that is not above
    zero; later attempts do not count. The first accepted and sane answer makes it ``ok`` and gives its page. Else it is
    ``retry`` while attempts are left, to be asked for again, and then ``failed``: the error list. error_status
    is the last answer's status if that was the trouble, else null.
    """
    limit = max_retries if max_retries > 0 else 20 if use_proxies else 1
    good = accepted(F.col("status")) & (sanity(F.coalesce("html", F.lit("")), sane, insane, retry) == "ok")
    tried = attempts.where(F.col("attempt") <= limit).withColumn("good", F.coalesce(good, F.lit(False)))
    out = tried.groupBy("host", "path").agg(
        F.min(F.when(F.col("good"), F.col("attempt"))).alias("won"), F.count("*").alias("tries"),
        F.max_by(F.when(~F.coalesce(accepted(F.col("status")), F.lit(False)), F.col("status")), "attempt").alias("last"), F.min_by(F.when(F.col("good"), F.col("html")), F.when(F.col("good"), F.col("attempt"))).alias("html"),
    )
    ok = F.col("won").isNotNull()
    state = F.when(ok, F.lit("ok")).when(F.col("tries") < limit, F.lit("retry")).otherwise(F.lit("failed"))
    return out.select("host", "path", state.alias("state"), F.when(ok, F.col("won")).otherwise(F.col("tries")).cast("bigint").alias("attempts"), F.when(~ok, F.col("last")).alias("error_status"), "html")


# fixed values: the names under which a result row tells where it comes from
DEEPLINK, DEPTH, ORIGINAL_PAGE = "deeplink", "crawlItem.depth", "originalPage"


def result_rows(rows: DataFrame) -> DataFrame:
    """Rows (values map, host, path, depth, html) with the item's link, depth and page added to ``values``, over keys of those names."""
    own = F.create_map(F.lit(DEEPLINK), F.concat("host", "path"), F.lit(DEPTH), F.col("depth").cast("string"), F.lit(ORIGINAL_PAGE), F.col("html"))
    others = F.map_filter("values", lambda k, v: ~k.isin(DEEPLINK, DEPTH, ORIGINAL_PAGE))
    return rows.withColumn("values", F.map_concat(others, own))


def overlay_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Scraped rows (id, values map) whose value ``$followurl$<url>`` names a page: its first row's non-blank values are laid over.

    ``pages``: (url, values map), the first row of each page. Rows without such a value stay as they are.
    """
    mark = "$followurl$"
    hit = F.try_element_at(F.filter(F.map_values("values"), lambda v: v.contains(mark)), F.lit(1))
    url = F.substring_index(hit, mark, -1)
    joined = rows.withColumn("__url", url).join(pages.select(F.col("url").alias("__url"), F.col("values").alias("__over")), "__url", "left")
    over = F.map_filter("__over", lambda k, v: F.trim(v) != "")
    kept = F.map_filter("values", lambda k, v: ~F.map_contains_key(over, k))
    return joined.withColumn("values", F.when(F.col("__over").isNull(), F.col("values")).otherwise(F.map_concat(kept, over))).drop("__url", "__over")
