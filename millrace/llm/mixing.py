"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash. A source contributes whole passes over its blocks
and, for the rest of its target, blocks in a permuted order, the last of them document by document.
The resulting block quotas are split down a binary tree: at each node the left half of the output
shards gets a multivariate-hypergeometric share of the node's blocks, so every shard is an exact,
disjoint part of the whole and has the composition of a random permutation. A node's draw runs down a
tree of sources too, 64 children a node, so any number of sources is dealt in parallel. A shard takes
the next blocks of each source's permuted order, and within a shard a hash orders the documents. Only
DataFrame functions are used; tables beside the documents hold one row a block at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import Work, fresh, shuffle_partitions
from millrace.plans.running import running

WORD = r"[^\x20\x09-\x0D]+"
#: children of a node in the tree of sources
FAN = 64
#: least number of blocks of a source, and rows that a block holds at most on average beyond
BLOCKS, BLOCK_ROWS = 1024, 1 << 16
#: rows up to which the table of placed blocks is sent to every task (some 100 bytes each)
MOST_SENT = 100_000


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _log_factorial(k: str) -> str:
    """SQL for ln k!; exact below 16, then Stirling's series (error below 1e-12)."""
    return f"(case when {k} < 16 then ln(cast(factorial(cast({k} as int)) as double)) else ({k} + 0.5D) * ln({k}) - {k} + 0.9189385332046727D + 1D / (12D * {k}) - 1D / (360D * pow({k}, 3)) + 1D / (1260D * pow({k}, 5)) end)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked units among ``drawn`` of ``total``, by inverting the distribution at ``u``.

    Sums run over twelve standard deviations around the mean; what lies beyond has less mass than a double's step.
    """
    lf = _log_factorial
    mean, sd = f"({drawn} * {marked} / {total})", f"sqrt({drawn} * ({marked} / {total}) * (1D - {marked} / {total}) * ({total} - {drawn}) / greatest({total} - 1D, 1D))"
    low = f"greatest(0D, {drawn} - ({total} - {marked}), floor({mean} - 12D * {sd}) - 3D)"
    high = f"least({marked}, {drawn}, ceil({mean} + 12D * {sd}) + 3D)"
    const = f"({lf(marked)} + {lf(f'({total} - {marked})')} - {lf(total)} + {lf(drawn)} + {lf(f'({total} - {drawn})')})"
    mass = f"exp({const} - {lf('x')} - {lf(f'({marked} - x)')} - {lf(f'({drawn} - x)')} - {lf(f'({total} - {marked} - {drawn} + x)')})"
    return (
        f"(case when {total} <= 0D or {drawn} <= 0D or {marked} <= 0D then 0D when {drawn} >= {total} then {marked} else "
        f"aggregate(transform(sequence(cast({low} as bigint), cast({high} as bigint)), x -> cast(x as double)), "
        f"named_struct('p', 0D, 'x', {high}, 'done', false), "
        f"(sofar, x) -> case when sofar.done then sofar when sofar.p + {mass} >= {u} then named_struct('p', sofar.p, 'x', x, 'done', true) else named_struct('p', sofar.p + {mass}, 'x', sofar.x, 'done', false) end, sofar -> sofar.x) end)"
    )


def split_tree(quotas: DataFrame, n_sources: int, levels: int, seed: int, work: Work) -> DataFrame:
    """(rank, shard, n): quotas (rank, n) of the sources 0 .. n_sources - 1 split among 2**levels shards.

    Shards differ by one block at most. At each node the draw is dealt to groups of sources by their totals and
    on to their members, each time in a row of ``FAN`` children at most.
    """
    depth = 1
    while FAN**depth < n_sources:
        depth += 1
    node = quotas.select(F.lit(0).alias("shard"), F.col("rank").cast("bigint").alias("rank"), F.col("n").cast("double").alias("n"))
    for level in range(levels):
        if depth > 1:
            node = work.keep(node, "node")  # it is read once for each layer of sources
        ask = None
        for layer in range(depth):
            width = FAN ** (depth - 1 - layer)
            kids = node.groupBy("shard", F.expr(f"rank div {width * FAN}L").alias("group"), F.expr(f"rank div {width}L").alias("kid")).agg(F.sum("n").alias("n"))
            kids = kids.groupBy("shard", "group").agg(F.array_sort(F.collect_list(F.struct("kid", "n"))).alias("kids"))
            kids = kids.withColumn("total", F.expr("aggregate(kids, 0D, (a, h) -> a + h.n)"))
            kids = kids.withColumn("drawn", F.expr("ceil(total / 2D) + 0D")) if ask is None else kids.join(ask, ["shard", "group"])
            draw = hypergeometric("s.total", "h.n", "s.drawn", f"((pmod(xxhash64(h.kid, shard, {layer}, {level}, {seed}), 4503599627370496) + 0.5D) / 4503599627370496D)")
            kids = kids.selectExpr(
                "shard", "kids",
                f"""aggregate(kids, named_struct('total', total, 'drawn', drawn, 'out', cast(array() as array<double>)),
                    (s, h) -> transform(array({draw}), k -> named_struct('total', s.total - h.n, 'drawn', s.drawn - k, 'out', array_append(s.out, k)))[0], s -> s.out) as lefts""",
            )
            ask = kids.selectExpr("shard", "inline(zip_with(kids, lefts, (h, k) -> named_struct('group', h.kid, 'n', h.n, 'drawn', k)))")
            if layer + 1 < depth:
                ask = ask.drop("n")
        node = ask.selectExpr("inline(array(named_struct('shard', shard * 2, 'rank', group, 'n', drawn), named_struct('shard', shard * 2 + 1, 'rank', group, 'n', n - drawn)))")
    return node.selectExpr("rank", "shard", "cast(n as bigint) as n")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float, work: Work) -> DataFrame:
    """Add rank, weight and target to (source, source_size): shares by weight, held at ``cap`` times the size.

    Water level: in the order of cap over weight, a source is held while its cap lies below the level
    that the rest would have. Ranks and sums are taken by ranges, so sources may be many.
    """
    keep = lambda df: work.keep(df, "dealt")
    out = running(sources, [F.col("source").asc_nulls_last()], "rank", keep=keep)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    out = out.withColumn("ceiling", F.col("source_size") * float(cap)).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    out = work.keep(running(out, [F.col("ratio"), F.col("rank")], "at", {"caps": F.col("ceiling"), "weights": F.col("weight")}, keep), "sums")
    whole = out.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    out = out.join(F.broadcast(whole))
    out = out.withColumn("level", (F.col("all_size") - F.col("caps") + F.col("ceiling")) / (F.col("all_weight") - F.col("weights") + F.col("weight")))
    out = work.keep(out.withColumn("held", F.col("ratio") < F.col("level")), "levels")
    water = out.agg(F.max(F.when(~F.col("held"), F.col("level"))).alias("water"))  # one row
    out = out.join(F.broadcast(water)).withColumn("target", F.when(F.col("held"), F.col("ceiling")).otherwise(F.least(F.col("weight") * F.col("water"), F.col("ceiling"))))
    return out.drop("ceiling", "level", "held", "ratio", "at", "caps", "weights", "all_size", "all_weight", "water")


def _keys(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """A document's number, by which blocks and places are dealt, and its source's key."""
    source = F.col("source").cast("string")
    number = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return number, F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _placed(slim: DataFrame, work: Work, weights: tuple[float, ...], cap: int, blocks: int, levels: int, seed: int) -> DataFrame:
    """(skey, block, source_size, target, turns) for every block of ``slim`` (source, skey, block, size, u).

    turns: array of (pass, shard, most): the block is drawn in that pass for that shard; where ``most`` is not
    null only documents with u up to it.
    """
    per_block = work.keep(slim.groupBy("source", "skey", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = per_block.groupBy("source", "skey").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    sources = targets(sources, weights, cap, work)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("passes", F.least(F.floor(ratio + 1e-12), F.lit(cap)).cast("int"))
    sources = work.keep(sources.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))), "sources")

    # every pass permutes the blocks anew; the last, numbered ``passes``, is the partial one
    order = Window.partitionBy("skey", "pass").orderBy(F.xxhash64(F.lit(seed), "skey", "block", "pass"), "block")
    drawn = per_block.join(sources.drop("source"), "skey").select("skey", "rank", "block", "words", "rest", "passes", "n_blocks", F.explode(F.sequence(F.lit(0), "passes")).alias("pass"))
    drawn = drawn.withColumn("nth", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order))
    partial = F.col("pass") == F.col("passes")
    before = F.col("upto") - F.col("words")
    drawn = drawn.where(~partial | (before < F.col("rest"))).withColumn("quota", F.when(partial & (F.col("upto") > F.col("rest")), F.col("rest") - before))
    drawn = work.keep(drawn.select("skey", "rank", "block", "pass", "quota", (F.col("pass") * F.col("n_blocks") + F.col("nth")).alias("nth")), "drawn")

    # of the one block of a source that is drawn in part, documents go in the order of u while that brings the sum nearer to the quota
    cut = drawn.where("quota is not null").select("skey", "block", "quota")
    inside = Window.partitionBy("skey").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = slim.join(cut, ["skey", "block"]).groupBy("skey", "u", "quota").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(inside))
    most = part.where(F.expr("upto - size / 2D <= quota")).groupBy("skey").agg(F.max("u").alias("most"))
    drawn = drawn.join(most, "skey", "left").where("quota is null or most is not null")
    drawn = work.keep(drawn.withColumn("most", F.when(F.col("quota").isNotNull(), F.col("most"))), "drawn")

    shards = split_tree(drawn.groupBy("rank").agg(F.count("*").alias("n")), max(1, sources.count()), levels, seed, work)
    ends = shards.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("q"))
    ends = ends.selectExpr("rank", "transform(q, (x, i) -> aggregate(slice(q, 1, i + 1), 0L, (a, y) -> a + y.n)) as ends")
    # the last pass of a source may leave out blocks, never one in between, so places are counted by rows
    nth = F.row_number().over(Window.partitionBy("rank").orderBy("nth")) - 1
    turns = drawn.withColumn("nth", nth).join(ends, "rank").withColumn("shard", F.expr("size(filter(ends, e -> e <= nth))"))
    turns = turns.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "most"))).alias("turns"))
    placed = per_block.select("skey", "block").join(sources.select("skey", "source_size", "target"), "skey").join(turns, ["skey", "block"], "left")
    return work.keep(placed, "placed")


def _draws(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` (with skey, block, u) joined to their block's table, ``draws`` added."""
    placed = placed if placed.count() > MOST_SENT else F.broadcast(placed)
    drawn = "filter(coalesce(turns, array()), t -> t.most is null or u <= t.most)"
    return rows.join(placed, ["skey", "block"]).withColumn("draws", F.expr(f"transform({drawn}, t -> named_struct('pass', t.pass, 'shard', t.shard, 'place', xxhash64(u, t.pass)))"))


def _slim(docs: DataFrame, work: Work, blocks: int | None, seed: int) -> tuple[DataFrame, int]:
    """The documents without their texts, and the number of blocks of a source."""
    number, skey = _keys(docs, seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), number.alias("u"), skey.alias("skey"))
    slim = work.keep(slim, "slim")
    if blocks is None:
        blocks, rows = BLOCKS, slim.count()
        while blocks * BLOCK_ROWS < rows:
            blocks *= 2
    return slim.withColumn("block", F.pmod("u", F.lit(blocks)).cast("int")), blocks


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, blocks: int | None = None, levels: int = 4, seed: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken and draws.

    ``draws``: array of (pass, shard, place), one entry each time the document is drawn; shards are written
    in the order of place. Sizes count words ``[^\\x20\\x09-\\x0D]+``; a null text has none and is drawn with
    its block all the same. A null source is a source of its own, ranked last. Repeated rows stay apart but
    are drawn together. Extra columns are ignored. An empty table gives an empty result. ``blocks``: of each
    source; if None, as many as keep a block at 65536 documents on average, 1024 at least.
    """
    work = Work(docs.sparkSession, "mix")
    slim, blocks = _slim(docs, work, blocks, seed)
    placed = _placed(slim, work, weights, cap, blocks, levels, seed)
    work.prune("slim", "placed")
    out = _draws(slim, placed)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("bigint").alias("taken"), "draws")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, blocks: int | None = None, levels: int = 4, seed: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as it is drawn, in the order of shard and place.

    Every partition of the result belongs to one shard. Nulls, repeated rows and empty tables as in ``mix``;
    columns of any name are kept.
    """
    work = Work(docs.sparkSession, "mix")
    slim, blocks = _slim(docs, work, blocks, seed)
    placed = _placed(slim, work, weights, cap, blocks, levels, seed)
    work.prune("placed")
    number, skey = _keys(docs, seed)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, number.alias("u"), skey.alias("skey")).withColumn("block", F.pmod("u", F.lit(blocks)).cast("int"))
    drawn = _draws(rows, placed).select("row", F.explode("draws").alias("d"))
    # places are uniform: equal ranges of them are equal shares of a shard
    shares = -(-shuffle_partitions(docs.sparkSession) >> levels) or 1
    share = F.floor((F.col("d.place") / float(1 << 64) + 0.5) * shares)
    part = F.col("d.shard") * shares + F.least(F.greatest(share, F.lit(0)), F.lit(shares - 1))
    out = drawn.repartitionById(shares << levels, part.cast("int")).sortWithinPartitions("d.shard", "d.place")
    return out.select("row.*")
