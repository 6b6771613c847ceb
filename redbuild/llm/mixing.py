"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the expected number of copies of each of
its documents.  The whole part is taken as it is; the fractions are rounded by
pairs: mass (in words) moves from one document of a pair to the other in a
direction drawn so that expectations stay, until one of them is whole, and the
other goes on as the residual.  Blocks of at most some hundred documents of a
source are folded to one residual each, the residuals are blocked and folded
again, up to one residual per source.  Words are kept by every transfer, so a
source misses its target by half of one document at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked, unused

BLOCK = 128
TINY = 1e-9
ITEM = "struct<h:bigint,id:bigint,s:double,x:double>"
STATE = f"struct<full:boolean,res:{ITEM},out:array<struct<id:bigint,up:int>>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: list[int], share: float, most: float) -> DataFrame:
    """From (source, source_size): adds target, the source's share of share x all sizes.

    Sources in code point order, null last, get the weights in turn.  No target exceeds most x its source's size; what
    it would have beyond that goes to the others by weight, until none is above.
    """
    n = len(weights)
    table = F.lit([float(w) for w in weights])
    turn = ranked(sizes, F.col(source).asc_nulls_last())
    weighed = turn.withColumn("_w", F.element_at(table, (F.col("rank") % n + 1).cast("int"))).drop("rank")
    weighed = checkpointed(weighed.withColumn("_cap", F.col("source_size") * most))
    above = lambda level: F.col("_w") * level >= F.col("_cap")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # each turn one sum over the sources; the level rises until no further source is full
        full, weight = weighed.agg(
            F.sum(F.when(above(level), F.col("_cap")).otherwise(0.0)), F.sum(F.when(~above(level), F.col("_w")).otherwise(0.0))
        ).first()
        if not weight or (rise := (total - full) / weight) <= level * (1 + 1e-12):
            break
        level = rise
    return weighed.withColumn("target", F.least(F.col("_w") * level, F.col("_cap"))).drop("_w", "_cap")


def _unit(*parts: Column) -> Column:
    """A number from 0 to below 1, drawn by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _step(acc: Column, b: Column, seed: int) -> Column:
    a, out = acc["res"], acc["out"]
    gain_a, gain_b = (1 - a["x"]) * a["s"], (1 - b["x"]) * b["s"]  # words that may still go in
    mass_a, mass_b = a["x"] * a["s"], b["x"] * b["s"]
    up, down = F.least(gain_a, mass_b), F.least(mass_a, gain_b)  # words moved if a gains, if a loses
    a_gains = _unit(a["h"], b["h"], F.lit(seed)) * (up + down) < down

    def state(keep: Column, x: Column, done: Column, whole: int) -> Column:
        rest = F.struct(keep["h"], keep["id"], keep["s"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("x"))
        ended = F.concat(out, F.array(F.struct(done["id"].alias("id"), F.lit(whole).alias("up"))))
        return F.struct(F.lit(True).alias("full"), rest.alias("res"), ended.alias("out")).cast(STATE)

    return (
        F.when(~acc["full"], F.struct(F.lit(True).alias("full"), b.alias("res"), out.alias("out")).cast(STATE))
        .when(a_gains & (gain_a <= mass_b), state(b, b["x"] - up / b["s"], a, 1))
        .when(a_gains, state(a, a["x"] + up / a["s"], b, 0))
        .when(mass_a <= gain_b, state(b, b["x"] + down / b["s"], a, 0))
        .otherwise(state(a, a["x"] - down / a["s"], b, 1))
    )


def _fold(items: Column, seed: int) -> Column:
    none = F.struct(
        F.lit(False).alias("full"), F.lit(None).cast(ITEM).alias("res"),
        F.array().cast("array<struct<id:bigint,up:int>>").alias("out"),
    ).cast(STATE)
    return F.aggregate(items, none, lambda acc, b: _step(acc, b, seed))


def round_fractions(items: DataFrame, source: str, seed: int = 0) -> DataFrame:
    """(id, up) for items (source, id, h, s, x): up is 0 or 1, 1 with probability x, the sum of s x up kept by source."""
    item = F.struct("h", "id", "s", "x").alias("item")
    counts = items.groupBy(F.col(source).alias("_src")).agg(F.count("*").alias("_n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).cast("long")
    most = counts.agg(F.max(blocks)).first()[0]
    if most is None:
        return items.select("id", F.lit(0).alias("up"))
    level = items.join(counts, F.col(source).eqNullSafe(F.col("_src"))).select(
        "_src", F.pmod(F.xxhash64("h", F.lit("block")), blocks).alias("_block"), item
    )
    ended = []
    while True:
        folded = checkpointed(
            level.groupBy("_src", "_block").agg(_fold(F.sort_array(F.collect_list("item")), seed).alias("f"))
        )
        ended.append(folded.select(F.explode("f.out").alias("o")).select("o.id", "o.up"))
        if most <= 1:
            break
        most = -(-most // BLOCK)
        level = folded.select("_src", F.floor(F.col("_block") / BLOCK).alias("_block"), F.col("f.res").alias("item"))
    last = folded.select(F.col("f.res.id").alias("id"), F.when(F.col("f.res.x") >= 0.5, 1).otherwise(0).alias("up"))
    return reduce(DataFrame.unionByName, [*ended, last])


def mix(
    rows: DataFrame, key: list[str], source: str = "source", size: str = "size", weights: list[int] = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """One row for each distinct (key, source, size) with rows (how many there are), source_size, target and copies,
    the number of times that these rows together are taken.

    key identifies a row together with source and size; equal rows are one item whose copies are spread over them.
    Nulls are values like any other; a size of null or 0 brings no words, and such rows are kept by a hashed draw.
    An empty table gives no rows.  Other columns are ignored.  The draw depends on seed and rows alone.
    """
    columns = list(dict.fromkeys([*key, source]))
    sized = rows.select(*columns, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    items = sized.groupBy(*columns, "size").agg(F.count("*").alias("rows"))
    h = F.xxhash64(*[F.col(c) for c in columns], "size", F.lit(seed))
    items = checkpointed(items.withColumn("_h", h).withColumn("_id", F.monotonically_increasing_id()))
    sizes = items.groupBy(F.col(source).alias("_source")).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = targets(sizes, "_source", list(weights), share, most)
    mass = F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    met = items.join(goal, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_mass", mass)
    whole = F.floor(F.col("_mass") + TINY)
    met = met.withColumn("_whole", whole).withColumn("_x", F.greatest(F.lit(0.0), F.col("_mass") - whole))
    met = checkpointed(met.drop("_source"))
    open_ = met.filter((F.col("_x") > TINY) & (F.col("size") > 0)).select(
        source, F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("size").cast("double").alias("s"), F.col("_x").alias("x")
    )
    ups = round_fractions(open_, source, seed).withColumnRenamed("id", "_id")
    drawn = F.when((F.col("size") == 0) & (_unit(F.col("_h"), F.lit(seed)) < F.col("_x")), 1).otherwise(0)
    copies = (F.col("_whole") + F.coalesce(F.col("up"), drawn)).cast("long")
    return met.join(ups, "_id", "left").select(*columns, "size", "rows", "source_size", "target", copies.alias("copies"))


def spread_copies(mixed: DataFrame) -> DataFrame:
    """One row for each row that mix() counted: copies is then its own share, the whole of its item's spread evenly."""
    at_once = 8_192
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(at_once).cast("long")))
    dealt = mixed.withColumn("_c", chunk).withColumn("_m", F.least(F.col("rows") - F.col("_c"), F.lit(at_once).cast("long")))
    one = dealt.withColumn("_r", F.explode(F.sequence(F.col("_c"), F.col("_c") + F.col("_m") - 1)))
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("_r") < F.col("copies") % F.col("rows")).cast("long")
    return one.withColumn("copies", own).drop("_c", "_m", "_r", "rows")


def mixed_documents(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """docs as the mix takes them, each row as often as it is taken; all columns are kept.

    Sizes are words of the text.  Rows equal in all columns are one item, whose copies are as many in sum.
    """
    h0, size0, copies, count, at, copy, d, s, g = unused(docs, "h0", "size0", "copies", "count", "at", "copy", "d", "s", "g")
    rows = docs.select("*", F.xxhash64(*[F.col(c) for c in docs.columns]).alias(h0), word_count(F.col("text")).alias(size0))
    items = rows.select(F.col("doc_id").alias("doc"), F.col("source").alias("origin"), F.col(h0).alias("hash"), F.col(size0).alias("words"))
    mixed = mix(items, ["doc", "hash"], source="origin", size="words", weights=weights, share=share, most=most, seed=seed)
    taken = checkpointed(mixed.filter("copies > 0").select(
        F.col("doc").alias(d), F.col("origin").alias(s), F.col("hash").alias(g), F.col("copies").alias(copies), F.col("rows").alias(count)))
    if taken.filter(F.col(count) > 1).head(1):
        rows = rows.dropDuplicates(["doc_id", "source", h0])
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(h0) == F.col(g))
    met = rows.join(taken, same)
    # At most 2 rows from one, but for items of many equal rows: those are dealt out in parts first.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(1_024).cast("long")))
    met = met.withColumn(at, part)
    each = F.explode(F.sequence(F.col(at), F.least(F.col(at) + 1_023, F.col(copies) - 1)))
    return met.withColumn(copy, each).select(*[F.col(c) for c in docs.columns])
