"""SpotSigs: document fingerprints of chains of content words behind common words, in DataFrame functions only.

Each common word of a text is an anchor; it and the next content words behind
it form a spot.  The set of a text's spots is its fingerprint, likeness is the
Jaccard of two sets.  Spots follow the prose, not the layout, so headers and
short junk hardly add any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, bounds_of, checkpointed, let, lower_ascii, range_of, slices

#: Common words of the four languages.
ANCHORS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein für ist mit nicht sich und von zu "
    "dans de des du elle en est et la le les par pas pour que qui sur un une "
    "como con del el en las los no para por que se su una y"
).split()
CHAIN = 2  # content words of a spot
REACH = 8  # words behind an anchor among which they are looked for
AROUND = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())  # what may stand around an anchor


def spots(text: Column) -> Column:
    """The text's fingerprint: rising, distinct 64-bit numbers.

    Words end at white space, A-Z count as a-z, an anchor may have punctuation around it.  The text's start is an anchor
    too, so every text with words has a fingerprint; a text without (null, empty) has the empty one.  Where the REACH
    words before a word have no anchor, the word is one itself, so the whole length is seen of texts with few anchors or
    none.  Equal texts have equal fingerprints.
    """
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")
    bare = lambda w: F.btrim(w, F.lit(AROUND))
    common = lambda w: bare(w).isin(*sorted(set(ANCHORS)))

    def of(w: Column, c: Column) -> Column:
        chain = lambda at, anchor: F.xxhash64(F.concat_ws(
            " ", anchor, F.slice(F.filter(F.slice(w, at, F.lit(REACH)), lambda x: ~common(x)), 1, CHAIN)))
        far = lambda i: (i >= REACH) & ~F.array_contains(F.slice(c, F.greatest(i - (REACH - 1), F.lit(1)), F.lit(REACH)), True)
        found = F.transform(w, lambda x, i: F.when(F.get(c, i), chain(i + 2, bare(x))).when(far(i), chain(i + 2, x)))
        start = F.when(F.size(w) > 0, chain(F.lit(1), F.lit("^")))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(found, F.array(start)))))

    return let(words, lambda w: let(F.transform(w, common), lambda c: of(w, c)))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b)
    return let(shared, lambda n: F.when(every == 0, 1.0).otherwise(n / (every - n)))


def as_text(spots_: Column) -> Column:
    """The set as one string: 16 hexadecimal digits for each spot, rising as signed numbers; '' if there is none."""
    return F.array_join(F.transform(spots_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def beside_next(docs: DataFrame, derive) -> DataFrame:
    """Each row with the text of the next document: descending doc_id, null last, and after the last comes the first;
    equal ids by their texts' hash.  Gives doc_id, text, next_text, own and next_own: derive(text) of both.  Null texts are empty.  A single document is its own
    next.  Equal rows follow each other.

    Rows are dealt into ranges of doc_id and texts are shuffled once; each range gets the first document of the range
    behind it as one more row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = bounds_of(rows.filter("doc_id IS NOT NULL"), "doc_id", 8 * slices(docs.sparkSession))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = rows.withColumn("_range", range_of(key, bounds)).withColumn("_k", key).withColumn("_h", F.xxhash64("text"))
    # One row per range: its first document.
    heads = sorted(rows.groupBy("_range").agg(F.max(F.struct("_k", "_h")).alias("m")).select("_range", "m._k", "m._h").collect(), reverse=True)
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), derive(F.col("text")).alias("own"), derive(F.col("text")).alias("next_own"))
    behind = [(heads[i - 1]["_range"], *heads[i][1:]) for i in range(len(heads))]
    wanted = docs.sparkSession.createDataFrame(behind, "_to int, _k long, _h long")
    first = rows.join(F.broadcast(wanted), ["_k", "_h"]).groupBy("_to").agg(F.first("text").alias("text"))
    extra = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_to").alias("_range"), F.lit(0).cast("long").alias("_k"), F.lit(0).cast("long").alias("_h"), F.lit(True).alias("_end"))
    every = rows.withColumn("_end", F.lit(False)).unionByName(extra)
    order = W.partitionBy("_range").orderBy("_end", F.desc("_k"), F.desc("_h"))
    # derive() runs behind the shuffle, once for each row: what it gives is not sent around.
    met = every.withColumn("next_text", F.lead("text").over(order)).withColumn("own", derive(F.col("text")))
    met = met.withColumn("next_own", F.lead("own").over(order))
    return met.filter(~F.col("_end")).select("doc_id", "text", "next_text", "own", "next_own")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, spots) for every row."""
    return docs.select("doc_id", spots(F.col("text")).alias("spots"))


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of representatives whose sets have a Jaccard of at least the threshold, a < b.

    prints: (doc_id, spots).  Equal sets are one, represented by their least doc_id; members() has the rest.  Empty sets
    are like each other only, so they give no pair.  Sets of n spots are partitioned by the size class floor(log(n) to
    base 1/threshold): only the same and the next class can reach the threshold.  A set stands in its classes under its
    rarest n - ceil(threshold n) + 1 spots, of which two such sets share one.
    """
    sets = prints.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("doc_id"))
    sets = checkpointed(sets.withColumn("_id", F.monotonically_increasing_id()))
    each = sets.select("_id", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count("*").alias("df"))
    ordered = each.join(counts, "spot").groupBy("_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("s"))
    # A spot of one set alone joins nothing, yet it takes a place in the prefix.
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    keys = ordered.select("_id", "n", F.explode(F.slice("s", F.lit(1), length)).alias("p")).filter("p.df > 1").select("_id", "n", F.col("p.spot").alias("spot"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    keys = checkpointed(keys.withColumn("c", size_class))
    left = keys.select("spot", F.col("_id").alias("i"), F.col("n").alias("m"), F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    right = keys.select("spot", F.col("_id").alias("j"), "n", "c")
    fits = (F.col("m") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("m") * threshold - 1e-9)
    ahead = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("i") < F.col("j")))
    pairs = left.join(right, ["spot", "c"]).filter(fits & ahead).select("i", "j").distinct()
    a = sets.select(F.col("_id").alias("i"), F.col("doc_id").alias("x"), F.col("spots").alias("s"))
    b = sets.select(F.col("_id").alias("j"), F.col("doc_id").alias("y"), F.col("spots").alias("t"))
    scored = pairs.join(a, "i").join(b, "j").withColumn("likeness", jaccard(F.col("s"), F.col("t")))
    return scored.filter(F.col("likeness") >= threshold - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def members(prints: DataFrame) -> DataFrame:
    """(doc_id, representative): the least doc_id with the same set."""
    least = prints.groupBy("spots").agg(F.min("doc_id").alias("representative"))
    return prints.join(least, "spots").select("doc_id", "representative")


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, next_text, edited and the spots of the three (own, next_own, edited_own).  edited is the
    text whose last half, rounded down, gives way to the first as many code points (or all) of the next document."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    met = beside_next(docs, spots).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    return met.withColumn("edited_own", spots(F.col("edited")))
