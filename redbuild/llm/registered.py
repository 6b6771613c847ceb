"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontaminate, hmm, licences, mixing, periods, records, resample, sharding, simhash, spotsigs, suffixes, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sharding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", *sharding.size_and_crc())
    out = sharding.shard(docs, key=["doc_id"], carry=["size", "text_crc32"], shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home",
    )


@query
def op2_hidden_markov(spark, folder):
    return hmm.score(table(spark, folder, "documents"))


@query
def op3_decontamination(spark, folder):
    found = decontaminate.hit_runs(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    hits = F.aggregate(
        F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")), F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]
    )
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


@query
def op4_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_spotsigs(spark, folder):
    met = spotsigs.edited_texts(table(spark, folder, "documents"))
    return met.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("own")).alias("fingerprint"), spotsigs.as_text(F.col("edited_own")).alias("edited_fingerprint"),
        spotsigs.jaccard(F.col("own"), F.col("edited_own")).alias("near_edited"),
        spotsigs.jaccard(F.col("own"), F.col("next_own")).alias("near_next"),
    )


@query
def op6_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.spread_copies(mixing.mix(docs, key=["doc_id"]))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


@query
def op7_suffix_array(spark, folder):
    kept = suffixes.without_repeats(table(spark, folder, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_quality(spark, folder):
    docs = table(spark, folder, "documents")
    scored = cotrain.score(docs, cotrain.train(docs, table(spark, folder, "labels")))
    chance = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return scored.select(
        "doc_id", chance("good_odds").alias("quality"), chance("text_odds").alias("text_quality"),
        chance("meta_odds").alias("meta_quality"), (F.col("good_odds") >= 0).alias("kept"),
    )


@query
def op9_licences(spark, folder):
    """Documents as files: their directories are source and language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = table(spark, folder, "documents").select(path.alias("path"), "text")
    found = licences.with_inherited(licences.own_licences(files))
    doc_id = F.element_at(F.split("path", "/"), -1).try_cast("long")
    return found.select(doc_id.alias("doc_id"), *found.columns)


@query
def op10_token_records(spark, folder):
    import public_tokenizers

    where, index = records.write_records(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)
    back = records.read_records(where, records.shards(index))
    return back.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op11_periods(spark, folder):
    """About every tenth text gets a planted loop first, as the contract says."""
    docs = table(spark, folder, "documents").select("doc_id", periods.with_loops(F.col("text"), F.col("doc_id")).alias("text"))
    found = periods.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    start, length, period = -longest["s"], longest["n"], -longest["p"]
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    net = toxicity.train(docs, table(spark, folder, "labels").filter(~held_out))
    scored = toxicity.score(docs, net)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_windows", "worst_start", "worst_end"
    )


@query
def op13_resampling(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weighed = resample.weighed(docs, table(spark, folder, "benchmark")).drop("text")
    return resample.draw(weighed, percent=5, least_words=20, seed=42).select("doc_id", "n_features", "weight", "score", "rank")
