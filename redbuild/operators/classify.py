"""Category of a signal: weighted patterns, neighbour vote, fusion, owner, fallback."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category_rules as C
from ..functions import text as X
from . import neighbours as N
from .fence import fence
from .needles import constants, named_patterns

Catalogue = dict[str, list[str]]
Fallback = Callable[[DataFrame], DataFrame]
SCORES = "array<struct<category:string,score:int,matches:int,confidence:double,priority:int,threshold:double>>"


def check_catalogue(patterns: Catalogue) -> Catalogue:
    unknown = set(patterns) - set(C.CATEGORY_SETTINGS)
    if unknown:
        raise ValueError(f"not a failure category: {sorted(unknown)}")
    return patterns


def confidence(score: Column, matches: Column) -> Column:
    """Confidence of a category from its score and its number of patterns hit."""
    n = matches.cast("double")
    weak = score / (n * C.MAX_PER_PATTERN) + F.greatest(n - 1, F.lit(0.0)) * 0.08
    return (
        F.when(matches == 0, 0.0)
        .when(score >= C.MAX_PER_PATTERN, F.least(F.lit(1.0), 0.85 + F.least(F.lit(0.10), n * 0.02)))
        .when(score >= C.MEDIUM_SCORE, F.least(F.lit(1.0), 0.65 + F.least(F.lit(0.20), n * 0.05)))
        .otherwise(F.least(F.lit(0.60), weak))
    )


def category_scores(signals: DataFrame, patterns: Catalogue | None = None) -> DataFrame:
    """Adds `scores`: an array of (category, score, matches, confidence, priority,
    threshold), one entry per category with a hit.

    An automaton names the few patterns worth running on each field, in one pass
    over its text; these run as the regexes of Spark.  The catalogue is part of
    the plan as one literal, whatever its size.
    """
    patterns = check_catalogue(C.CATEGORY_PATTERNS if patterns is None else patterns)
    names = [c for c, regexes in patterns.items() if regexes]
    regexes = [r for c in names for r in patterns[c]]
    category_of = [i for i, c in enumerate(names) for _ in patterns[c]]
    if not regexes:
        return signals.withColumn("scores", F.array().cast(SCORES))
    spark = signals.sparkSession
    # Few bytes, much work per row: without an explicit number of partitions the
    # adaptive planner would merge the signals into a handful of tasks.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = signals.repartition(partitions, "failure_id", "fingerprint")
    fields = list(C.FIELD_WEIGHTS)
    named = named_patterns(spark, regexes)
    rows = rows.withColumn("_named", named(*[F.lower(c) for c in fields]))
    every = constants(["(?id)" + r for r in regexes])

    def hits(k: int) -> Column:
        return F.filter(F.get("_named", F.lit(k)), lambda p: F.rlike(F.col(fields[k]), F.get(every, p)))

    rows = fence(rows.withColumn("_hits", F.array(*[hits(k) for k in range(len(fields))])), "_hits")
    # (category, pattern) of each pattern found, with the weights of its fields.
    category = F.split(F.lit(",".join(map(str, category_of))), ",").cast("array<int>")
    weights = list(C.FIELD_WEIGHTS.values())
    weight = lambda p: reduce(
        lambda a, b: a + b, [F.when(F.array_contains(F.get("_hits", F.lit(k)), p), w).otherwise(0) for k, w in enumerate(weights)]
    )
    found = F.transform(F.array_distinct(F.flatten("_hits")), lambda p: F.struct(F.get(category, p).alias("c"), weight(p).alias("w")))
    rows = fence(rows.withColumn("_found", found), "_found")
    settings = [C.CATEGORY_SETTINGS[c] for c in names]
    of = lambda values, c, kind: F.get(constants([str(v) for v in values]), c).cast(kind)

    def entry(c: Column) -> Column:
        own = F.filter("_found", lambda x: x["c"] == c)
        return F.struct(
            c.alias("c"), F.aggregate(own, F.lit(0), lambda a, x: a + x["w"]).alias("score"), F.size(own).alias("matches")
        )

    sums = F.transform(F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["c"]))), entry)
    rows = fence(rows.withColumn("_sums", sums), "_sums")
    scored = rows.withColumn("scores", F.transform("_sums", lambda s: F.struct(
        of(names, s["c"], "string").alias("category"), s["score"].alias("score"), s["matches"].alias("matches"),
        confidence(s["score"], s["matches"]).alias("confidence"),
        of([x["priority"] for x in settings], s["c"], "int").alias("priority"),
        of([x["regex_min"] for x in settings], s["c"], "double").alias("threshold"),
    )))
    return fence(scored.drop("_named", "_hits", "_found", "_sums"), "scores")


def explain_scores(scored: DataFrame) -> DataFrame:
    """Long form: one row per signal and category hit."""
    return scored.select(
        "failure_id", "fingerprint", F.explode("scores").alias("s")
    ).select("failure_id", "fingerprint", "s.*")


def regex_best(scored: DataFrame) -> DataFrame:
    """Adds regex_category and regex_confidence; the lower priority number wins ties."""
    ranked = F.transform("scores", lambda s: F.struct(s["score"], -s["priority"], s["category"], s["confidence"]))
    best = F.array_max(ranked)
    return scored.withColumn("_best", best).select(
        *scored.columns,
        F.coalesce(F.col("_best.category"), F.lit(C.UNKNOWN)).alias("regex_category"),
        F.coalesce(F.col("_best.confidence"), F.lit(0.0)).alias("regex_confidence"),
    )


def score_with_table(signals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Scores against a catalogue table (category, pattern_id, regex): one row per
    signal and category.

    The catalogue, of thousands of patterns, is read by the driver and becomes an
    automaton and a literal of the plan: one pass over the signals at any size.
    """
    regexes: Catalogue = {}
    for r in catalogue.select("category", "regex", "pattern_id").orderBy("pattern_id", "regex").toLocalIterator():
        regexes.setdefault(r["category"], []).append(r["regex"])
    return explain_scores(category_scores(signals, regexes))


def neighbour_votes(queries: DataFrame, training: DataFrame, k: int = C.NEIGHBOURS, **search) -> DataFrame:
    """(id, vec) against training (sample_id, category, embedding) ->
    (id, category, weight, share, first_rank), one row per category met."""
    stored = training.select(F.col("sample_id").alias("id"), F.col("embedding").alias("vec"))
    near = N.nearest(queries, stored, k, "l2", **search)
    labels = training.select(F.col("sample_id").alias("stored_id"), "category")
    votes = (
        near.join(labels, "stored_id")
        .withColumn("weight", 1.0 / (1.0 + F.col("value")))
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "weight"))).alias("v"))
    )
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["weight"])

    def of_category(name: Column) -> Column:
        mine = F.filter("v", lambda x: x["category"] == name)
        weight = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x["weight"])
        return F.struct(
            name.alias("category"), weight.alias("weight"), (weight / total).alias("share"),
            F.array_min(F.transform(mine, lambda x: x["rank"])).alias("first_rank"),
        )

    names = F.array_distinct(F.transform("v", lambda x: x["category"]))
    return votes.select("id", F.explode(F.transform(names, of_category)).alias("c")).select("id", "c.*")


def neighbour_best(votes: DataFrame) -> DataFrame:
    """(id, semantic_category, semantic_confidence); on ties the category met first."""
    return votes.groupBy("id").agg(
        F.max_by(F.struct("category", "share"), F.struct("weight", -F.col("first_rank"))).alias("b")
    ).select("id", F.col("b.category").alias("semantic_category"), F.col("b.share").alias("semantic_confidence"))


def _setting(category: Column, key: str, default) -> Column:
    return F.coalesce(
        reduce(lambda acc, kv: acc.when(category == kv[0], F.lit(kv[1][key])), C.CATEGORY_SETTINGS.items(), F),
        F.lit(default),
    )


def fuse(rows: DataFrame) -> DataFrame:
    """Adds category and confidence from regex_category/-confidence and
    semantic_category/-confidence (NULL: no neighbour vote).

    A score counts for its own category; a neighbour vote raises the minimum.
    """
    regex_cat, regex_conf = F.col("regex_category"), F.col("regex_confidence")
    sem_cat = F.coalesce("semantic_category", F.lit(C.UNKNOWN))
    sem_conf = F.coalesce("semantic_confidence", F.lit(0.0))
    has_regex = regex_cat != C.UNKNOWN
    has_sem = (sem_cat != C.UNKNOWN) & (sem_conf > 0)
    regex_part = F.when(has_regex, C.REGEX_WEIGHT * regex_conf).otherwise(0.0)
    sem_part = F.when(has_sem, C.SEMANTIC_WEIGHT * sem_conf).otherwise(0.0)
    together = has_regex & has_sem & (regex_cat == sem_cat)
    regex_first = (regex_part > sem_part) | (
        (regex_part == sem_part)
        & (_setting(regex_cat, "priority", 999) <= _setting(sem_cat, "priority", 999))
    )
    use_regex = has_regex & (~has_sem | together | regex_first)
    picked = rows.withColumn("_cat", F.when(use_regex, regex_cat).when(has_sem, sem_cat).otherwise(C.UNKNOWN)).withColumn(
        "_score",
        F.when(together, regex_part + sem_part).when(use_regex, regex_part).otherwise(sem_part),
    ).withColumn(
        "_minimum",
        _setting(F.col("_cat"), "regex_min", 0.50)
        * F.when(has_sem, C.REGEX_WEIGHT + C.SEMANTIC_WEIGHT).otherwise(C.REGEX_WEIGHT),
    )
    accepted = (
        (F.col("_cat") != C.UNKNOWN)
        & (F.col("_score") >= C.ABSOLUTE_MINIMUM)
        & (F.col("_score") >= F.col("_minimum"))
    )
    return picked.select(
        *rows.columns,
        F.when(accepted, F.col("_cat")).otherwise(C.UNKNOWN).alias("category"),
        F.when(accepted, F.least(F.lit(1.0), F.col("_score"))).otherwise(0.0).alias("confidence"),
    )


def owner_of(category: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(category == kv[0], kv[1]), C.OWNERS.items(), F).otherwise(C.UNOWNED)


def rule_category(evidence: Column) -> Column:
    """First rule with one of its keywords in the evidence, else UNKNOWN."""
    text = F.lower(evidence)
    return reduce(
        lambda acc, kv: acc.when(X.contains_any(text, kv[1]), kv[0]), C.KEYWORD_RULES.items(), F
    ).otherwise(C.UNKNOWN)


RULE_CONFIDENCE = 0.5  # ours: a rule either applies or not


def rule_fallback(unknown: DataFrame) -> DataFrame:
    """Default for what stays UNKNOWN: the keyword rules on the error line."""
    category = rule_category(F.col("error_line"))
    return unknown.withColumn("category", category).withColumn(
        "confidence", F.when(F.col("category") == C.UNKNOWN, 0.0).otherwise(RULE_CONFIDENCE)
    )


def resolve_unknown(classified: DataFrame, fallback: Fallback = rule_fallback) -> DataFrame:
    """Sends UNKNOWN rows through the fallback; all others pass unchanged."""
    if fallback is rule_fallback:  # an expression: no second pass over the input
        unknown = F.col("category") == C.UNKNOWN
        by_rule = rule_category(F.col("error_line"))
        return classified.withColumn("_rule", F.when(unknown, by_rule)).withColumn(
            "confidence",
            F.when(F.col("_rule").isNull(), F.col("confidence"))
            .when(F.col("_rule") == C.UNKNOWN, 0.0).otherwise(RULE_CONFIDENCE),
        ).withColumn("category", F.coalesce("_rule", "category")).drop("_rule")
    known = classified.filter(F.col("category") != C.UNKNOWN)
    rest = fallback(classified.filter(F.col("category") == C.UNKNOWN))
    return known.unionByName(rest.select(*classified.columns))


def classify(
    signals: DataFrame, training: DataFrame | None = None, *,
    patterns: Catalogue | None = None, fallback: Fallback = rule_fallback,
) -> DataFrame:
    """Signals (with `embedding` if `training` is given) -> category, confidence, owner."""
    rows = regex_best(category_scores(signals, patterns)).drop("scores")
    if training is None:
        rows = rows.withColumn("semantic_category", F.lit(None).cast("string")).withColumn(
            "semantic_confidence", F.lit(None).cast("double")
        )
    else:
        # Equal fingerprints have equal vectors: one search for each.
        queries = signals.groupBy("fingerprint").agg(F.first("embedding").alias("vec"))
        best = neighbour_best(neighbour_votes(queries.select(F.col("fingerprint").alias("id"), "vec"), training))
        rows = rows.join(best.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    resolved = resolve_unknown(fuse(rows), fallback)
    return resolved.withColumn("owner_team", owner_of(F.col("category"))).drop(
        "regex_category", "regex_confidence", "semantic_category", "semantic_confidence"
    )


def classification_requests(classified: DataFrame) -> DataFrame:
    """Request text for an external classifier, one row per UNKNOWN signal."""
    rules = "\n".join(
        f"{i}. {category} if the evidence has one of: {', '.join(words)}"
        for i, (category, words) in enumerate(C.KEYWORD_RULES.items(), 1)
    )
    head = (
        "Assign the CI failure below to a category. Apply the first rule that fits, from explicit evidence only.\n"
        f"{rules}\n4. {C.UNKNOWN} otherwise\n"
    )
    none = F.lit("")
    return classified.filter(F.col("category") == C.UNKNOWN).select(
        "failure_id", "fingerprint",
        F.concat(
            F.lit(head), F.lit("Stage: "), F.col("stage"),
            F.lit("\nError line: "), F.coalesce("error_line", none),
            F.lit("\nBefore: "), F.coalesce("pre_content", none),
            F.lit("\nAfter: "), F.coalesce("post_content", none),
            F.lit("\nNow: "), F.col("category"), F.lit(" "), F.col("confidence").cast("string"),
            F.lit("\nAnswer as JSON with best_category and classified_confidence (0 to 1)."),
        ).alias("request"),
    )
