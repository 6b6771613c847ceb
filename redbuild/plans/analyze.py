"""The whole pipeline on tables: log lines in, explained and owned errors out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal_rules as R
from ..operators import classify as K
from ..operators import dedup as D
from ..operators import extract as E
from ..operators import knowledge, rca, report
from ..operators.neighbours import ensure_checkpoints


def analyze(
    lines: DataFrame, *,
    training: DataFrame | None = None,
    known_patterns: DataFrame | None = None,
    stored_vectors: DataFrame | None = None,
    embedder: D.Embedder = D.hashing_embedder,
    clustering: Callable[..., DataFrame] = D.clusters,
    fallback: K.Fallback = K.rule_fallback,
    analyzer: rca.Analyzer = rca.template_analyzer,
    patterns: K.Catalogue | None = None,
    mode: str = E.STRICT,
    pre_context: int = R.PRE_CONTEXT,
    post_context: int = R.POST_CONTEXT,
) -> dict[str, DataFrame]:
    """signals, representatives, classified, root_causes, rejected, summary, rows, counters.

    `training` needs `embedding`; `known_patterns` is the stored pattern table,
    `stored_vectors` (fingerprint, embedding) what was embedded before.
    `clustering` may be dedup.density_clusters, which also finds loose clusters.
    Steps that later steps share are checkpointed.
    """
    ensure_checkpoints(lines.sparkSession)
    found = E.extract_signals(lines, mode=mode, pre_context=pre_context, post_context=post_context)
    signals = D.embed_signals(E.distinct_signals(found).checkpoint(), embedder, stored_vectors).checkpoint()
    representatives = D.deduplicate(signals, clustering=clustering).checkpoint()

    no_hits = representatives.sparkSession.createDataFrame(
        [], "id string, pattern_fingerprint string, similarity_score double"
    )
    hits = no_hits
    if known_patterns is not None:
        # Equal fingerprints have equal vectors: one lookup for each.
        queries = representatives.groupBy(F.col("fingerprint").alias("id")).agg(F.first("embedding").alias("vec"))
        usable = rca.usable(known_patterns).checkpoint()
        hits = knowledge.only_usable(knowledge.lookup(queries, known_patterns), usable).checkpoint()
    to_classify = knowledge.misses(representatives, hits, "fingerprint")
    classified = K.classify(to_classify, training, patterns=patterns, fallback=fallback).checkpoint()

    causes = rca.root_causes(classified, analyzer)
    fresh = causes.filter("valid").drop("valid", "errors")
    if known_patterns is not None:
        cached = knowledge.cached_root_causes(representatives, hits, usable)
        fresh = fresh.unionByName(cached, allowMissingColumns=True).select(*fresh.columns)
    root_causes = fresh.checkpoint()
    cache_hits = knowledge.hits(representatives, hits, "fingerprint")
    return {
        "signals": signals,
        "representatives": representatives,
        "classified": classified,
        "root_causes": root_causes,
        "rejected": causes.filter(~F.col("valid")),
        "summary": report.summary(root_causes),
        "rows": report.rows(root_causes, order=["stage", "line_no", "fingerprint"]),
        "counters": report.stage_counters(signals, representatives, cache_hits, lines.select("failure_id")),
    }
