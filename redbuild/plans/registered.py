"""Registered queries: name -> function(spark, folder of the shared tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import category_rules as C
from ..functions import text as X
from ..operators import ci_runs, classify, dedup, extract, failures, knowledge, learn, rca, report
from ..sources import documents
from ..sources import sample_tables as T
from ..sources.sample_logs import log_lines, spread
from .analyze import analyze

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


PAYLOAD_PATHS = {
    "job": "$.job_name", "build": "$.build_number", "branch": "$.branch", "k": "$.extra.k", "tag": "$.tags[1]", "none": "$.x.y",
}
USER_WORDS = ["refused", "failed", "no space", "timeout", "permission denied", "panic", "manifest", "credentials"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return log_lines(table(spark, folder, "events"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return extract.line_facts(lines(spark, folder))


def distinct(spark: SparkSession, folder: str) -> DataFrame:
    return extract.distinct_signals(extract.extract_signals(lines(spark, folder)))


def rounded(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


# --- text ---------------------------------------------------------------------------

@query
def clean_line(spark, folder):
    return extract.with_views(lines(spark, folder)).select("failure_id", "stage", "line_no", "clean")


@query
def json_message(spark, folder):
    return lines(spark, folder).select("failure_id", "stage", "line_no", X.json_message(F.col("raw")).alias("message"))


@query
def normalize_error_line(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    plain = docs.withColumn("text", X.ascii_only(F.col("text")))
    return plain.select("doc_id", X.normalize_error_line(F.col("text")).alias("normalized"))


@query
def normalize_for_embedding(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "html"))
    plain = pages.withColumn("html", X.ascii_only(F.col("html")))
    return plain.select("page_id", X.normalize_for_embedding(F.col("html")).alias("normalized"))


@query
def embedding_text(spark, folder):
    pages = spread(table(spark, folder, "pages").select("page_id", "url", "html"))
    text = X.ascii_only(F.col("html"))
    return pages.select(
        "page_id", X.dedup_text(F.col("url"), text, text).alias("dedup_text"),
        X.training_text(F.col("url"), text, text).alias("training_text"),
    )


@query
def fingerprint_counts(spark, folder):
    rows = extract.with_views(lines(spark, folder)).select(X.fingerprint(F.col("clean")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"))


@query
def stage_names(spark, folder):
    urls = table(spark, folder, "pages").select("page_id", "url")
    return urls.select("page_id", X.sanitize_stage(F.concat(F.lit("  "), "url", F.lit("\n"))).alias("stage"))


@query
def noise_lines(spark, folder):
    return facts(spark, folder).groupBy("failure_id", "stage").agg(F.count_if("noise").alias("noise"))


@query
def signal_type_counts(spark, folder):
    typed = facts(spark, folder).select(
        F.when(~F.col("noise"), X.signal_type(F.col("clean"))).alias("line_type")
    )
    return typed.groupBy("line_type").agg(F.count("*").alias("n"))


@query
def block_triggers(spark, folder):
    return facts(spark, folder).groupBy("block_type", "mask").agg(F.count("*").alias("n"))


# --- signals ------------------------------------------------------------------------

@query
def signals(spark, folder):
    return extract.extract_signals(lines(spark, folder))


@query
def signals_distinct(spark, folder):
    return distinct(spark, folder)


# --- categories ---------------------------------------------------------------------

@query
def score_explain(spark, folder):
    scored = classify.explain_scores(classify.category_scores(distinct(spark, folder)))
    return scored.withColumn("confidence", F.round("confidence", 6))


@query
def regex_best(spark, folder):
    best = classify.regex_best(classify.category_scores(distinct(spark, folder)))
    return best.select("failure_id", "fingerprint", "regex_category", rounded("regex_confidence"))


@query
def rule_fallback(spark, folder):
    rows = extract.with_views(lines(spark, folder)).select(classify.rule_category(F.col("clean")).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def _vector_sides(spark, folder):
    # As spread(), but rows with equal ids stay together: the search looks at them as one query.
    embeddings, cores = table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), spark.sparkContext.defaultParallelism
    everything = T.vectors(embeddings.repartition(cores, "vec_id") if embeddings.rdd.getNumPartitions() < cores else embeddings)
    stored = everything.filter((F.col("vec_id") % 5 == 0) & (F.col("k") == 0))
    return everything.filter((F.col("vec_id") % 5 != 0) | (F.col("k") > 0)), stored


def _vector_votes(spark, folder):
    queries, stored = _vector_sides(spark, folder)
    training = stored.select(
        F.col("id").alias("sample_id"), F.col("g").cast("string").alias("category"), F.col("vec").alias("embedding")
    )
    return classify.neighbour_votes(queries.select("id", "vec"), training)


@query
def knn_votes(spark, folder):
    return _vector_votes(spark, folder).select("id", "category", rounded("weight"), rounded("share"), "first_rank")


@query
def knn_best(spark, folder):
    return classify.neighbour_best(_vector_votes(spark, folder)).select(
        "id", "semantic_category", rounded("semantic_confidence")
    )


def _self_trained(spark, folder):
    """Signals, all to be classified; those whose fingerprint starts with 0..3
    are the training set too, labelled by their patterns."""
    embedded = dedup.embed_signals(distinct(spark, folder).checkpoint()).checkpoint()
    learned = F.substring("fingerprint", 1, 1).isin("0", "1", "2", "3")
    labelled = classify.regex_best(classify.category_scores(embedded.filter(learned)))
    training = labelled.groupBy("fingerprint").agg(
        F.min_by(F.struct("regex_category", "embedding"), F.struct("failure_id", "stage", "line_no")).alias("s")
    ).select(F.col("fingerprint").alias("sample_id"), F.col("s.regex_category").alias("category"), "s.embedding")
    return embedded, training.filter(F.col("category") != "UNKNOWN")


@query
def fused_category(spark, folder):
    from ..operators.neighbours import ensure_checkpoints

    ensure_checkpoints(spark)
    rows, training = _self_trained(spark, folder)
    return classify.classify(rows, training).select(
        "failure_id", "fingerprint", "category", rounded("confidence"), "owner_team"
    )


@query
def template_votes(spark, folder):
    """Signals against the generated training set (its words are drawn by hash)."""
    embedded = dedup.embed_signals(distinct(spark, folder))
    queries = embedded.groupBy(F.col("fingerprint").alias("id")).agg(F.first("embedding").alias("vec"))
    training = learn.embed_samples(learn.training_samples(spark))
    return classify.neighbour_votes(queries, training).select("id", "category", rounded("share"))


# --- known patterns, deduplication -----------------------------------------------------

def _lookup(spark, folder):
    queries, stored = _vector_sides(spark, folder)
    patterns = stored.select(F.col("id").alias("fingerprint"), F.col("vec").alias("embedding"))
    return queries, knowledge.lookup(queries.select("id", "vec"), patterns)


@query
def cache_hits(spark, folder):
    _, found = _lookup(spark, folder)
    return found.select("id", "pattern_fingerprint", rounded("similarity_score"))


@query
def cache_misses(spark, folder):
    queries, found = _lookup(spark, folder)
    return knowledge.misses(queries.select("id", "g"), found, "id")


def _clusters(spark, folder):
    return dedup.clusters(T.vectors(table(spark, folder, "embeddings")).select("g", "id", "vec"))


@query
def clusters(spark, folder):
    return _clusters(spark, folder).select("g", "id", "label", "members")


@query
def density_clusters(spark, folder):
    points = T.vectors(table(spark, folder, "embeddings")).select("g", "id", "vec")
    return dedup.density_clusters(points).select("g", "id", "label", "members")


@query
def medoids(spark, folder):
    return dedup.medoids(_clusters(spark, folder).checkpoint()).select("g", "label", "id", "members")


@query
def near_dup_keep(spark, folder):
    points = T.vectors(table(spark, folder, "embeddings")).select("g", "id", "vec")
    from ..operators.neighbours import greedy_keep

    return greedy_keep(points, dedup.NOISE_COSINE)


@query
def signal_dedup(spark, folder):
    from ..operators.neighbours import ensure_checkpoints

    ensure_checkpoints(spark)
    kept = dedup.deduplicate(dedup.embed_signals(distinct(spark, folder).checkpoint()))
    return kept.select("failure_id", "stage", "line_no", "fingerprint", "kind")


@query
def knowledge_upsert(spark, folder):
    arrivals = T.pattern_arrivals(table(spark, folder, "events"))
    stored = T.stored_patterns(table(spark, folder, "customer"))
    merged = knowledge.upsert(stored, arrivals, ["event_id"])
    shown = F.transform("embedding", lambda x: x.cast("decimal(18,4)").cast("string"))
    return merged.withColumn("embedding", F.array_join(shown, " "))


def _by_patterns(spark, folder):
    best = classify.regex_best(classify.category_scores(distinct(spark, folder)))
    return best.select(
        "failure_id", "stage", "line_no", "fingerprint", "error_line", "pre_content", "post_content",
        F.col("regex_category").alias("category"), F.col("regex_confidence").alias("confidence"),
        classify.owner_of(F.col("regex_category")).alias("owner_team"),
    )


def _learned(spark, folder):
    """Fingerprints of log lines that count as learned before."""
    lines_seen = extract.with_views(lines(spark, folder)).select(X.fingerprint(F.col("clean")).alias("fingerprint"))
    return lines_seen.filter(F.substring("fingerprint", 1, 1) == "0").distinct()


@query
def learned_antijoin(spark, folder):
    fresh = learn.learnable(_by_patterns(spark, folder), _learned(spark, folder))
    return fresh.select("fingerprint", "failure_id", "stage", "line_no", "category")


@query
def training_samples(spark, folder):
    """Signals that their patterns are sure of, as training rows."""
    fresh = learn.learnable(_by_patterns(spark, folder), _learned(spark, folder))
    return learn.samples_per_category(learn.as_samples(fresh, fresh))


@query
def catalogue_scores(spark, folder):
    """A user's catalogue: a pattern for every event type of the log's source and every market segment."""
    kinds = table(spark, folder, "events").select(F.col("event_type").alias("word")).distinct()
    names = table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("word")).distinct()
    words = kinds.unionByName(names).unionByName(spark.createDataFrame([(w,) for w in USER_WORDS], "word string"))
    category = F.element_at(F.array(*[F.lit(c) for c in C.CATEGORY_PATTERNS]), (F.length("word") % len(C.CATEGORY_PATTERNS) + 1).cast("int"))
    catalogue = words.select(category.alias("category"), F.col("word").alias("pattern_id"), F.col("word").alias("regex"))
    scored = classify.score_with_table(distinct(spark, folder), catalogue)
    return scored.withColumn("confidence", F.round("confidence", 6))


@query
def feedback_batch(spark, folder):
    now, later = learn.feedback_batch(learn.learnable(_by_patterns(spark, folder), _learned(spark, folder)), ["fingerprint"])
    both = now.withColumn("learned", F.lit(True)).unionByName(later.withColumn("learned", F.lit(False)))
    return both.select("fingerprint", "category", "learned")


# --- CI runs and failure records -------------------------------------------------------

@query
def stage_assembly(spark, folder):
    return ci_runs.stage_logs(T.steps(table(spark, folder, "lineitem")))


@query
def stage_lines(spark, folder):
    return ci_runs.stage_lines(T.steps(table(spark, folder, "lineitem")))


def _jobs(spark, folder):
    jobs = T.jobs(table(spark, folder, "orders"))
    return jobs.withColumn("result", ci_runs.normalized_status(F.col("conclusion")))


@query
def status_map(spark, folder):
    return _jobs(spark, folder).groupBy("conclusion", "result").agg(F.count("*").alias("n"))


@query
def failed_stages(spark, folder):
    return ci_runs.failed_stages(_jobs(spark, folder)).select("run", "stage", "result")


@query
def platform_of(spark, folder):
    rows = failures.display_names(failures.platform_of(T.payloads(table(spark, folder, "orders"))))
    return rows.select("intake_no", "platform", "effective_run", "reject_reason", "job", "build")


@query
def latest_run(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("branch"),
        F.col("o_orderpriority").alias("commit"), F.col("o_orderdate").alias("created_at"),
    )
    return ci_runs.select_runs(runs, branch="O", commit="1-U", limit=100).select("run", "branch", "commit")


@query
def intake_dedup(spark, folder):
    records = failures.platform_of(T.payloads(table(spark, folder, "orders")))
    kept = failures.drop_duplicates(
        records.select(*failures.INTAKE_KEYS, "intake_no", "reject_reason"), "intake_no"
    )
    return kept


@query
def payload_paths(spark, folder):
    payloads = documents.with_documents(T.payload_texts(table(spark, folder, "events")))
    return failures.values_at(payloads.select("event_id", "document"), PAYLOAD_PATHS)


@query
def payload_matches(spark, folder):
    payloads = documents.with_documents(T.payload_texts(table(spark, folder, "events")))
    return failures.matching(payloads, {"$.tags[1]": "error", "$.extra.k": "7"}).select("event_id", "job_name", "build_number")


def _records(spark, folder):
    """Failure records with the run's number as their id, taken in by the hour."""
    payloads = failures.platform_of(T.payloads(table(spark, folder, "orders")))
    return payloads.select(
        F.col("intake_no").alias("failure_id"), "platform", "commit", "branch",
        F.struct("job_name", "build_number").alias("payload"), (F.col("intake_no") % 24).alias("created_at"),
    )


@query
def find_duplicate(spark, folder):
    found = failures.find_duplicate(_records(spark, folder), "jenkins", "c7", "O", "job-5-LOW", 1)
    return found.select("failure_id", "platform", "commit", "branch", "created_at")


@query
def record_by_id(spark, folder):
    return failures.by_id(_records(spark, folder), 33).select("failure_id", "platform", "commit", "branch")


@query
def status_current(spark, folder):
    current = failures.current_status(T.status_events(table(spark, folder, "orders")))
    return current.select("failure_id", "status", "events")


@query
def status_gate(spark, folder):
    current = failures.current_status(T.status_events(table(spark, folder, "orders")))
    return current.select("failure_id", failures.step_for(F.col("status")).alias("step")).filter("step IS NOT NULL")


# --- root causes and reports ---------------------------------------------------------------

@query
def remediation_decode(spark, folder):
    rows = rca.decoded(T.remediation_json(table(spark, folder, "lineitem")), remediation="stored")
    r = F.col("remediation")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r["action"].alias("action"), r["strategy"].alias("strategy"), r["target"].alias("target"),
        r["reason"].alias("reason"), r["retry_count"].alias("retry_count"),
    )


@query
def contract_gaps(spark, folder):
    rows = rca.decoded(T.remediation_json(table(spark, folder, "lineitem")), remediation="stored")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join(rca.contract_gaps(F.col("remediation")), ",").alias("gaps"),
    )


@query
def remediation_valid(spark, folder):
    rows = T.remediation_json(table(spark, folder, "lineitem"))
    checked = rca.validate(rca.decoded(rows, remediation="stored", secondary_remediations="secondary"))
    r = F.col("remediation")
    return checked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "severity", "valid",
        F.array_join("errors", ",").alias("errors"), r["suggested_patch"].alias("suggested_patch"),
        r["retry_count"].alias("retry_count"), r["skip_reason"].alias("skip_reason"), r["priority"].alias("priority"),
    )


@query
def rca_requests(spark, folder):
    return rca.requests(_by_patterns(spark, folder)).select(
        "failure_id", "fingerprint", "action", "error_line", "before", "after", "strategies", "required", "request"
    )


@query
def rca_enriched(spark, folder):
    classified = _by_patterns(spark, folder)
    answers = rca.template_analyzer(rca.requests(classified))
    rows = rca.validate(rca.enrich(answers, classified, F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return rows.select(
        "failure_id", "fingerprint", "validated_category", "owner", "root_cause", "severity", "analyzed_at",
        F.col("remediation.action").alias("action"), F.col("remediation.strategy").alias("strategy"), "valid",
    )


@query
def classification_requests(spark, folder):
    return classify.classification_requests(_by_patterns(spark, folder)).select(
        "failure_id", "fingerprint", "request"
    )


@query
def report_summary(spark, folder):
    done = report.summary(T.root_causes(table(spark, folder, "orders")))
    return done.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def report_rows(spark, folder):
    return report.rows(T.root_causes(table(spark, folder, "orders")), order="sequence").drop("analyzed_at", "evidence_url")


@query
def owner_counts(spark, folder):
    return report.owner_counts(T.root_causes(table(spark, folder, "orders")))


@query
def recipients(spark, folder):
    done = report.recipients(
        T.root_causes(table(spark, folder, "orders")), T.mail_of(table(spark, folder, "customer")), "ci@x"
    )
    return done.select("failure_id", F.array_join("recipients", ",").alias("recipients"))


@query
def stage_counters(spark, folder):
    """Real output of deduplication, looked up among the patterns of learned fingerprints."""
    found = extract.extract_signals(lines(spark, folder)).checkpoint()
    embedded = dedup.embed_signals(extract.distinct_signals(found).checkpoint()).checkpoint()
    kept = dedup.deduplicate(embedded).checkpoint()
    vectors = embedded.groupBy("fingerprint").agg(F.first("embedding").alias("embedding"))
    known = vectors.filter(F.substring("fingerprint", 1, 1) == "0")
    queries = vectors.join(kept.select("fingerprint").distinct(), "fingerprint").select(
        F.col("fingerprint").alias("id"), F.col("embedding").alias("vec")
    )
    hits = knowledge.hits(kept, knowledge.lookup(queries, known), "fingerprint").select("failure_id", "fingerprint")
    return report.stage_counters(found, kept, hits, lines(spark, folder).select("failure_id"))


@query
def analyze_summary(spark, folder):
    """The whole pipeline."""
    return analyze(lines(spark, folder))["summary"].withColumn("avg_confidence", F.round("avg_confidence", 6))
