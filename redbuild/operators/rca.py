"""Root causes: request rows, remediation decoding and rules, enrichment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fence import fence

# --- fixed values: category -> action, action -> strategies offered in requests ----
ACTIONS = {
    "DEV_FAILURE": "FIX_DEV",
    "TEST_FAILURE": "FIX_TEST",
    "CI_INFRA_FAILURE": "FIX_CI_INFRA",
    "UNKNOWN": "MANUAL_INVESTIGATION",
}
OFFERED_STRATEGIES = {
    "FIX_DEV": [
        "CLEAN_REBUILD", "RESOLVE_DEPENDENCY", "UPGRADE_DEPENDENCY", "GENERATE_CODE_PATCH",
        "APPLY_LINT_FIX", "FIX_CODE_QUALITY", "REVERT_COMMIT",
    ],
    "FIX_TEST": [
        "FIX_ASSERTION", "RESET_TEST_DATA", "UPDATE_TEST_SNAPSHOT", "INCREASE_TEST_TIMEOUT",
        "MOCK_EXTERNAL_SERVICE", "MARK_FLAKY_RETRY", "SKIP_TEST_TEMPORARILY",
    ],
    "FIX_CI_INFRA": [
        "FIX_PIPELINE_SYNTAX", "UPDATE_ENV_VAR", "ROTATE_CREDENTIALS", "UPDATE_SECRET",
        "FIX_PATH_OR_PATTERN", "ENSURE_ARTIFACT_GENERATION", "FIX_CONTAINER_IMAGE", "FIX_K8S_MANIFEST",
        "RESTART_RESOURCE", "REPROVISION_RUNNER", "RETRY_WITH_CLEAN_CACHE", "SCALE_RESOURCES",
        "FIX_NETWORK_POLICY", "UPDATE_PLUGIN_VERSION", "FIX_PLUGIN_CONFIGURATION", "VALIDATE_FILE_EXISTENCE",
    ],
    "MANUAL_INVESTIGATION": [],
}
# --- fixed values: strategies accepted in an answer ---------------------------------
VALID_STRATEGIES = {
    "FIX_DEV": [
        "CLEAN_REBUILD", "RESOLVE_DEPENDENCY", "APPLY_LINT_FIX", "GENERATE_CODE_PATCH",
        "UPDATE_ENV_MOCK", "REVERT_COMMIT", "UPGRADE_DEPENDENCY",
    ],
    "FIX_TEST": [
        "MARK_FLAKY_RETRY", "RESET_TEST_DATA", "UPDATE_TEST_SNAPSHOT", "INCREASE_TEST_TIMEOUT",
        "SKIP_TEST_TEMPORARILY", "FIX_ASSERTION", "MOCK_EXTERNAL_SERVICE",
    ],
    "FIX_CI_INFRA": [
        "RESTART_RESOURCE", "RETRY_WITH_CLEAN_CACHE", "SCALE_RESOURCES", "UPDATE_SECRET",
        "REPROVISION_RUNNER", "FIX_PATH_OR_PATTERN", "ENSURE_ARTIFACT_GENERATION", "UPDATE_PLUGIN_VERSION",
        "FIX_PLUGIN_CONFIGURATION", "VALIDATE_FILE_EXISTENCE", "ROTATE_CREDENTIALS", "FIX_NETWORK_POLICY",
    ],
}
# --- fixed values: what an answer must fill in, by action and by strategy; lists that may be empty ----
REQUIRED_FIELDS = {
    "FIX_DEV": ["target", "related_files"],
    "FIX_TEST": ["target", "fix_commands"],
    "FIX_CI_INFRA": ["target", "estimated_recovery_time_seconds", "requires_human_approval", "fix_commands"],
    "MANUAL_INVESTIGATION": ["reason", "suggested_next_step", "escalation_team", "priority", "investigation_links"],
}
STRATEGY_FIELDS = {
    "CLEAN_REBUILD": ["fix_commands"],
    "RESOLVE_DEPENDENCY": ["related_files", "fix_commands"],
    "UPGRADE_DEPENDENCY": ["fix_commands"],
    "GENERATE_CODE_PATCH": ["suggested_patch", "patch_confidence"],
    "APPLY_LINT_FIX": ["fix_commands"],
    "FIX_CODE_QUALITY": ["fix_commands"],
    "REVERT_COMMIT": ["fix_commands"],
    "MARK_FLAKY_RETRY": ["retry_count"],
    "SKIP_TEST_TEMPORARILY": ["skip_reason"],
}
APPROVED_BY_HAND = ["ROTATE_CREDENTIALS", "UPDATE_SECRET", "FIX_NETWORK_POLICY"]
MAY_BE_EMPTY = ["related_files", "investigation_links"]
LIST_FIELDS = ["fix_commands", "related_files", "investigation_links"]
NUMBER_FIELDS = ["patch_confidence", "retry_count", "estimated_recovery_time_seconds", "requires_human_approval"]
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
MANUAL = "MANUAL_INVESTIGATION"
MANUAL_BELOW = 0.3
DEFAULT_SKIP_REASON = "Pending investigation — add ticket reference before merging."
PLACE = ["stage", "line_no"]  # where a signal stands in its failure: the order of reports
ERROR_CHARS, PRE_CHARS, POST_CHARS = 400, 150, 250

REMEDIATION = (
    "struct<action:string,strategy:string,target:string,fix_commands:array<string>,suggested_patch:string,"
    "patch_confidence:double,retry_count:int,skip_reason:string,estimated_recovery_time_seconds:int,"
    "requires_human_approval:boolean,reason:string,suggested_next_step:string,escalation_team:string,"
    "priority:string,investigation_links:array<string>,related_files:array<string>,notes:string>"
)

Analyzer = Callable[[DataFrame], DataFrame]


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), table.items(), F)


def action_of(category: Column) -> Column:
    return F.coalesce(_lookup(category, ACTIONS), F.lit(MANUAL))


def contract_text(action: str) -> str:
    """The fields an answer with this action must have, then those of its strategies."""
    rules = [f"{s}: {', '.join(STRATEGY_FIELDS[s])}" for s in OFFERED_STRATEGIES[action] if s in STRATEGY_FIELDS]
    approved = [s for s in OFFERED_STRATEGIES[action] if s in APPROVED_BY_HAND]
    if approved:
        rules.append(f"requires_human_approval is true for {', '.join(approved)}")
    return "; ".join([", ".join(REQUIRED_FIELDS[action]), *rules])


def contract_gaps(r: Column) -> Column:
    """Names of the fields that a remediation's action and strategy ask for and that it lacks, in alphabetical order.

    Softer than `remediation_errors`: such a remediation is valid, but an analyzer can be asked again.  Texts and lists
    must not be empty, but for lists that may be; a strategy that needs an approval must say so.
    """

    def lacks(field: str) -> Column:
        value = r[field]
        if field in LIST_FIELDS and field not in MAY_BE_EMPTY:
            return value.isNull() | (F.size(value) == 0)
        return value.isNull() if field in LIST_FIELDS + NUMBER_FIELDS else value.isNull() | (F.trim(value) == "")

    asked: dict[str, list[Column]] = {}
    for action, fields in REQUIRED_FIELDS.items():
        for field in fields:
            asked.setdefault(field, []).append(r["action"] == action)
    for strategy, fields in STRATEGY_FIELDS.items():
        for field in fields:
            asked.setdefault(field, []).append(r["strategy"] == strategy)
    rules = {f: reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in when]) & lacks(f) for f, when in asked.items()}
    rules["requires_human_approval"] |= r["strategy"].isin(*APPROVED_BY_HAND) & ~F.coalesce(r["requires_human_approval"], F.lit(False))
    return F.array_compact(F.array(*[F.when(rules[f], f) for f in sorted(rules)]))


def requests(classified: DataFrame) -> DataFrame:
    """One row per classified signal with everything an analyzer needs, and the
    same as a text.  Evidence is cut to 400 / 150 / 250 characters."""

    def evidence(c: str, cut: Callable[[Column], Column]) -> Column:
        return F.when(F.length(c) > 0, cut(F.col(c))).otherwise("(none)")

    strategies = {a: ", ".join(s) if s else "N/A" for a, s in OFFERED_STRATEGIES.items()}
    rows = classified.select(
        "failure_id", "stage", "fingerprint", "category", "confidence", "owner_team",
        action_of(F.col("category")).alias("action"),
        evidence("error_line", lambda c: F.substring(c, 1, ERROR_CHARS)).alias("error_line"),
        evidence("pre_content", lambda c: F.right(c, F.lit(PRE_CHARS))).alias("before"),
        evidence("post_content", lambda c: F.substring(c, 1, POST_CHARS)).alias("after"),
    ).withColumns({
        "strategies": _lookup(F.col("action"), strategies),
        "required": _lookup(F.col("action"), {a: contract_text(a) for a in REQUIRED_FIELDS}),
    })
    return rows.withColumn("request", F.concat(
        F.lit("Find the root cause of this CI failure and one remediation that can be carried out as given.\n"),
        F.lit("Action: "), F.col("action"), F.lit("\nStrategy, one of: "), F.col("strategies"),
        F.lit("\nRequired fields: "), F.col("required"),
        F.lit("\nStage: "), F.col("stage"), F.lit("\nCategory: "), F.col("category"),
        F.lit("\nError line:\n"), F.col("error_line"),
        F.lit("\nBefore:\n"), F.col("before"), F.lit("\nAfter:\n"), F.col("after"),
    ))


def template_analyzer(rows: DataFrame) -> DataFrame:
    """Default analyzer: the category's action with its first accepted strategy.

    (failure_id, fingerprint, root_cause, remediation, secondary_remediations,
    rca_confidence, severity)
    """
    first = {
        action: next(s for s in OFFERED_STRATEGIES[action] if s in VALID_STRATEGIES[action])
        for action in VALID_STRATEGIES
    }
    manual = (F.col("action") == MANUAL) | (F.col("confidence") < MANUAL_BELOW)
    action = F.when(manual, MANUAL).otherwise(F.col("action"))
    reason = F.when(manual, F.concat(F.lit("no automatic remediation for "), F.col("category")))
    null = F.lit(None)
    values = {
        "action": action,
        "strategy": F.when(~manual, _lookup(F.col("action"), first)),
        "target": F.when(~manual, F.col("stage")),
        "fix_commands": F.array(),
        "reason": reason,
        "priority": F.when(manual, "MEDIUM"),
        "requires_human_approval": F.when(action == "FIX_CI_INFRA", False),
        "investigation_links": F.array(),
        "related_files": F.array(),
    }
    fields = [f.split(":")[0] for f in REMEDIATION[len("struct<"):-1].split(",")]
    remediation = F.struct(*[values.get(f, null).alias(f) for f in fields]).cast(REMEDIATION)
    return rows.select(
        "failure_id", "fingerprint",
        F.concat(F.col("category"), F.lit(" in stage "), F.col("stage"), F.lit(": "), F.col("error_line")).alias("root_cause"),
        remediation.alias("remediation"),
        F.lit(None).cast(f"array<{REMEDIATION}>").alias("secondary_remediations"),
        F.col("confidence").alias("rca_confidence"),
        F.when(F.col("category") == "CI_INFRA_FAILURE", "HIGH").otherwise("MEDIUM").alias("severity"),
    )


def enrich(answers: DataFrame, classified: DataFrame, now: Column | None = None) -> DataFrame:
    """Root-cause rows: category, error line, owner and fingerprint always come
    from the classifier, whatever the analyzer answered."""
    place = [c for c in PLACE if c in classified.columns]
    own = classified.select(
        "failure_id", "fingerprint", F.col("category").alias("validated_category"),
        "error_line", F.col("owner_team").alias("owner"), *place,
    )
    given = answers.drop("validated_category", "error_line", "owner", *place)
    stamp = F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if now is None else now,
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    rows = given.join(own, ["failure_id", "fingerprint"])
    defaults = {
        "recurrence_count": F.lit(0), "analyzed_at": stamp,
        "evidence_url": F.lit(None).cast("string"), "similarity_score": F.lit(None).cast("double"),
    }
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def decode_remediation(json: Column) -> Column:
    """Stored JSON -> remediation.  Without an action it is a manual one; an
    action that does not exist, or unreadable text, gives NULL (a miss)."""
    def known(raw: Column) -> Column:
        filled = raw.withField("action", F.coalesce(raw["action"], F.lit(MANUAL)))
        return F.when(filled["action"].isin(*ACTIONS.values()), filled)

    readable = json.isNotNull() & F.try_parse_json(json).isNotNull()
    # The one-element array makes the parsed text one value, however many fields are read from it.
    return F.when(readable, F.element_at(F.transform(F.array(F.from_json(json, REMEDIATION)), known), 1))


def decoded(rows: DataFrame, **columns: str) -> DataFrame:
    """Adds remediations parsed from stored texts: decoded(rows, remediation="stored").  Each text is parsed once."""
    for name, stored in columns.items():
        decode = decode_remediations if name.endswith("s") else decode_remediation
        rows = fence(rows.withColumn(name, decode(F.col(stored))), name)
    return rows


def decode_remediations(json: Column) -> Column:
    """Stored JSON list -> array of remediations; one undecodable entry gives NULL."""
    def known(raw: Column) -> Column:
        filled = F.transform(raw, lambda r: r.withField("action", F.coalesce(r["action"], F.lit(MANUAL))))
        return F.when(F.forall(filled, lambda r: r["action"].isin(*ACTIONS.values())), filled)

    return F.element_at(F.transform(F.array(F.from_json(json, f"array<{REMEDIATION}>")), known), 1)


def _default_strategy_fields(r: Column) -> Column:
    """Fields that belong to another strategy become NULL, missing ones get defaults."""
    strategy, action = r["strategy"], r["action"]
    patch = (action == "FIX_DEV") & (strategy == "GENERATE_CODE_PATCH")
    skip = (action == "FIX_TEST") & (strategy == "SKIP_TEST_TEMPORARILY")
    no_reason = r["skip_reason"].isNull() | (r["skip_reason"] == "")
    return (
        r.withField("suggested_patch", F.when(patch, r["suggested_patch"]))
        .withField("patch_confidence", F.when(patch, r["patch_confidence"]))
        .withField(
            "retry_count",
            F.when((action == "FIX_TEST") & (strategy == "MARK_FLAKY_RETRY"), r["retry_count"]),
        )
        .withField("skip_reason", F.when(skip & no_reason, DEFAULT_SKIP_REASON).otherwise(r["skip_reason"]))
        .withField(
            "requires_human_approval",
            F.when(action == "FIX_CI_INFRA", F.coalesce(r["requires_human_approval"], F.lit(False)))
            .otherwise(r["requires_human_approval"]),
        )
        .withField(
            "priority",
            F.when(action == MANUAL, F.coalesce(r["priority"], F.lit("MEDIUM"))).otherwise(r["priority"]),
        )
        .withField("fix_commands", F.coalesce(r["fix_commands"], F.array().cast("array<string>")))
        .withField("related_files", F.coalesce(r["related_files"], F.array().cast("array<string>")))
    )


def remediation_errors(r: Column) -> Column:
    """Names of the broken rules, before any field is reset."""
    action, strategy = r["action"], r["strategy"]

    def broken(name: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), name)

    fixes = action.isin(*VALID_STRATEGIES)
    accepted = reduce(
        lambda acc, kv: acc.when(action == kv[0], strategy.isin(*kv[1])), VALID_STRATEGIES.items(), F
    )
    return F.array_compact(F.array(
        broken("action", action.isNull() | ~action.isin(*ACTIONS.values())),
        broken("strategy", fixes & (strategy.isNull() | ~accepted)),
        broken("target", fixes & r["target"].isNull()),
        broken("patch_confidence", (action == "FIX_DEV") & ~r["patch_confidence"].between(0.0, 1.0)),
        broken("retry_count", (action == "FIX_TEST") & ~r["retry_count"].between(1, 5)),
        broken("recovery_time", (action == "FIX_CI_INFRA") & (r["estimated_recovery_time_seconds"] < 0)),
        broken("reason", (action == MANUAL) & r["reason"].isNull()),
        broken("priority", (action == MANUAL) & ~r["priority"].isin(*LEVELS)),
    ))


def validate(root_causes: DataFrame) -> DataFrame:
    """Adds `errors` and `valid`, and resets strategy fields of the remediation.

    Needs remediation (NULL: undecodable, an error), rca_confidence and
    severity; of the other columns of a root cause those that are there are
    tested.  Split on `valid` for good rows and quarantine.
    """
    own = F.when(F.col("remediation").isNull(), F.array(F.lit("remediation"))).otherwise(remediation_errors(F.col("remediation")))
    tests = {
        "severity": ~F.col("severity").isin(*LEVELS),
        "rca_confidence": F.col("rca_confidence").isNull() | ~F.col("rca_confidence").between(0.0, 1.0),
        "manual_expected": (F.col("rca_confidence") < MANUAL_BELOW) & (F.col("remediation.action") != MANUAL),
    }
    of_column = {
        "root_cause": lambda c: c.isNull(),
        "error_line": lambda c: c.isNull(),
        "recurrence_count": lambda c: c < 0,
        "similarity_score": lambda c: ~c.between(0.0, 1.0),
        "secondary_remediations": lambda c: F.exists(c, lambda r: F.size(remediation_errors(r)) > 0),
    }
    tests |= {name: test(F.col(name)) for name, test in of_column.items() if name in root_causes.columns}
    levels = F.array_compact(F.array(*[F.when(broken, name) for name, broken in tests.items()]))
    rows = root_causes.withColumn("severity", F.coalesce("severity", F.lit("MEDIUM")))
    return (
        rows.withColumn("errors", F.concat(own, levels))
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("remediation", _default_strategy_fields(F.col("remediation")))
    )


def usable(patterns: DataFrame) -> DataFrame:
    """Stored patterns whose root cause can be given again: readable and valid by today's rules.  Remediations may be
    stored as JSON or as they are."""
    kinds = dict(patterns.dtypes)
    for name in ("remediation", "secondary_remediations"):
        if kinds.get(name) == "string":
            patterns = decoded(patterns.withColumnRenamed(name, f"_{name}"), **{name: f"_{name}"})
            if name == "secondary_remediations":  # a list that is there must be readable
                patterns = patterns.filter(F.col(f"_{name}").isNull() | F.col(name).isNotNull())
            patterns = patterns.drop(f"_{name}")
    checked = fence(validate(patterns), "errors", "valid")
    return checked.filter("valid").drop("errors", "valid")


def root_causes(classified: DataFrame, analyzer: Analyzer = template_analyzer) -> DataFrame:
    """Classified signals -> validated root-cause rows (`valid`, `errors`)."""
    return validate(enrich(analyzer(requests(classified)), classified))
