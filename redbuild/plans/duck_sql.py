"""The registered queries in SQL for DuckDB, written independently of the Spark plans.

The scan is a chain over "next candidate at or after my resume point" here, and
neighbours are found by comparing everything with everything.
"""

from __future__ import annotations

import hashlib

from ..functions import category_rules as C
from ..functions import signal_rules as R
from ..functions import training_rules as T
from ..operators import ci_runs, failures, rca, report
from ..sources.sample_logs import log_lines_sql

ORACLES: dict[str, str] = {}

SPACE = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31))"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def plain(pattern: str) -> str:
    """The same pattern without look-ahead."""
    return pattern.replace(r"(?!0\b)\d+\b", r"(?:[1-9]\d*|0\d+)\b").replace(
        r"\b(?!\.\w)", r"(?:$|[^.\w]|\.(?:\W|$))"
    )


def matches(x: str, pattern: str, flags: str = "i-s") -> str:
    return f"regexp_matches({x}, {text(f'(?{flags})' + plain(pattern))})"


def any_of(x: str, patterns: list[str], flags: str = "i-s") -> str:
    return "(" + " OR ".join(matches(x, p, flags) for p in patterns) + ")"


def replace_all(x: str, pattern: str, replacement: str, ignore_case: bool = False) -> str:
    flags = "(?i-s)" if ignore_case else "(?-s)"
    return f"regexp_replace({x}, {text(flags + pattern)}, {text(replacement)}, 'g')"


def case(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def ascii_only(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]+', '', 'g')"


def unstamped(x: str) -> str:
    return strip(replace_all(strip(f"lower({x})"), R.TIMESTAMP, "", True))


def message(x: str) -> str:
    fields = []
    for key in R.JSON_MESSAGE_KEYS:
        path = text(f"$.{key}")
        value = f"json_extract_string({x}, {path})"
        fields.append(
            f"CASE json_type({x}, {path}) WHEN 'VARCHAR' THEN nullif({value}, '') "
            f"WHEN 'BIGINT' THEN nullif({value}, '0') WHEN 'UBIGINT' THEN nullif({value}, '0') END"
        )
    return f"CASE WHEN starts_with({x}, '{{') AND json_valid({x}) THEN coalesce({', '.join(fields)}, {x}) ELSE {x} END"


def normalized(x: str) -> str:
    out = f"lower({x})"
    for pattern, replacement in R.FINGERPRINT_REWRITES:
        out = replace_all(out, pattern, replacement)
    return strip(out)


def for_embedding(x: str) -> str:
    out = x
    for pattern, replacement, ignore_case in R.EMBEDDING_REWRITES:
        out = replace_all(out, pattern, replacement.replace("$1", r"\1"), ignore_case)
    return strip(replace_all(f"lower({out})", r"\s+", " "))


def embedding_text(error: str, post: str, pre: str) -> str:
    parts = [f"CASE WHEN length({x}) > 0 THEN {for_embedding(x)} END" for x in (error, post, pre)]
    return f"concat_ws(' ', {', '.join(parts)})"


def signal_type(x: str) -> str:
    return case((any_of(x, ps), text(t)) for t, ps in R.SIGNAL_TYPES.items())


FILE = "failure_id, stage"

LINES = f"lines AS MATERIALIZED ({log_lines_sql()})"
FACTS = f"""{LINES},
views AS (
    SELECT {FILE}, line_no, ascii, {any_of('ascii', R.NOISE_LINES, '-s')} AS noise,
           {unstamped('ascii')} AS block_line, {message('ascii')} AS message
    FROM (SELECT *, {ascii_only('raw')} AS ascii FROM lines)),
cleaned AS (SELECT *, {unstamped('message')} AS clean FROM views),
facts AS MATERIALIZED (
    SELECT *,
           CASE WHEN NOT noise THEN {case((matches('clean', p), text(t)) for t, p in R.BLOCK_TRIGGERS.items())} END AS block_type,
           CASE WHEN NOT noise THEN {signal_type('clean')} END AS line_type,
           {' + '.join(f"CASE WHEN {matches('block_line', p)} THEN {1 << b} ELSE 0 END" for b, p in enumerate(R.BLOCK_CONTINUATIONS.values()))} AS mask
    FROM cleaned)"""

_stops = ", ".join(
    f"min(CASE WHEN mask & {1 << b} = 0 THEN line_no END) OVER later AS stop_{b}" for b, _ in enumerate(R.BLOCK_TRIGGERS)
)
_own_stop = case((f"block_type = {text(t)}", f"stop_{b}") for b, t in enumerate(R.BLOCK_TRIGGERS))
_mark = "list_position(list_transform(bl, lambda x: regexp_matches(x, '(?i)\\*\\s+what went wrong')), true)"
SIGNALS = f"""{FACTS},
ends AS (
    SELECT {FILE}, line_no, block_type, line_type, clean, max(line_no) OVER (PARTITION BY {FILE}) AS last_line, {_stops}
    FROM facts WINDOW later AS (PARTITION BY {FILE} ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
cand AS MATERIALIZED (
    SELECT *, CASE WHEN block_type IS NULL THEN i + {R.POST_CONTEXT + 2} ELSE stop + {R.POST_CONTEXT + 1} END AS resume
    FROM (SELECT {FILE}, line_no AS i, block_type, coalesce(CASE WHEN block_type IS NOT NULL THEN 'ERROR' END, line_type) AS signal_type, clean,
                 CASE WHEN block_type IS NULL THEN line_no + 1 ELSE coalesce({_own_stop}, last_line + 1) END AS stop
          FROM ends WHERE block_type IS NOT NULL OR line_type IS NOT NULL)),
succ AS MATERIALIZED (
    SELECT c.failure_id, c.stage, c.i, n.i AS after
    FROM cand c ASOF JOIN cand n ON c.failure_id = n.failure_id AND c.stage = n.stage AND c.resume <= n.i),
chain AS (
    SELECT {FILE}, min(i) AS i FROM cand GROUP BY {FILE}
    UNION ALL
    SELECT s.failure_id, s.stage, s.after FROM chain k JOIN succ s ON k.failure_id = s.failure_id AND k.stage = s.stage AND k.i = s.i),
ev AS MATERIALIZED (SELECT c.* FROM cand c JOIN chain k USING (failure_id, stage, i)),
free AS MATERIALIZED (
    SELECT f.failure_id, f.stage, f.line_no,
           CASE WHEN f.noise OR f.line_no = e.resume - 1 THEN f.ascii || chr(10) ELSE f.clean END AS txt,
           row_number() OVER (PARTITION BY f.failure_id, f.stage ORDER BY f.line_no) AS rk
    FROM facts f ASOF LEFT JOIN ev e ON f.failure_id = e.failure_id AND f.stage = e.stage AND f.line_no >= e.i
    WHERE e.i IS NULL OR f.line_no >= e.resume - 1),
ranked AS (
    SELECT e.*, coalesce(f.rk, 0) AS r
    FROM ev e ASOF LEFT JOIN free f ON e.failure_id = f.failure_id AND e.stage = f.stage AND e.i > f.line_no),
pre AS (
    SELECT e.failure_id, e.stage, e.i, string_agg(f.txt, '' ORDER BY f.rk) AS txt
    FROM ranked e JOIN free f ON e.failure_id = f.failure_id AND e.stage = f.stage AND f.rk > e.r - {R.PRE_CONTEXT} AND f.rk <= e.r
    GROUP BY ALL),
post AS (
    SELECT e.failure_id, e.stage, e.i, string_agg(f.ascii || chr(10), '' ORDER BY f.line_no) AS txt
    FROM ev e JOIN facts f ON e.failure_id = f.failure_id AND e.stage = f.stage AND f.line_no >= e.stop AND f.line_no < e.stop + {R.POST_CONTEXT}
    GROUP BY ALL),
inner_lines AS (
    SELECT e.failure_id, e.stage, e.i, list(f.block_line ORDER BY f.line_no) AS bl
    FROM ev e JOIN facts f ON e.failure_id = f.failure_id AND e.stage = f.stage AND f.line_no > e.i AND f.line_no < e.stop
    WHERE e.block_type IS NOT NULL GROUP BY ALL),
blocks AS (
    SELECT e.*, coalesce(pre.txt, '') AS before, coalesce(post.txt, '') AS post_content,
           list_concat([e.clean], coalesce(b.bl, [])) AS bl
    FROM ev e LEFT JOIN pre USING (failure_id, stage, i) LEFT JOIN post USING (failure_id, stage, i)
    LEFT JOIN inner_lines b USING (failure_id, stage, i)),
marked AS (SELECT *, len(bl) AS n, CASE WHEN block_type = 'gradle_failure' AND {_mark} > 0 AND {_mark} < len(bl) THEN {_mark} END AS m FROM blocks),
resolved AS (
    SELECT *,
           CASE WHEN block_type = 'python_traceback' THEN bl[n]
                WHEN block_type = 'rust_panic' THEN coalesce(nullif(trim(regexp_extract(bl[1], '(?i)panicked at (.+)', 1), '''"'), ''), bl[1])
                WHEN block_type = 'dart_exception' AND n > 1 THEN bl[2]
                WHEN m IS NOT NULL THEN {strip("ltrim(bl[m + 1], '> ')")}
                ELSE bl[1] END AS error_line,
           array_to_string(
               CASE WHEN block_type IS NULL THEN []
                    WHEN block_type = 'python_traceback' THEN bl[1:n - 1]
                    WHEN block_type = 'dart_exception' AND n > 1 THEN list_concat(bl[1:1], bl[3:n])
                    WHEN m IS NOT NULL THEN list_concat(bl[1:m - 1], bl[m + 2:n])
                    ELSE bl[2:n] END, chr(10)) AS inside
    FROM marked),
signals AS MATERIALIZED (
    SELECT {FILE}, i AS line_no, signal_type, block_type, sha256({normalized('error_line')}) AS fingerprint, error_line,
           CASE WHEN inside <> '' THEN before || chr(10) || inside ELSE before END AS pre_content, post_content
    FROM resolved),
once AS MATERIALIZED (
    SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY failure_id, fingerprint ORDER BY stage, line_no) = 1)"""

SIGNAL_COLUMNS = f"{FILE}, line_no, signal_type, block_type, fingerprint, error_line, pre_content, post_content"


def _weights(patterns: list[str]) -> str:
    def one(p: str) -> str:
        return " + ".join(f"CASE WHEN {matches(f, p)} THEN {w} ELSE 0 END" for f, w in C.FIELD_WEIGHTS.items())

    return "[" + ", ".join(one(p) for p in patterns) + "]"


def _confidence(score: str, n: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 0.0 WHEN {score} >= {C.MAX_PER_PATTERN} THEN least(1.0, 0.85 + least(0.10, {n} * 0.02)) "
        f"WHEN {score} >= {C.MEDIUM_SCORE} THEN least(1.0, 0.65 + least(0.20, {n} * 0.05)) "
        f"ELSE least(0.60, CAST({score} AS DOUBLE) / ({n} * {C.MAX_PER_PATTERN}) + greatest(0, {n} - 1) * 0.08) END::DOUBLE"
    )


def _scored(source: str) -> str:
    weights = ", ".join(f"{_weights(ps)} AS w_{c}" for c, ps in C.CATEGORY_PATTERNS.items())
    union = " UNION ALL ".join(
        f"SELECT *, '{c}' AS category, CAST(list_sum(w_{c}) AS INT) AS score, "
        f"CAST(len(list_filter(w_{c}, lambda x: x > 0)) AS INT) AS matches, "
        f"{s['priority']} AS priority, {s['regex_min']}::DOUBLE AS threshold FROM weighed"
        for c, s in C.CATEGORY_SETTINGS.items()
    )
    return f"""weighed AS MATERIALIZED (SELECT *, {weights} FROM {source}),
scored AS MATERIALIZED (
    SELECT * EXCLUDE (w_DEV_FAILURE, w_TEST_FAILURE, w_CI_INFRA_FAILURE), {_confidence('score', 'matches')} AS confidence
    FROM ({union}) WHERE score > 0),
best AS MATERIALIZED (
    SELECT o.*, coalesce(s.category, '{C.UNKNOWN}') AS regex_category, coalesce(s.confidence, 0.0)::DOUBLE AS regex_confidence
    FROM {source} o LEFT JOIN (
        SELECT failure_id, fingerprint, category, confidence FROM scored
        QUALIFY row_number() OVER (PARTITION BY failure_id, fingerprint ORDER BY score DESC, priority) = 1) s
    USING (failure_id, fingerprint))"""


def _owner(x: str) -> str:
    return case(((f"{x} = {text(c)}", text(o)) for c, o in C.OWNERS.items()), text(C.UNOWNED))


def _rule(x: str) -> str:
    return case(
        ((" OR ".join(f"contains(lower({x}), {text(w)})" for w in ws), text(c)) for c, ws in C.KEYWORD_RULES.items()),
        text(C.UNKNOWN),
    )


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {ctes}\n{select}" if ctes else select


# --- text ---------------------------------------------------------------------------
oracle("clean_line", FACTS, f"SELECT {FILE}, line_no, clean FROM facts")
oracle("json_message", LINES, f"SELECT {FILE}, line_no, {message('raw')} AS message FROM lines")
oracle("normalize_error_line", "", f"SELECT doc_id, {normalized(ascii_only('text'))} AS normalized FROM documents")
oracle("normalize_for_embedding", "", f"SELECT page_id, {for_embedding(ascii_only('html'))} AS normalized FROM pages")
oracle(
    "embedding_text", f"p AS (SELECT page_id, url, {ascii_only('html')} AS h FROM pages)",
    f"SELECT page_id, {embedding_text('url', 'substr(h, 1, 200)', 'right(h, 100)')} AS dedup_text, "
    f"{embedding_text('url', 'substr(h, 1, 200)', 'substr(h, 1, 100)')} AS training_text FROM p",
)
oracle("fingerprint_counts", FACTS, f"SELECT sha256({normalized('clean')}) AS fingerprint, count(*) AS n FROM facts GROUP BY 1")
oracle(
    "stage_names", "",
    f"SELECT page_id, regexp_replace(lower({strip(chr(39) + '  ' + chr(39) + ' || url || chr(10)')}), '[^a-zA-Z0-9._-]', '_', 'g') AS stage FROM pages",
)
oracle("noise_lines", FACTS, f"SELECT {FILE}, count(*) FILTER (noise) AS noise FROM facts GROUP BY ALL")
oracle("signal_type_counts", FACTS, "SELECT line_type, count(*) AS n FROM facts GROUP BY ALL")
oracle("block_triggers", FACTS, "SELECT block_type, mask, count(*) AS n FROM facts GROUP BY ALL")

# --- signals ------------------------------------------------------------------------
oracle("signals", SIGNALS, f"SELECT {SIGNAL_COLUMNS} FROM signals")
oracle("signals_distinct", SIGNALS, f"SELECT {SIGNAL_COLUMNS} FROM once")

# --- categories ---------------------------------------------------------------------
BY_PATTERNS = f"{SIGNALS}, {_scored('once')}"
oracle(
    "score_explain", BY_PATTERNS,
    "SELECT failure_id, fingerprint, category, score, matches, round(confidence, 6) AS confidence, priority, threshold FROM scored",
)
oracle(
    "regex_best", BY_PATTERNS,
    "SELECT failure_id, fingerprint, regex_category, round(regex_confidence, 6) AS regex_confidence FROM best",
)
oracle("rule_fallback", FACTS, f"SELECT {_rule('clean')} AS category, count(*) AS n FROM facts GROUP BY 1")

VECTORS = """points AS MATERIALIZED (
    SELECT g, vec_id * 3 + k AS id, k, vec_id,
           list_transform(embedding, lambda x, j: x::DOUBLE + size * (((vec_id * 7 + (j - 1) * 13 + k * 5) % 11 - 5) / 5.0::DOUBLE)) AS vec
    FROM (SELECT label AS g, vec_id, embedding, k,
                 k * CASE WHEN k = 2 AND vec_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS size
          FROM embeddings, (SELECT unnest(range(3)) AS k))),
stored AS MATERIALIZED (SELECT * FROM points WHERE vec_id % 5 = 0 AND k = 0),
asked AS MATERIALIZED (SELECT * FROM points WHERE vec_id % 5 <> 0 OR k > 0)"""


def _votes(asked: str, stored: str, category: str) -> str:
    """near -> votes -> semantic, for asked(id, vec) and stored(id, vec, ...)."""
    return f"""near AS MATERIALIZED (
    SELECT a.id, s.id AS sid, {category} AS category, round(list_distance(a.vec, s.vec) ** 2, 9) AS d
    FROM {asked} a, {stored} s
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, s.vec) ** 2, 9), s.id) <= {C.NEIGHBOURS}),
met AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS rank, 1.0::DOUBLE / (1.0::DOUBLE + d) AS w FROM near),
votes AS MATERIALIZED (
    SELECT id, category, sum(w) AS weight, sum(w) / sum(sum(w)) OVER (PARTITION BY id) AS share, CAST(min(rank) AS INT) AS first_rank
    FROM met GROUP BY id, category),
semantic AS MATERIALIZED (
    SELECT id, category AS semantic_category, share AS semantic_confidence FROM votes
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 12) DESC, first_rank) = 1)"""


VECTOR_VOTES = f"{VECTORS}, {_votes('asked', 'stored', 'CAST(s.g AS VARCHAR)')}"
oracle(
    "knn_votes", VECTOR_VOTES,
    "SELECT id, category, round(weight, 6) AS weight, round(share, 6) AS share, first_rank FROM votes",
)
oracle(
    "knn_best", VECTOR_VOTES,
    "SELECT id, semantic_category, round(semantic_confidence, 6) AS semantic_confidence FROM semantic",
)

_digits = " + ".join(
    f"(instr('0123456789abcdef', substr(md5(t), {p}, 1)) - 1) * {16 ** (6 - p)}" for p in range(1, 7)
)
EMBEDDED = f"""{SIGNALS},
first_text AS (
    SELECT fingerprint, {embedding_text('error_line', 'substr(post_content, 1, 200)', 'right(pre_content, 100)')} AS txt
    FROM once QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY failure_id, stage, line_no) = 1),
buckets AS (
    SELECT fingerprint, list_transform(list_filter(string_split(txt, ' '), lambda t: t <> ''), lambda t: ({_digits}) % 64) AS bs
    FROM first_text),
counted AS (
    SELECT fingerprint, list_transform(range(64), lambda d: len(list_filter(bs, lambda b: b = d))::DOUBLE) AS c FROM buckets),
vectors AS MATERIALIZED (
    SELECT fingerprint, list_transform(c, lambda x: (x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-10::DOUBLE))::FLOAT::DOUBLE) AS vec
    FROM counted)"""

_learned = "substr(fingerprint, 1, 1) IN ('0', '1', '2', '3')"


def _min(x: str) -> str:
    return case(((f"{x} = {text(c)}", f"{s['regex_min']}::DOUBLE") for c, s in C.CATEGORY_SETTINGS.items()), "0.5::DOUBLE")


def _prio(x: str) -> str:
    return case(((f"{x} = {text(c)}", str(s["priority"])) for c, s in C.CATEGORY_SETTINGS.items()), "999")


FUSED = f"""{EMBEDDED}, {_scored('once')},
taught AS MATERIALIZED (
    SELECT b.fingerprint AS id, b.regex_category AS category, v.vec FROM best b JOIN vectors v USING (fingerprint)
    WHERE {_learned.replace('fingerprint', 'b.fingerprint')}
    QUALIFY row_number() OVER (PARTITION BY b.fingerprint ORDER BY failure_id, stage, line_no) = 1),
known AS MATERIALIZED (SELECT * FROM taught WHERE category <> 'UNKNOWN'),
open_ones AS MATERIALIZED (SELECT fingerprint AS id, vec FROM vectors),
{_votes('open_ones', 'known', 's.category')},
both_scores AS (
    SELECT b.failure_id, b.fingerprint, b.error_line, category, sum(part) AS score, bool_or(voted) AS voted
    FROM (SELECT failure_id, fingerprint, error_line, regex_category AS category, {C.REGEX_WEIGHT}::DOUBLE * regex_confidence AS part, false AS voted
          FROM best WHERE regex_category <> 'UNKNOWN'
          UNION ALL
          SELECT failure_id, fingerprint, error_line, semantic_category, {C.SEMANTIC_WEIGHT}::DOUBLE * semantic_confidence, true
          FROM best JOIN semantic ON fingerprint = id) b
    GROUP BY ALL),
top AS (
    SELECT *, bool_or(voted) OVER (PARTITION BY failure_id, fingerprint) AS any_vote FROM both_scores
    QUALIFY row_number() OVER (PARTITION BY failure_id, fingerprint ORDER BY score DESC, {_prio('category')}) = 1),
accepted AS (
    SELECT * FROM top WHERE score >= {C.ABSOLUTE_MINIMUM}
    AND score >= {_min('category')} * CASE WHEN any_vote THEN 1.0::DOUBLE ELSE {C.REGEX_WEIGHT}::DOUBLE END),
final AS (
    SELECT b.failure_id, b.fingerprint, coalesce(a.category, {_rule('b.error_line')}) AS category,
           CASE WHEN a.category IS NOT NULL THEN least(1.0::DOUBLE, a.score)
                WHEN {_rule('b.error_line')} = 'UNKNOWN' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence
    FROM best b LEFT JOIN accepted a USING (failure_id, fingerprint))"""
oracle(
    "fused_category", FUSED,
    f"SELECT failure_id, fingerprint, category, round(confidence, 6) AS confidence, {_owner('category')} AS owner_team FROM final",
)

# --- known patterns, deduplication -----------------------------------------------------
LOOKUP = f"""{VECTORS},
found AS MATERIALIZED (
    SELECT a.id, s.id AS sid, round(list_cosine_similarity(a.vec, s.vec), 9) AS sim FROM asked a, stored s
    WHERE round(list_cosine_similarity(a.vec, s.vec), 9) >= 0.92
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, s.vec), 9) DESC, s.id) = 1)"""
oracle(
    "cache_hits", LOOKUP,
    "SELECT id, sid AS pattern_fingerprint, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sim)), 6) AS similarity_score FROM found",
)
oracle("cache_misses", LOOKUP, "SELECT id, g FROM asked WHERE id NOT IN (SELECT id FROM found)")

UNITS = f"""{VECTORS},
units AS MATERIALIZED (
    SELECT g, id, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-10::DOUBLE)) AS u FROM points)"""
CLUSTERS = f"""{UNITS},
edges AS MATERIALIZED (
    SELECT a.g, a.id AS a, b.id AS b FROM units a JOIN units b ON a.g = b.g WHERE list_distance(a.u, b.u) <= 0.1),
reach AS (SELECT g, id, id AS r FROM units UNION SELECT reach.g, reach.id, e.b FROM reach JOIN edges e ON reach.r = e.a),
labels AS (SELECT g, id, min(r) AS label FROM reach GROUP BY ALL),
members AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g, label) AS members FROM labels)"""
oracle("clusters", CLUSTERS, "SELECT g, id, label, members FROM members")
oracle(
    "medoids",
    f"""{CLUSTERS},
means AS (
    SELECT g, label, list(mean ORDER BY d) AS mean FROM (
        SELECT m.g, m.label, d, avg(u.u[d]) AS mean FROM members m JOIN units u USING (g, id), (SELECT unnest(range(1, 65)) AS d)
        WHERE m.members >= 2 GROUP BY m.g, m.label, d) GROUP BY ALL)""",
    """SELECT m.g, m.label, m.id, m.members FROM members m JOIN units u USING (g, id) JOIN means c ON m.g = c.g AND m.label = c.label
QUALIFY row_number() OVER (PARTITION BY m.g, m.label ORDER BY round(list_distance(u.u, c.mean), 9), m.id) = 1""",
)
oracle(
    "near_dup_keep",
    f"""{VECTORS},
nearby AS MATERIALIZED (
    SELECT b.g, b.id, list(a.id) AS earlier FROM points a JOIN points b ON a.g = b.g AND a.id < b.id
    WHERE round(list_cosine_similarity(a.vec, b.vec), 9) > 0.85 GROUP BY ALL),
queue AS MATERIALIZED (
    SELECT p.g, p.id, coalesce(n.earlier, []) AS earlier, row_number() OVER (PARTITION BY p.g ORDER BY p.id) AS pos
    FROM points p LEFT JOIN nearby n USING (g, id)),
walk AS (
    SELECT g, 0::BIGINT AS pos, []::BIGINT[] AS kept FROM (SELECT DISTINCT g FROM points)
    UNION ALL
    SELECT w.g, q.pos, CASE WHEN list_has_any(w.kept, q.earlier) THEN w.kept ELSE list_append(w.kept, q.id) END
    FROM walk w JOIN queue q ON w.g = q.g AND q.pos = w.pos + 1)""",
    "SELECT g, unnest(kept) AS id FROM walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY pos DESC) = 1",
)
oracle(
    "knowledge_upsert",
    """every AS (
    SELECT 'fp' || c_custkey AS fingerprint, c_mktsegment AS root_cause, 'MEDIUM' AS severity, 4 AS recurrence_count, [c_acctbal, c_custkey % 7] AS embedding,
           c_acctbal AS rca_confidence, c_name AS remediation, -1 AS nr FROM customer
    UNION ALL
    SELECT 'fp' || user_id, event_type, CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END, 0, [value, event_id % 7], value, props, event_id FROM events)""",
    """SELECT fingerprint, arg_min(root_cause, nr) AS root_cause, arg_min(severity, nr) AS severity,
       CAST(arg_min(recurrence_count, nr) + count(*) - 1 AS INT) AS recurrence_count, array_to_string(list_transform(arg_min(embedding, nr), lambda x: CAST(CAST(x AS DECIMAL(18, 4)) AS VARCHAR)), ' ') AS embedding,
       arg_max(rca_confidence, nr) AS rca_confidence, arg_max(remediation, nr) AS remediation,
       CAST(NULL AS VARCHAR) AS secondary_remediations FROM every GROUP BY fingerprint""",
)
LEARNABLE = f"""{BY_PATTERNS},
seen AS (SELECT DISTINCT fp FROM (SELECT sha256({normalized('clean')}) AS fp FROM facts) WHERE substr(fp, 1, 1) = '0'),
fresh AS MATERIALIZED (
    SELECT fingerprint, failure_id, stage, line_no, regex_category AS category FROM best
    WHERE regex_category <> 'UNKNOWN' AND regex_confidence > {C.LEARN_ABOVE} AND fingerprint NOT IN (SELECT fp FROM seen)
    QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY failure_id, stage, line_no) = 1)"""
oracle("learned_antijoin", LEARNABLE, "SELECT * FROM fresh")
oracle(
    "feedback_batch", LEARNABLE,
    f"""SELECT fingerprint, category,
       row_number() OVER (ORDER BY fingerprint) <= count(*) OVER () // {C.FEEDBACK_BATCH} * {C.FEEDBACK_BATCH} AS learned FROM fresh""",
)

# --- CI runs and failure records -------------------------------------------------------
STEPS = """steps AS (
    SELECT l_orderkey AS run, l_returnflag AS stage, l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS pos,
           'step ' || l_partkey || chr(10) || 'supplier ' || l_suppkey || chr(10) AS log FROM lineitem)"""
oracle("stage_assembly", STEPS, "SELECT run, stage, string_agg(log, '' ORDER BY pos, log) AS content FROM steps GROUP BY ALL")
oracle(
    "stage_lines", STEPS,
    """SELECT failure_id, stage, row_number() OVER (PARTITION BY failure_id, stage ORDER BY nr, i) - 1 AS line_no, raw
FROM (SELECT run AS failure_id, stage, nr, i, string_split(log, chr(10))[i] AS raw
      FROM (SELECT *, row_number() OVER (PARTITION BY run, stage ORDER BY pos, log) AS nr FROM steps), (SELECT unnest([1, 2]) AS i))""",
)
JOBS = f"""jobs AS (
    SELECT o_orderkey AS run, o_orderstatus AS stage,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'failure' WHEN '2-HIGH' THEN 'success' WHEN '3-MEDIUM' THEN 'Timed_Out'
                WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN 'neutral' ELSE 'cancelled' END END AS conclusion FROM orders),
named AS (SELECT *, CASE WHEN conclusion IS NULL THEN 'NOT_BUILT' ELSE {case(((f"lower(conclusion) = {text(k)}", text(v)) for k, v in ci_runs.CONCLUSIONS.items()), "'UNSTABLE'")} END AS result FROM jobs)"""
oracle("status_map", JOBS, "SELECT conclusion, result, count(*) AS n FROM named GROUP BY ALL")
oracle("failed_stages", JOBS, "SELECT run, stage, result FROM named WHERE result NOT IN ('SUCCESS', 'NOT_BUILT')")
PAYLOADS = """payloads AS (
    SELECT o_orderkey AS intake_no, 'c' || (o_custkey % 50) AS commit, o_orderstatus AS branch,
           CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 7 <> 0 THEN 'job-' || o_orderpriority END AS job_name,
           CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 4 END AS build_number,
           CASE WHEN o_orderkey % 2 = 0 THEN 'team' END AS owner,
           CASE WHEN o_orderkey % 2 = 0 THEN 'repo-' || substr(o_orderpriority, 1, 1) END AS repo,
           CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN o_orderkey END AS run_id FROM orders),
routed AS (
    SELECT *, CASE WHEN owner IS NOT NULL THEN 'github' ELSE 'jenkins' END AS platform,
           coalesce(nullif(run_id, 0), build_number) AS effective_run FROM payloads),
checked AS (
    SELECT *, CASE WHEN platform = 'github' AND coalesce(effective_run, 0) = 0 THEN 'run_id missing'
                   WHEN platform = 'jenkins' AND job_name IS NULL THEN 'platform unknown'
                   WHEN platform = 'jenkins' AND coalesce(build_number, 0) = 0 THEN 'build_number missing' END AS reject_reason FROM routed)"""
oracle(
    "platform_of", PAYLOADS,
    "SELECT intake_no, platform, effective_run, reject_reason, coalesce(job_name, repo) AS job, coalesce(nullif(build_number, 0), run_id) AS build FROM checked",
)
oracle(
    "intake_dedup", PAYLOADS,
    """SELECT platform, commit, branch, job_name, build_number, intake_no, reject_reason FROM checked a
WHERE NOT EXISTS (
    SELECT 1 FROM checked b WHERE b.platform = a.platform AND b.commit = a.commit AND b.branch = a.branch
    AND b.job_name = a.job_name AND b.build_number = a.build_number AND b.intake_no < a.intake_no)""",
)
oracle(
    "latest_run", "newest AS (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)",
    "SELECT o_orderkey AS run, o_orderstatus AS branch, o_orderpriority AS commit FROM newest WHERE starts_with(o_orderpriority, '1-U')",
)
LANDED = """landed AS (
    SELECT event_id, CASE WHEN event_id % 13 = 5 THEN left(whole, 20) ELSE whole END AS value FROM (
        SELECT event_id, '{"job_name":"job-' || event_type || '","build_number":' || user_id || ',"branch":null,"extra":' || props
               || ',"tags":["a","' || event_type || '"]}' AS whole FROM events)),
readable AS MATERIALIZED (SELECT event_id, CASE WHEN json_valid(value) THEN value END AS doc FROM landed)"""
_paths = {"job": "$.job_name", "build": "$.build_number", "branch": "$.branch", "k": "$.extra.k", "tag": "$.tags[1]", "none": "$.x.y"}
oracle(
    "payload_paths", LANDED,
    " UNION ALL ".join(f"SELECT event_id, {text(n)} AS name, json_extract_string(doc, {text(p)}) AS value FROM readable" for n, p in _paths.items()),
)
oracle(
    "payload_matches", LANDED,
    """SELECT event_id, doc->>'$.job_name' AS job_name, CAST(doc->>'$.build_number' AS BIGINT) AS build_number FROM readable
WHERE doc->>'$.tags[1]' = 'error' AND doc->>'$.extra.k' = '7'""",
)
oracle(
    "find_duplicate", PAYLOADS,
    """SELECT intake_no AS failure_id, platform, commit, branch, intake_no % 24 AS created_at FROM checked
WHERE platform = 'jenkins' AND commit = 'c7' AND branch = 'O' AND job_name = 'job-5-LOW' AND build_number = 1
ORDER BY intake_no % 24, CAST(intake_no AS BIGINT) LIMIT 1""",
)
oracle("record_by_id", PAYLOADS, "SELECT intake_no AS failure_id, platform, commit, branch FROM checked WHERE intake_no = 33")
STATUS = f"""moves AS (
    SELECT 'run-' || o_custkey AS failure_id, o_orderkey % 6 AS s, o_orderdate AS ts FROM orders),
latest AS (
    SELECT failure_id, [{', '.join(map(text, failures.STATES))}][arg_max(s, (ts, s)) + 1] AS status, count(*) AS events FROM moves GROUP BY 1)"""
oracle("status_current", STATUS, "SELECT failure_id, status, events FROM latest")
oracle(
    "status_gate", STATUS,
    f"""SELECT * FROM (SELECT failure_id, {case((f"status IN ({', '.join(map(text, v))})", text(k)) for k, v in failures.GATES.items())} AS step FROM latest)
WHERE step IS NOT NULL""",
)

# --- root causes and reports ---------------------------------------------------------------
STORED = """raw_rows AS (
    SELECT *, (l_orderkey * 3 + l_linenumber) % 12 AS kind FROM lineitem),
docs AS MATERIALIZED (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, CASE WHEN l_suppkey % 17 <> 0 THEN l_discount * 5 END AS rca_confidence,
           l_partkey % 19 <> 0 AS has_cause, l_orderkey % 23 <> 0 AS has_line, l_partkey % 9 - 1 AS recurrence_count,
           CASE WHEN l_partkey % 3 = 0 THEN l_quantity / 40.0::DOUBLE END AS similarity_score, l_orderkey % 4 = 0 AS bad_secondary,
           CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'WORST' ELSE 'MEDIUM' END AS severity,
           coalesce(CASE WHEN kind IN (0, 1, 2) THEN 'FIX_DEV' WHEN kind IN (3, 4, 5) THEN 'FIX_TEST'
                         WHEN kind IN (6, 7, 11) THEN 'FIX_CI_INFRA' WHEN kind IN (8, 9) THEN 'MANUAL_INVESTIGATION' END) AS action,
           CASE kind WHEN 0 THEN 'CLEAN_REBUILD' WHEN 1 THEN 'FIX_CODE_QUALITY' WHEN 2 THEN 'GENERATE_CODE_PATCH'
                     WHEN 3 THEN 'SKIP_TEST_TEMPORARILY' WHEN 4 THEN 'MARK_FLAKY_RETRY' WHEN 5 THEN 'FIX_ASSERTION'
                     WHEN 6 THEN 'RESTART_RESOURCE' WHEN 7 THEN 'UPDATE_SECRET' WHEN 11 THEN 'RESTART_RESOURCE' END AS strategy,
           CASE kind WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'x' WHEN 2 THEN 'a.c' WHEN 3 THEN 't' WHEN 4 THEN 't' WHEN 5 THEN 't'
                     WHEN 6 THEN 'pod' WHEN 7 THEN 'key' END AS target,
           CASE WHEN kind = 8 THEN 'needs a look' END AS reason,
           CASE WHEN kind IN (0, 4) THEN l_linenumber WHEN kind = 5 THEN 3 END AS retry_count
    FROM raw_rows)"""
_keys = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
oracle(
    "remediation_decode", STORED,
    f"""SELECT {_keys}, action, CASE WHEN action IS NOT NULL THEN strategy END AS strategy, target, reason,
       CASE WHEN action IS NOT NULL THEN retry_count END AS retry_count FROM docs""",
)
_gaps = {
    0: "fix_commands,related_files", 1: "fix_commands,related_files", 2: "related_files", 3: "fix_commands,skip_reason",
    4: "fix_commands", 5: "fix_commands", 6: "fix_commands,requires_human_approval",
    7: "estimated_recovery_time_seconds,fix_commands", 8: "escalation_team,investigation_links,priority,suggested_next_step",
    9: "escalation_team,investigation_links,reason,suggested_next_step", 10: "",
    11: "estimated_recovery_time_seconds,fix_commands,requires_human_approval,target",
}
oracle("contract_gaps", STORED, f"SELECT {_keys}, {case((f'kind = {k}', text(v)) for k, v in _gaps.items())} AS gaps FROM docs")
_broken = [
    ("strategy", "kind = 1"), ("target", "kind = 11"), ("patch_confidence", "kind = 2"),
    ("retry_count", "kind = 4 AND l_linenumber NOT BETWEEN 1 AND 5"), ("recovery_time", "kind = 6"),
    ("reason", "kind = 9"), ("priority", "kind = 9"), ("severity", "severity = 'WORST'"),
    ("rca_confidence", "rca_confidence IS NULL OR rca_confidence < 0 OR rca_confidence > 1"),
    ("manual_expected", "rca_confidence < 0.3 AND action <> 'MANUAL_INVESTIGATION'"),
    ("root_cause", "NOT has_cause"), ("error_line", "NOT has_line"), ("recurrence_count", "recurrence_count < 0"),
    ("similarity_score", "similarity_score < 0 OR similarity_score > 1"), ("secondary_remediations", "bad_secondary"),
]
_broken = [("remediation", "action IS NULL"), *((n, c.replace("kind = 11", "kind = 11 AND action IS NOT NULL")) for n, c in _broken)]
oracle(
    "remediation_valid", STORED + f""",
judged AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN {text(n)} END" for n, c in _broken)}) AS errors FROM docs)""",
    f"""SELECT {_keys}, severity, errors = '' AS valid, errors, CASE WHEN kind = 2 THEN 'p' END AS suggested_patch,
       CASE WHEN kind = 4 THEN l_linenumber END AS retry_count, CASE WHEN kind = 3 THEN {text(rca.DEFAULT_SKIP_REASON)} END AS skip_reason,
       CASE kind WHEN 8 THEN 'MEDIUM' WHEN 9 THEN 'URGENT' END AS priority FROM judged""",
)


def _map(x: str, table: dict) -> str:
    return case((f"{x} = {text(k)}", text(v)) for k, v in table.items())


_action = _map("regex_category", rca.ACTIONS)
_cut = lambda c, x: f"CASE WHEN length({c}) > 0 THEN {x} ELSE '(none)' END"
oracle(
    "rca_requests", BY_PATTERNS + f""",
parts AS (
    SELECT failure_id, fingerprint, stage, regex_category, {_action} AS action, {_cut('error_line', 'substr(error_line, 1, 400)')} AS error_line,
       {_cut('pre_content', 'right(pre_content, 150)')} AS before, {_cut('post_content', 'substr(post_content, 1, 250)')} AS after,
       {_map(_action, {a: ', '.join(s) or 'N/A' for a, s in rca.OFFERED_STRATEGIES.items()})} AS strategies,
       {_map(_action, {
           "FIX_DEV": "target, related_files; CLEAN_REBUILD: fix_commands; RESOLVE_DEPENDENCY: related_files, fix_commands; "
           "UPGRADE_DEPENDENCY: fix_commands; GENERATE_CODE_PATCH: suggested_patch, patch_confidence; APPLY_LINT_FIX: fix_commands; "
           "FIX_CODE_QUALITY: fix_commands; REVERT_COMMIT: fix_commands",
           "FIX_TEST": "target, fix_commands; MARK_FLAKY_RETRY: retry_count; SKIP_TEST_TEMPORARILY: skip_reason",
           "FIX_CI_INFRA": "target, estimated_recovery_time_seconds, requires_human_approval, fix_commands; "
           "requires_human_approval is true for ROTATE_CREDENTIALS, UPDATE_SECRET, FIX_NETWORK_POLICY",
           "MANUAL_INVESTIGATION": "reason, suggested_next_step, escalation_team, priority, investigation_links",
       })} AS required FROM best)""",
    """SELECT failure_id, fingerprint, action, error_line, before, after, strategies, required,
       'Find the root cause of this CI failure and one remediation that can be carried out as given.' || chr(10) || 'Action: ' || action
       || chr(10) || 'Strategy, one of: ' || strategies || chr(10) || 'Required fields: ' || required || chr(10) || 'Stage: ' || stage
       || chr(10) || 'Category: ' || regex_category || chr(10) || 'Error line:' || chr(10) || error_line || chr(10) || 'Before:'
       || chr(10) || before || chr(10) || 'After:' || chr(10) || after AS request FROM parts""",
)
_manual = f"({_action} = 'MANUAL_INVESTIGATION' OR regex_confidence < 0.3)"
oracle(
    "rca_enriched", BY_PATTERNS,
    f"""SELECT failure_id, fingerprint, regex_category AS validated_category, {_owner('regex_category')} AS owner,
       regex_category || ' in stage ' || stage || ': ' || {_cut('error_line', 'substr(error_line, 1, 400)')} AS root_cause,
       CASE WHEN regex_category = 'CI_INFRA_FAILURE' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, '2024-01-01T00:00:00Z' AS analyzed_at,
       CASE WHEN {_manual} THEN 'MANUAL_INVESTIGATION' ELSE {_action} END AS action,
       CASE WHEN NOT {_manual} THEN {_map(_action, {a: next(s for s in rca.OFFERED_STRATEGIES[a] if s in v) for a, v in rca.VALID_STRATEGIES.items()})} END AS strategy,
       true AS valid FROM best""",
)
_section = case(((f"owner = {text(o)}", str(i)) for i, o in enumerate(report.SECTIONS, 1)), "9")
CAUSES = f"""causes AS MATERIALIZED (
    SELECT o_custkey AS failure_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'DEVOPS_ENGINEERS' WHEN '2-HIGH' THEN 'DEVELOPERS'
               WHEN '3-MEDIUM' THEN 'TEST_ENGINEERS' WHEN '4-NOT SPECIFIED' THEN 'DEVELOPERS' ELSE 'UNOWNED' END AS owner,
           o_orderstatus AS validated_category, 'cause ' || o_orderkey AS root_cause, 'error ' || o_orderkey AS error_line,
           CASE WHEN o_orderstatus = 'F' THEN 'CRITICAL' ELSE 'LOW' END AS severity,
           (o_orderkey % 21) / 20.0::DOUBLE AS rca_confidence, CAST(o_orderkey % 7 AS INT) AS recurrence_count,
           CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9) / 8.0::DOUBLE END AS similarity_score,
           sha256(CAST(o_orderkey AS VARCHAR)) AS fp, o_orderkey AS sequence FROM orders)"""
_band = lambda c: f"CASE WHEN {c} >= 0.80 THEN 'High' WHEN {c} >= 0.50 THEN 'Medium' ELSE 'Low' END"
oracle(
    "report_summary", CAUSES,
    f"""SELECT failure_id, count(*) AS total, count(*) FILTER (owner = 'DEVOPS_ENGINEERS') AS devops,
       count(*) FILTER (owner = 'DEVELOPERS') AS developers, count(*) FILTER (severity = 'CRITICAL') AS critical,
       round(avg(rca_confidence), 6) AS avg_confidence, CAST(round_even(avg(rca_confidence) * 100, 0) AS INT) AS avg_percent,
       {_band('avg(rca_confidence)')} AS avg_band FROM causes GROUP BY failure_id""",
)
oracle(
    "report_rows", CAUSES,
    f"""SELECT failure_id, row_number() OVER (PARTITION BY failure_id ORDER BY {_section}, sequence) AS number, owner, validated_category,
       root_cause, error_line, severity, rca_confidence, {_band('rca_confidence')} AS confidence_band,
       CAST(trunc(rca_confidence * 100) AS INT) AS confidence_percent,
       CASE WHEN recurrence_count >= 5 THEN '5+' WHEN recurrence_count >= 2 THEN '2+' WHEN recurrence_count > 0 THEN '1' END AS recurrence_band,
       CAST(trunc(similarity_score * 100) AS INT) AS match_percent, substr(fp, 1, 16) || '...' AS fingerprint FROM causes""",
)
oracle("owner_counts", CAUSES, "SELECT failure_id, owner, count(*) AS rows FROM causes GROUP BY ALL")
oracle(
    "recipients", CAUSES + """,
mail AS (
    SELECT c_custkey AS failure_id, CASE WHEN c_custkey % 2 = 0 THEN 'ci-' || c_custkey || '@x' END AS ci,
           CASE WHEN c_custkey % 3 = 0 THEN 'dev-' || c_custkey || '@x' END AS dev,
           CASE WHEN c_custkey % 5 = 0 THEN 'test-' || c_custkey || '@x' END AS test FROM customer),
sent AS (
    SELECT DISTINCT m.failure_id, CASE owner WHEN 'DEVOPS_ENGINEERS' THEN ci WHEN 'DEVELOPERS' THEN dev WHEN 'TEST_ENGINEERS' THEN test END AS a
    FROM mail m LEFT JOIN causes c USING (failure_id))""",
    "SELECT failure_id, coalesce(string_agg(a, ',' ORDER BY a), 'ci@x') AS recipients FROM sent GROUP BY failure_id",
)
DEDUPED = f"""{EMBEDDED},
points AS MATERIALIZED (
    SELECT o.failure_id AS g, o.stage || chr(1) || lpad(CAST(o.line_no AS VARCHAR), 19, '0') AS id, v.vec, o.stage, o.line_no, o.fingerprint
    FROM once o JOIN vectors v USING (fingerprint)),
{CLUSTERS.split("{VECTORS},")[-1].removeprefix(VECTORS + ",")},
means AS (
    SELECT g, label, list(mean ORDER BY d) AS mean FROM (
        SELECT m.g, m.label, d, avg(u.u[d]) AS mean FROM members m JOIN units u USING (g, id), (SELECT unnest(range(1, 65)) AS d)
        WHERE m.members >= 2 GROUP BY m.g, m.label, d) GROUP BY ALL),
middle AS (
    SELECT m.g, m.id FROM members m JOIN units u USING (g, id) JOIN means c ON m.g = c.g AND m.label = c.label
    QUALIFY row_number() OVER (PARTITION BY m.g, m.label ORDER BY round(list_distance(u.u, c.mean), 9), m.id) = 1),
lone AS MATERIALIZED (SELECT u.g, u.id, u.u AS vec FROM members m JOIN units u USING (g, id) WHERE m.members = 1),
nearby AS MATERIALIZED (
    SELECT b.g, b.id, list(a.id) AS earlier FROM lone a JOIN lone b ON a.g = b.g AND a.id < b.id
    WHERE round(list_cosine_similarity(a.vec, b.vec), 9) > 0.85 GROUP BY ALL),
queue AS MATERIALIZED (
    SELECT p.g, p.id, coalesce(n.earlier, []) AS earlier, row_number() OVER (PARTITION BY p.g ORDER BY p.id) AS pos
    FROM lone p LEFT JOIN nearby n USING (g, id)),
walk AS (
    SELECT g, 0::BIGINT AS pos, []::VARCHAR[] AS kept FROM (SELECT DISTINCT g FROM lone)
    UNION ALL
    SELECT w.g, q.pos, CASE WHEN list_has_any(w.kept, q.earlier) THEN w.kept ELSE list_append(w.kept, q.id) END
    FROM walk w JOIN queue q ON w.g = q.g AND q.pos = w.pos + 1),
stays AS (
    SELECT g, id, 'cluster' AS kind FROM middle
    UNION ALL
    SELECT g, unnest(kept), 'noise' FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY pos DESC) = 1)),
deduped AS MATERIALIZED (SELECT p.g AS failure_id, p.stage, p.line_no, p.fingerprint, s.kind FROM stays s JOIN points p USING (g, id))"""
oracle("signal_dedup", DEDUPED, "SELECT failure_id, stage, line_no, fingerprint, kind FROM deduped")
oracle(
    "stage_counters", DEDUPED + """,
hit AS (
    SELECT DISTINCT a.fingerprint FROM vectors a, vectors b
    WHERE substr(b.fingerprint, 1, 1) = '0' AND round(list_cosine_similarity(a.vec, b.vec), 9) >= 0.92),
kept_counts AS (
    SELECT failure_id, count(*) AS kept, count(*) FILTER (kind = 'cluster') AS clusters, count(*) FILTER (kind = 'noise') AS noise_kept,
           count(*) FILTER (fingerprint IN (SELECT fingerprint FROM hit)) AS cache_hits FROM deduped GROUP BY 1),
sig_counts AS (SELECT failure_id, count(*) AS signals FROM signals GROUP BY 1)""",
    """SELECT f.failure_id, coalesce(signals, 0) AS signals, coalesce(kept, 0) AS kept, coalesce(clusters, 0) AS clusters,
       coalesce(noise_kept, 0) AS noise_kept, coalesce(cache_hits, 0) AS cache_hits, coalesce(kept, 0) - coalesce(cache_hits, 0) AS to_classify,
       coalesce(kept, 0) = 0 AS no_signals
FROM (SELECT DISTINCT failure_id FROM lines) f LEFT JOIN sig_counts USING (failure_id) LEFT JOIN kept_counts USING (failure_id)""",
)
oracle("training_samples", LEARNABLE, "SELECT category, count(*) AS samples FROM fresh GROUP BY 1")

USER_WORDS = ["refused", "failed", "no space", "timeout", "permission denied", "panic", "manifest", "credentials"]
_categories = "[" + ", ".join(text(c) for c in C.CATEGORY_PATTERNS) + "]"
_hit = lambda f: f"regexp_matches({f}, '(?i-s)' || word)"
oracle(
    "catalogue_scores", SIGNALS + f""",
words AS (
    SELECT DISTINCT event_type AS word FROM events UNION ALL SELECT DISTINCT lower(c_mktsegment) FROM customer
    UNION ALL SELECT unnest([{', '.join(map(text, USER_WORDS))}])),
hits AS (
    SELECT failure_id, fingerprint, {_categories}[length(word) % {len(C.CATEGORY_PATTERNS)} + 1] AS category,
           {' + '.join(f"CASE WHEN {_hit(f)} THEN {w} ELSE 0 END" for f, w in C.FIELD_WEIGHTS.items())} AS points FROM once, words),
summed AS (
    SELECT failure_id, fingerprint, category, CAST(sum(points) AS INT) AS score, CAST(count(*) FILTER (points > 0) AS INT) AS matches
    FROM hits GROUP BY ALL HAVING sum(points) > 0)""",
    f"""SELECT failure_id, fingerprint, category, score, matches, round({_confidence('score', 'matches')}, 6) AS confidence,
       {_prio('category')} AS priority, {_min('category')} AS threshold FROM summed""",
)
_rules = "\n".join(
    f"{i}. {category} if the evidence has one of: {', '.join(words)}" for i, (category, words) in enumerate(C.KEYWORD_RULES.items(), 1)
)
_request = (
    "Assign the CI failure below to a category. Apply the first rule that fits, from explicit evidence only.\n"
    f"{_rules}\n4. UNKNOWN otherwise\n"
)
oracle(
    "classification_requests", BY_PATTERNS,
    f"""SELECT failure_id, fingerprint, concat({text(_request)}, 'Stage: ', stage, chr(10), 'Error line: ', error_line, chr(10), 'Before: ', pre_content,
       chr(10), 'After: ', post_content, chr(10), 'Now: UNKNOWN 0.0', chr(10),
       'Answer as JSON with best_category and classified_confidence (0 to 1).') AS request FROM best WHERE regex_category = 'UNKNOWN'""",
)
JUDGED = f"""{DEDUPED}, {_scored('once')},
judged AS (
    SELECT b.failure_id, b.fingerprint, b.error_line, regex_category AS rc, {C.REGEX_WEIGHT}::DOUBLE * regex_confidence AS rs
    FROM best b JOIN deduped USING (failure_id, fingerprint)),
settled AS (
    SELECT failure_id, fingerprint,
           rc <> 'UNKNOWN' AND rs >= {C.ABSOLUTE_MINIMUM} AND rs >= {_min('rc')} * {C.REGEX_WEIGHT}::DOUBLE AS sure, rc, rs, {_rule('error_line')} AS by_rule
    FROM judged),
causes AS MATERIALIZED (
    SELECT failure_id, fingerprint, CASE WHEN sure THEN rc ELSE by_rule END AS category,
           CASE WHEN sure THEN least(1.0::DOUBLE, rs) WHEN by_rule = 'UNKNOWN' THEN 0.0 ELSE 0.5 END::DOUBLE AS rca_confidence FROM settled)"""
oracle(
    "analyze_summary", JUDGED,
    f"""SELECT failure_id, count(*) AS total, count(*) FILTER ({_owner('category')} = 'DEVOPS_ENGINEERS') AS devops,
       count(*) FILTER ({_owner('category')} = 'DEVELOPERS') AS developers, 0::BIGINT AS critical,
       round(avg(rca_confidence), 6) AS avg_confidence, CAST(round_even(avg(rca_confidence) * 100, 0) AS INT) AS avg_percent,
       {_band('avg(rca_confidence)')} AS avg_band FROM causes GROUP BY failure_id""",
)


def _drawn_samples() -> list[tuple[int, str, str, str, str]]:
    """The training set by a plain loop: words are put in one after the other."""
    out = []
    every = [(c, t) for c, templates in T.TEMPLATES.items() for t in templates]
    for number, (category, parts) in enumerate(every):
        for i in range(T.SAMPLES_PER_TEMPLATE):
            filled = []
            for field, form in zip(("error_line", "post_content"), parts):
                for key, words in T.WORDS.items():
                    pieces = form.split("{" + key + "}")
                    form = pieces[0]
                    for at, piece in enumerate(pieces[1:], 1):
                        digest = hashlib.md5(f"{T.SEED}/{field}/{number}/{i}/{key}/{at}".encode()).hexdigest()
                        form += words[int(digest[:6], 16) % len(words)] + piece
                filled.append(form)
            out.append((number * T.SAMPLES_PER_TEMPLATE + i, category, T.STAGE_OF[category], *filled))
    return out


_values = ", ".join(f"({i}, {text(c)}, {text(e)}, {text(p)})" for i, c, _, e, p in _drawn_samples())
oracle(
    "template_votes", f"""{EMBEDDED},
drawn (id, category, error_line, post_content) AS (VALUES {_values}),
drawn_texts AS (SELECT id, category, {embedding_text('error_line', 'substr(post_content, 1, 200)', "''")} AS txt FROM drawn),
drawn_buckets AS (
    SELECT id, category, list_transform(list_filter(string_split(txt, ' '), lambda t: t <> ''), lambda t: ({_digits}) % 64) AS bs FROM drawn_texts),
drawn_counts AS (SELECT id, category, list_transform(range(64), lambda d: len(list_filter(bs, lambda b: b = d))::DOUBLE) AS c FROM drawn_buckets),
samples AS MATERIALIZED (
    SELECT id, category, list_transform(c, lambda x: (x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-10::DOUBLE))::FLOAT::DOUBLE) AS vec
    FROM drawn_counts),
open_ones AS MATERIALIZED (SELECT fingerprint AS id, vec FROM vectors),
{_votes('open_ones', 'samples', 's.category')}""",
    "SELECT id, category, round(share, 6) AS share FROM votes",
)
