"""Text functions of the log pipeline, as Column -> Column expressions.

All of them stay inside the JVM: literal patterns (compiled once per task),
no Python functions, no joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import signal_rules as R

# ASCII characters that a strip removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def one_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """True where the pattern is found; `.` and `$` know `\\n` as the only line end."""
    return c.rlike(("(?id)" if ignore_case else "(?d)") + pattern)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda acc, w: acc | c.contains(w), words[1:], c.contains(words[0]))


def ascii_only(raw: Column) -> Column:
    stripped = F.regexp_replace(raw, r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(raw) == F.char_length(raw), raw).otherwise(stripped)


def remove_timestamp(line: Column) -> Column:
    """Lower-case, strip, and delete timestamps wherever they stand."""
    lowered = strip(F.lower(line))
    without = strip(F.regexp_replace(lowered, "(?i)" + R.TIMESTAMP, ""))
    return F.when(lowered.contains(":"), without).otherwise(lowered)


def _json_text(doc: Column) -> Column:
    """First usable message field of a parsed document, NULL if there is none.

    Empty strings, zero, false, null and empty containers count as absent.
    """

    def field(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
        text = F.try_variant_get(doc, f"$.{key}", "string")
        number = F.try_variant_get(doc, f"$.{key}", "double")
        return (
            F.when(kind == "STRING", F.nullif(text, F.lit("")))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"),
                  F.when(~text.isin("[]", "{}"), text))
            .when(kind != "VOID", F.when(number != 0, text))
        )

    return F.coalesce(*[field(k) for k in R.JSON_MESSAGE_KEYS])


def json_message(line: Column) -> Column:
    """The message of a JSON log line; any other line unchanged."""
    stripped = strip(line)
    # The one-element transform parses each document once for all its fields.
    parsed = F.transform(F.array(F.try_parse_json(stripped)), _json_text)[0]
    looks_json = stripped.startswith("{") & stripped.endswith("}")
    return F.when(looks_json, F.coalesce(parsed, line)).otherwise(line)


def clean_line(ascii_line: Column) -> Column:
    """The text a line is judged by outside of a block."""
    return remove_timestamp(json_message(ascii_line))


def is_noise(ascii_line: Column) -> Column:
    suspect = contains_any(F.lower(ascii_line), R.NOISE_WORDS)
    return suspect & matches(ascii_line, one_of(R.NOISE_LINES), ignore_case=False)


def is_informational(line: Column) -> Column:
    """Optional pre-filter; not part of the default pipeline."""
    return matches(line, R.INFORMATIONAL_LINE)


def _found(c: Column, pattern: str, words: list[str]) -> Column:
    """`matches`, where a match of the pattern holds one of the words: most lines cost substring searches only."""
    return contains_any(c, words) & matches(c, pattern)


def signal_type(clean: Column) -> Column:
    """Signal type of a clean line by priority, NULL if none applies."""
    def one(kind: str) -> Column:
        tests = [_found(clean, p, w) for p, w in zip(R.SIGNAL_TYPES[kind], R.SIGNAL_TYPE_WORDS[kind], strict=True)]
        return reduce(lambda a, b: a | b, tests)

    return reduce(lambda acc, kind: acc.when(one(kind), kind), R.SIGNAL_TYPES, F)


def block_trigger(clean: Column) -> Column:
    """Type of the multi-line block that a clean line opens, NULL if none."""
    return reduce(
        lambda acc, kv: acc.when(_found(clean, kv[1], R.BLOCK_TRIGGER_WORDS[kv[0]]), kv[0]), R.BLOCK_TRIGGERS.items(), F
    )


def kinds(clean: Column) -> Column:
    """struct(block_type, signal_type) of a clean line.

    The one-element transform keeps the many tests out of the generated method of the scan, which the JVM would not compile
    beyond 8,000 bytes.
    """
    def both(c: Column) -> Column:
        return F.struct(block_trigger(c).alias("block_type"), signal_type(c).alias("signal_type"))

    return F.transform(F.array(clean), both)[0]


def suspect(clean: Column) -> Column:
    """False for the many lines that surely are no signal and open no block."""
    return contains_any(clean, R.SIGNAL_WORDS)


def may_signal(clean: Column) -> Column:
    """Whether a clean line is a signal or opens a block."""
    return suspect(clean) & (block_trigger(clean).isNotNull() | signal_type(clean).isNotNull())


def may_continue(line: Column, keep_blank: bool = False) -> Column:
    """Whether a line continues some block; keep_blank stands for "indent" mode."""
    anything = matches(line, one_of(list(R.BLOCK_CONTINUATIONS.values())))
    if keep_blank:
        return anything | (strip(line) == "")
    suspect = contains_any(line, R.CONTINUATION_WORDS) | line.startswith("at")
    return suspect & anything


def continuation_mask(line: Column, keep_blank: bool = False) -> Column:
    """Bit t is set where the line continues a block of the t-th type."""
    mask = F.lit(0)
    for bit, (block, pattern) in enumerate(R.BLOCK_CONTINUATIONS.items()):
        hit = matches(line, pattern)
        if keep_blank and block in ("go_panic", "gradle_failure"):
            hit = hit | (strip(line) == "")
        mask = mask + F.when(hit, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def normalize_error_line(line: Column) -> Column:
    """Text that two occurrences of the same error share."""
    lowered = F.lower(F.coalesce(line, F.lit("")))
    rewrites = list(R.FINGERPRINT_REWRITES)
    # Each of the first four needs one of these.
    special = contains_any(lowered, ["\x1b", "[", ":\\", "/"])
    out = lowered
    for pattern, replacement in rewrites[:4]:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.when(special, out).otherwise(lowered)
    for pattern, replacement in rewrites[4:-2]:
        out = F.regexp_replace(out, pattern, replacement)
    # The last two in one: other signs become blanks, and blanks in a row one.
    return strip(F.regexp_replace(out, r"[^\w<>]+", " "))


def fingerprint(line: Column) -> Column:
    return F.sha2(normalize_error_line(line), 256)


def normalize_for_embedding(text: Column) -> Column:
    """Text with the volatile parts replaced by place-holders."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement, ignore_case in R.EMBEDDING_REWRITES:
        out = F.regexp_replace(out, ("(?id)" if ignore_case else "(?d)") + pattern, replacement)
    return strip(F.regexp_replace(F.lower(out), r"\s+", " "))


def _embedding_text(error_line: Column, post: Column, pre: Column) -> Column:
    def part(c: Column) -> Column:
        # An empty field adds nothing; a field that normalises to nothing adds a blank.
        return F.when(F.length(c) > 0, normalize_for_embedding(c))

    return F.concat_ws(" ", part(error_line), part(post), part(pre))


def dedup_text(error_line: Column, pre: Column, post: Column) -> Column:
    """Text embedded for deduplication: the end of the lines before counts."""
    return _embedding_text(error_line, F.substring(post, 1, 200), F.right(pre, F.lit(100)))


def training_text(error_line: Column, pre: Column, post: Column) -> Column:
    """Text embedded for training: the beginning of the lines before counts."""
    return _embedding_text(error_line, F.substring(post, 1, 200), F.substring(pre, 1, 100))


def sanitize_stage(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), r"[^a-zA-Z0-9._-]", "_")


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
