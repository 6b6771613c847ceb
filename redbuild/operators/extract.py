"""Error signals from log lines: greedy scan, blocks and context as dataflow.

A file is scanned from the top: an event takes its own line (or block of
lines), the lines after it, and one gap line; the scan goes on behind these.
Written as data, each candidate line `i` has a resume point `next(i)` that
depends on nothing before it, and the kept events are the greedy chain
`i_0, first candidate >= next(i_0), ...`.

One file may be a third of all lines, so nothing here works on a whole file:

* lines are cut into chunks of `chunk_lines`; windows and arrays stay inside
  (file, chunk);
* the scan can enter a chunk at `post_context + 2` offsets from its first line
  or behind a block that crosses its start (one per block type).  Each chunk
  computes its exit for every one of these entries, in parallel;
* an entry is one of 31 states, so a chunk is a function from states to states.
  Functions of neighbours are composed in a tree: `fan_in` chunks make a node,
  `fan_in` nodes the next one, up to one row per file; the true states are then
  handed down the same tree.  No task sees more than `fan_in` rows of a file;
* each chunk replays its candidates from its true entry.

Line numbers are contiguous inside a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal_rules as R
from ..functions import text as X
from .fence import fence
from .neighbours import rewritten

FILE = ["failure_id", "stage"]
CHUNK = [*FILE, "chunk"]
CHUNK_LINES = 4096
FAN_IN = 4096  # children of a node; with one level below the root, a file may have 7 x 10^10 lines
LEVELS = 1
BLOCK_TYPES = list(R.BLOCK_TRIGGERS)
STRICT, INDENT = "strict", "indent"


def with_views(lines: DataFrame) -> DataFrame:
    """Adds the forms a line is looked at in: ascii, noise, block_line (as part of
    a block) and clean (outside of one).  One step each, so none is computed twice."""
    return (
        lines.withColumn("ascii", X.ascii_only(F.col("raw")))
        .withColumn("noise", X.is_noise(F.col("ascii")))
        .withColumn("message", X.json_message(F.col("ascii")))
        .withColumn("block_line", X.remove_timestamp(F.col("ascii")))
        .withColumn(
            "clean",
            F.when(F.col("message") == F.col("ascii"), F.col("block_line"))
            .otherwise(X.remove_timestamp(F.col("message"))),
        )
    )


def line_facts(lines: DataFrame, mode: str = STRICT) -> DataFrame:
    """What can be said of each line from its own text.

    mode "strict" tests continuations on the stripped line (indented frames
    then end a block); "indent" keeps the indentation and lets blank lines
    stay inside panic and build-failure blocks.
    """
    if mode not in (STRICT, INDENT):
        raise ValueError(f"unknown mode {mode!r}")
    facts = with_views(lines.select(*FILE, "line_no", "raw")).withColumn(
        "suspect", ~F.col("noise") & X.suspect(F.col("clean"))
    )
    keep_blank = mode == INDENT
    if keep_blank:
        indented = F.regexp_replace(F.lower("ascii"), "(?i)" + R.TIMESTAMP, "")
        facts = facts.withColumn("block_line", F.rtrim(indented))
    facts = facts.withColumn("continues", X.may_continue(F.col("block_line"), keep_blank))
    mask = F.when(F.col("continues"), X.continuation_mask(F.col("block_line"), keep_blank))
    return (
        facts.withColumn("kinds", F.when(F.col("suspect"), X.kinds(F.col("clean"))))
        .withColumn("block_type", F.col("kinds.block_type"))
        .withColumn("signal_type", F.when(F.col("block_type").isNotNull(), "ERROR").otherwise(F.col("kinds.signal_type")))
        .drop("kinds")
        .withColumn("mask", F.coalesce(mask, F.lit(0)))
    )


def _chunk_of(chunk_lines: int) -> Column:
    return F.floor(F.col("line_no") / F.lit(chunk_lines)).cast("long")


def _marked(facts: DataFrame, chunk_lines: int) -> DataFrame:
    """Only the lines that can start an event or continue a block."""
    rows = facts.select(
        *FILE, _chunk_of(chunk_lines).alias("chunk"), "line_no", "block_type", "signal_type", "mask",
        F.when(F.col("signal_type").isNotNull(), F.col("clean")).alias("clean"),
    )
    return fence(rows, "block_type", "signal_type", "mask", "clean").filter(
        F.col("signal_type").isNotNull() | (F.col("mask") != 0)
    )


def _open(bit: int) -> int:
    """Code of the state "inside a block of this type" (a resume point is >= 0)."""
    return -(bit + 1)


def _run_ends(marked: DataFrame, chunk_lines: int) -> DataFrame:
    """Adds, per block type, the first later line that does not continue it.

    NULL means that the run reaches the end of the chunk.  Unmarked lines
    continue nothing, so a jump in the line numbers ends every run.
    """
    down = Window.partitionBy(*CHUNK).orderBy(F.desc("line_no"))
    following = F.col("line_no") + 1
    rows = marked.withColumn("above", F.lag("line_no").over(down)).withColumn(
        "above_mask", F.lag("mask").over(down)
    )
    at_chunk_end = following == (F.col("chunk") + 1) * chunk_lines
    ends = []
    for bit, _ in enumerate(BLOCK_TYPES):
        breaks = F.when(
            F.coalesce(
                (F.col("above") > following) | (F.getbit("above_mask", F.lit(bit)) == 0),
                ~at_chunk_end,
            ),
            following,
        )
        ends.append(F.last(breaks, ignorenulls=True).over(down))
    return rows.withColumn("ends", F.array(*ends)).drop("above", "above_mask")


def _candidates(ends: DataFrame, chunk_lines: int, post_context: int) -> DataFrame:
    """One row per chunk: its candidate lines in order with the end of their
    event and their resume point, and the chunk's exit for each possible entry.

    A block that is still running at the end of the chunk has no end yet; its
    resume point is the code of its type.
    """
    index = F.array_position(F.array(*[F.lit(t) for t in BLOCK_TYPES]), F.col("block_type"))
    is_block = F.col("block_type").isNotNull()
    rows = ends.withColumn(
        "stop", F.when(is_block, F.get("ends", (index - 1).cast("int"))).otherwise(F.col("line_no") + 1)
    ).withColumn(
        "resume",
        F.when(~is_block, F.col("line_no") + post_context + 2)
        .when(F.col("stop").isNull(), -index)
        .otherwise(F.col("stop") + post_context + 1),
    )
    candidate = F.struct("line_no", "resume", "stop", "block_type", "signal_type", "clean")
    grouped = rows.groupBy(*CHUNK).agg(
        F.min_by(F.struct("line_no", "mask", "ends"), "line_no").alias("head"),
        F.array_sort(
            F.collect_list(F.when(F.col("signal_type").isNotNull(), candidate))
        ).alias("found"),
    ).withColumn("lo", F.col("chunk") * chunk_lines)
    # Where a block that crosses the start of the chunk stops, NULL if not here.
    first_stop = [
        F.when(
            (F.col("head.line_no") > F.col("lo")) | (F.getbit("head.mask", F.lit(bit)) == 0),
            F.col("lo"),
        ).otherwise(F.get("head.ends", F.lit(bit)))
        for bit, _ in enumerate(BLOCK_TYPES)
    ]
    offsets = F.transform(
        F.sequence(F.lit(0), F.lit(post_context + 1)), lambda d: F.col("lo") + d.cast("long")
    )
    behind_blocks = F.array(*[
        F.coalesce(stop + post_context + 1, F.lit(_open(bit)).cast("long"))
        for bit, stop in enumerate(first_stop)
    ])
    return grouped.select(
        *CHUNK, "found", F.array(*first_stop).alias("first_stop"),
        F.concat(offsets, behind_blocks).alias("entries"),
    ).withColumn(
        "exits",
        F.aggregate(
            "found",
            F.col("entries"),
            lambda at, cand: F.transform(
                at,
                lambda f: F.when((f >= 0) & (cand["line_no"] >= f), cand["resume"]).otherwise(f),
            ),
        ),
    )


def _functions(candidates: DataFrame, chunk_lines: int, post_context: int) -> DataFrame:
    """Chunks as nodes (file, lo, moves, stops).

    A node begins at line `lo`.  Its states are how many lines a scan is ahead of the boundary (0 to post_context + 1),
    then one per block type: inside such a block.  moves: the state at its end for each state at its start.  stops: for
    each block type, the line before which a block that crosses the node's start ends; NULL if not in this node.
    """
    end = F.col("lo") + chunk_lines
    moves = F.transform(
        "exits",
        lambda x: F.when(x < 0, post_context + 1 - x).otherwise(F.greatest(x - end, F.lit(0))).cast("int"),
    )
    return candidates.withColumn("lo", F.col("chunk") * chunk_lines).select(
        *FILE, "lo", moves.alias("moves"), F.col("first_stop").alias("stops")
    )


def _over_gap(state: Column, lines: Column, post_context: int) -> Column:
    """The state behind `lines` lines of which none is marked: a block ends with the first of them."""
    ahead = F.when(state < post_context + 2, state).otherwise(post_context + 1)
    return F.when(lines > 0, F.greatest(ahead - lines, F.lit(0)).cast("int")).otherwise(state)


def _parents(nodes: DataFrame, span: int, post_context: int) -> DataFrame:
    """(file, lo, kids): the nodes of each stretch of `span` lines in order; the stretch is the whole file if 0."""
    lo = F.floor(F.col("lo") / span).cast("long") * span if span else F.lit(0).cast("long")
    kid = F.struct("lo", "moves", "stops")
    return nodes.groupBy(*FILE, lo.alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids")).withColumnRenamed("up", "lo")


def _composed(parents: DataFrame, span: int, kid_span: int, post_context: int) -> DataFrame:
    """Parents as nodes: the functions of their kids, and of the gaps between these, one after the other."""
    every = list(range(post_context + 2 + len(BLOCK_TYPES)))
    start = F.struct(
        F.col("lo").alias("at"), F.array(*[F.lit(s) for s in every]).alias("moves"),
        F.array(*[F.lit(None).cast("long")] * len(BLOCK_TYPES)).alias("stops"),
    )

    def step(acc: Column, kid: Column) -> Column:
        gap = kid["lo"] - acc["at"]
        here = F.when(gap > 0, F.transform(kid["stops"], lambda _: acc["at"])).otherwise(kid["stops"])
        return F.struct(
            (kid["lo"] + kid_span).alias("at"),
            F.transform(acc["moves"], lambda s: F.get(kid["moves"], _over_gap(s, gap, post_context))).alias("moves"),
            F.zip_with(acc["stops"], here, lambda a, b: F.coalesce(a, b)).alias("stops"),
        )

    done = parents.select(*FILE, "lo", F.aggregate("kids", start, step).alias("n"))
    gap = F.col("lo") + span - F.col("n.at")
    stops = F.when(gap > 0, F.transform("n.stops", lambda x: F.coalesce(x, F.col("n.at")))).otherwise(F.col("n.stops"))
    moves = F.transform("n.moves", lambda s: _over_gap(s, gap, post_context))
    return done.select(*FILE, "lo", moves.alias("moves"), stops.alias("stops"))


def _handed_down(parents: DataFrame, kid_span: int, post_context: int) -> DataFrame:
    """(file, lo, state, after) of the kids of parents with their own state at the start and `after`: where a block that is
    open at their end stops, by type.  `end` is the parents' end, NULL where nothing follows."""
    first = F.struct(F.col("lo").alias("at"), F.col("state").alias("s"), F.array().cast("array<int>").alias("out"))

    def forward(acc: Column, kid: Column) -> Column:
        state = _over_gap(acc["s"], kid["lo"] - acc["at"], post_context)
        return F.struct(
            (kid["lo"] + kid_span).alias("at"), F.get(kid["moves"], state).alias("s"), F.concat(acc["out"], F.array(state)).alias("out")
        )

    last = F.struct(F.col("end").alias("at"), F.col("after").alias("after"), F.array().cast("array<array<bigint>>").alias("out"))

    def backward(acc: Column, kid: Column) -> Column:
        end = kid["lo"] + kid_span
        # Where lines without a mark follow, or none, every block ends with the node.
        behind = F.transform(acc["after"], lambda x: F.when(acc["at"] == end, x).otherwise(end))
        return F.struct(
            kid["lo"].alias("at"), F.zip_with(kid["stops"], behind, lambda a, b: F.coalesce(a, b)).alias("after"),
            F.concat(acc["out"], F.array(behind)).alias("out"),
        )

    found = parents.select(
        *FILE, F.transform("kids", lambda k: k["lo"]).alias("los"), F.aggregate("kids", first, forward)["out"].alias("states"),
        F.reverse(F.aggregate(F.reverse("kids"), last, backward)["out"]).alias("afters"),
    )
    zipped = F.arrays_zip(F.col("los").alias("lo"), F.col("states").alias("state"), F.col("afters").alias("after"))
    return found.select(*FILE, F.explode(zipped).alias("k")).select(*FILE, "k.lo", "k.state", "k.after")


def _true_entries(
    candidates: DataFrame, chunk_lines: int, post_context: int, fan_in: int = FAN_IN, levels: int = LEVELS
) -> DataFrame:
    """(file, chunk, state, after): the state in which the scan enters each chunk, and where a block that is open at the
    chunk's end stops, by type."""
    spans = [chunk_lines * fan_in ** k for k in range(levels + 1)]
    nodes, kept = _functions(candidates, chunk_lines, post_context), []
    for kid_span, span in zip(spans, spans[1:]):
        kept.append(_parents(nodes, span, post_context))
        nodes = _composed(kept[-1], span, kid_span, post_context)
    root = _parents(nodes, 0, post_context).withColumns({
        "state": F.lit(0), "end": F.lit(None).cast("long"), "after": F.array(*[F.lit(None).cast("long")] * len(BLOCK_TYPES)),
    })
    entered = _handed_down(root, spans[-1], post_context)
    for parents, kid_span, span in zip(kept[::-1], spans[-2::-1], spans[:0:-1]):
        known = parents.join(entered, [*FILE, "lo"], "left").withColumn("end", F.col("lo") + span)
        entered = _handed_down(known, kid_span, post_context)
    return entered.select(*FILE, F.floor(F.col("lo") / chunk_lines).cast("long").alias("chunk"), "state", "after")


def _kept(candidates: DataFrame, entries: DataFrame, post_context: int) -> DataFrame:
    """Events that survive, per chunk in order, with the last open end filled in."""
    entry = F.get("entries", F.col("state"))
    start = F.struct(entry.alias("frontier"), F.slice("found", 1, 0).alias("kept"))

    def step(state: Column, cand: Column) -> Column:
        take = (state["frontier"] >= 0) & (cand["line_no"] >= state["frontier"])
        return F.struct(
            F.when(take, cand["resume"]).otherwise(state["frontier"]).alias("frontier"),
            F.when(take, F.concat(state["kept"], F.array(cand)))
            .otherwise(state["kept"]).alias("kept"),
        )

    def closed(event: Column) -> Column:
        index = F.array_position(F.array(*[F.lit(t) for t in BLOCK_TYPES]), event["block_type"])
        stop = F.coalesce(event["stop"], F.get("after", (index - 1).cast("int")))
        return event.withField("stop", stop).withField(
            "resume",
            F.when(event["resume"] < 0, stop + post_context + 1).otherwise(event["resume"]),
        )

    return (
        candidates.select(*CHUNK, "found", "entries")
        # Chunks inside one long block have a negative entry and keep nothing.
        .join(entries, CHUNK, "left")
        .select(*CHUNK, "after", F.aggregate("found", start, step)["kept"].alias("kept"))
        .filter(F.size("kept") > 0)
        .select(*CHUNK, F.transform("kept", closed).alias("kept"))
    )


def _last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - n + 1), F.lit(n))


def _earlier_spans(tails: DataFrame, pre_context: int, fan_in: int) -> DataFrame:
    """Adds `earlier` to (file, chunk, tail): the last spans of all chunks before.

    Every row holds at least one event, so `pre_context` rows before suffice.  Rows meet by stretches of `fan_in` chunks;
    from one stretch to the next go its last spans, one row for all its chunks.
    """
    rows = tails.withColumn("part", F.floor(F.col("chunk") / fan_in).cast("long"))

    def before(*keys: str):
        order = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(-pre_context, -1)
        return F.flatten(F.collect_list("tail").over(order))

    in_order = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "tail"))), lambda x: x["tail"])
    parts = rows.groupBy(*FILE, "part").agg(_last(F.flatten(in_order), pre_context).alias("tail"))
    carried = parts.select(*FILE, "part", before(*FILE, "part").alias("carried"))
    own = rows.withColumn("own", before(*FILE, "part", "chunk"))
    return own.join(carried, [*FILE, "part"]).select(*CHUNK, _last(F.concat("carried", "own"), pre_context).alias("earlier"))


def _with_history(kept: DataFrame, pre_context: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per event with the spans of up to `pre_context` events before it."""
    span = F.transform(
        "kept", lambda e: F.struct(e["line_no"].alias("line_no"), e["resume"].alias("resume"))
    )
    # Only the last spans of each chunk travel.
    tails = _earlier_spans(kept.select(*CHUNK, _last(span, pre_context).alias("tail")), pre_context, fan_in)
    rows = kept.join(tails, CHUNK, "left").withColumn("spans", F.concat("earlier", span))
    offset = F.size("earlier")
    events = F.transform(
        "kept",
        lambda e, ix: F.struct(
            e.alias("event"),
            F.slice(
                F.col("spans"),
                F.greatest(F.lit(1), ix + offset + 1 - pre_context),
                F.least(F.lit(pre_context), ix + offset),
            ).alias("history"),
        ),
    )
    return rows.select(*FILE, F.explode(events).alias("x")).select(
        *FILE, "x.event.*", "x.history"
    )


_LINE_REF = "array<struct<line:bigint,gap:boolean>>"


def _pre_lines(pre_context: int) -> Column:
    """The last lines outside of every kept span, as (line, is it a gap line)."""

    def stretch(first: Column, last: Column, has_gap: Column) -> Column:
        low = F.greatest(first, last - (pre_context - 1))
        lines = F.when(last >= low, F.sequence(low, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(
            lines, lambda n: F.struct(n.alias("line"), (has_gap & (n == first)).alias("gap"))
        )

    history = F.col("history")
    size = F.size(history)
    between = F.transform(
        history,
        lambda s, ix: stretch(
            s["resume"] - 1,
            F.coalesce(F.get(history, ix + 1)["line_no"], F.col("line_no")) - 1,
            F.lit(True),
        ),
    )
    at_top = F.when(
        size < pre_context,
        stretch(
            F.lit(0).cast("long"),
            F.coalesce(F.get(history, F.lit(0))["line_no"], F.col("line_no")) - 1,
            F.lit(False),
        ),
    ).otherwise(F.array().cast(_LINE_REF))
    every = F.concat(at_top, F.flatten(between))
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - pre_context + 1), F.lit(pre_context))


def _needed_lines(events: DataFrame, pre_context: int, post_context: int) -> DataFrame:
    """One row per (event, line it needs).  The event rides on its own line only."""

    def refs(numbers: Column, role: str) -> Column:
        return F.transform(
            numbers,
            lambda n: F.struct(n.alias("line"), F.lit(False).alias("gap"), F.lit(role).alias("role")),
        )

    pre = F.transform(
        "pre", lambda p: F.struct(p["line"].alias("line"), p["gap"].alias("gap"), F.lit("pre").alias("role"))
    )
    block = F.when(
        F.col("stop") > F.col("line_no") + 1, F.sequence(F.col("line_no") + 1, F.col("stop") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    # A single line keeps its next `post_context` lines, a block those from its end.
    post = F.sequence(F.col("stop"), F.col("stop") + (post_context - 1))
    own = F.array(F.col("line_no"))
    payload = F.struct("block_type", "signal_type", "clean")
    return (
        events.withColumn("pre", _pre_lines(pre_context))
        .select(
            *FILE, F.col("line_no").alias("event_line"), payload.alias("payload"),
            F.explode(F.concat(refs(own, "own"), pre, refs(block, "block"), refs(post, "post"))).alias("r"),
        )
        .select(
            *FILE, "event_line", F.col("r.line").alias("line_no"), "r.role", "r.gap",
            F.when(F.col("r.role") == "own", F.col("payload")).alias("payload"),
        )
    )


def _ordered(role: str) -> Column:
    picked = F.when((F.col("role") == role) & F.col("text").isNotNull(), F.struct("line_no", "text"))
    return F.transform(F.array_sort(F.collect_list(picked)), lambda s: s["text"])


def _attach_text(needed: DataFrame, lines: DataFrame) -> DataFrame:
    """Fetches the text of the needed lines; keyed by line, so no key is hot.

    An inner join: an event's own line is always there, and lines behind the
    end of the file have nothing to add.  So the planner may send the needed
    lines, the smaller side, to the log, or filter the log by them first.
    """
    text = (
        F.when(F.col("role") == "block", F.col("block_line"))
        .when((F.col("role") == "pre") & ~F.col("gap") & ~F.col("noise"), F.col("clean"))
        .otherwise(F.concat(F.coalesce("ascii", "after"), F.lit("\n")))
    )
    # Lines after an event are taken as they are; only the others need the views.
    found = needed.join(lines.select(*FILE, "line_no", "raw"), [*FILE, "line_no"]).withColumn(
        "after", F.when(F.col("role") == "post", X.ascii_only(F.col("raw")))
    ).withColumn("raw", F.when(F.col("role").isin("pre", "block"), F.col("raw")))
    return (
        with_views(found)
        .select(*FILE, "event_line", "line_no", "role", "payload", text.alias("text"))
        .groupBy(*FILE, "event_line")
        .agg(
            F.max("payload").alias("payload"),
            _ordered("pre").alias("pre"),
            _ordered("block").alias("block"),
            _ordered("post").alias("post"),
        )
    )


def resolve_block(block_type: Column, lines: Column) -> tuple[Column, Column]:
    """(error line, context inside the block) of a completed block."""
    n = F.size(lines)
    first = F.element_at(lines, 1)
    tail = F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0)))
    joined_tail = F.array_join(tail, "\n")

    panic = F.regexp_extract(first, r"(?id)panicked at (.+)", 1)
    panic = F.when(panic != "", F.btrim(panic, F.lit("'\""))).otherwise(first)

    marks = F.transform(
        lines,
        lambda s, ix: F.when(X.matches(s, r"\*\s+what went wrong") & (ix + 1 < n), ix + 1),
    )
    mark = F.array_min(marks)  # 1-based index of the heading, NULL without one
    cause = X.strip(F.ltrim(F.element_at(lines, mark + 1), F.lit("> ")))
    around = F.array_join(
        F.filter(lines, lambda s, ix: (ix + 1 != mark) & (ix != mark)), "\n"
    )
    error = (
        F.when(block_type == "python_traceback", F.element_at(lines, -1))
        .when(block_type == "rust_panic", panic)
        .when((block_type == "dart_exception") & (n > 1), F.get(lines, F.lit(1)))
        .when((block_type == "gradle_failure") & mark.isNotNull(), cause)
        .otherwise(first)
    )
    context = (
        F.when(block_type == "python_traceback",
               F.array_join(F.slice(lines, F.lit(1), n - 1), "\n"))
        .when((block_type == "dart_exception") & (n > 1),
              F.array_join(F.filter(lines, lambda s, ix: ix != 1), "\n"))
        .when((block_type == "gradle_failure") & mark.isNotNull(), around)
        .otherwise(joined_tail)
    )
    return error, context


def extract_signals(
    lines: DataFrame,
    *,
    mode: str = STRICT,
    pre_context: int = R.PRE_CONTEXT,
    post_context: int = R.POST_CONTEXT,
    chunk_lines: int = CHUNK_LINES,
    fan_in: int = FAN_IN,
    levels: int = LEVELS,
) -> DataFrame:
    """Every signal of every file: failure_id, stage, line_no, signal_type,
    block_type, fingerprint, error_line, pre_content, post_content."""
    ends = _run_ends(_marked(line_facts(lines, mode), chunk_lines), chunk_lines)
    # Each is used twice and is a row per chunk: written once, or every regex would run once per use.
    candidates = rewritten(_candidates(ends, chunk_lines, post_context))
    entries = _true_entries(candidates, chunk_lines, post_context, fan_in, levels)
    kept = rewritten(_kept(candidates, entries, post_context))
    events = _with_history(kept, pre_context, fan_in)
    found = _attach_text(_needed_lines(events, pre_context, post_context), lines)

    block_lines = F.concat(F.array("payload.clean"), F.col("block"))
    block_error, block_context = resolve_block(F.col("payload.block_type"), block_lines)
    is_block = F.col("payload.block_type").isNotNull()
    before = F.array_join("pre", "")
    return (
        found.withColumn("error_line", F.when(is_block, block_error).otherwise(F.col("payload.clean")))
        .withColumn("inside", F.when(is_block, block_context).otherwise(F.lit("")))
        .select(
            *FILE,
            F.col("event_line").alias("line_no"),
            F.col("payload.signal_type").alias("signal_type"),
            F.col("payload.block_type").alias("block_type"),
            X.fingerprint(F.col("error_line")).alias("fingerprint"),
            "error_line",
            F.when(F.col("inside") != "", F.concat(before, F.lit("\n"), F.col("inside")))
            .otherwise(before).alias("pre_content"),
            F.array_join("post", "").alias("post_content"),
        )
    )


def distinct_signals(signals: DataFrame) -> DataFrame:
    """First occurrence of each fingerprint inside a failure.

    min_by combines before the shuffle, so a fingerprint that fills a third of
    the rows costs one row per task.
    """
    rest = [c for c in signals.columns if c not in ("failure_id", "fingerprint")]
    return (
        signals.groupBy("failure_id", "fingerprint")
        .agg(F.min_by(F.struct(*rest), F.struct("stage", "line_no")).alias("s"))
        .select("failure_id", "fingerprint", "s.*")
        .select(*signals.columns)
    )
