"""A plain one-file model of the scan, for comparison with the dataflow.

Works by index over the whole file: find the next candidate, take its event,
jump behind it.
"""

import hashlib
import json
import re

from redbuild.functions import signal_rules as R

I = re.IGNORECASE
TYPES = {t: [re.compile(p, I) for p in ps] for t, ps in R.SIGNAL_TYPES.items()}
TRIGGERS = {t: re.compile(p, I) for t, p in R.BLOCK_TRIGGERS.items()}
CONTINUES = {t: re.compile(p, I) for t, p in R.BLOCK_CONTINUATIONS.items()}
NOISE = [re.compile(p) for p in R.NOISE_LINES]
STAMP = re.compile(R.TIMESTAMP, I)


def unstamped(line):
    return STAMP.sub("", line.lower().strip()).strip()


def unwrapped(line):
    if line.strip().startswith("{"):
        try:
            doc = json.loads(line)
        except ValueError:
            return line
        if isinstance(doc, dict):
            return next((str(doc[k]) for k in R.JSON_MESSAGE_KEYS if doc.get(k)), line)
    return line


def kind_of(line):
    """(block type or None, signal type or None) of a clean line."""
    for block, pattern in TRIGGERS.items():
        if pattern.search(line):
            return block, "ERROR"
    for name, patterns in TYPES.items():
        if any(p.search(line) for p in patterns):
            return None, name
    return None, None


def fingerprint(line):
    line = line.lower()
    for pattern, replacement in R.FINGERPRINT_REWRITES:
        line = re.sub(pattern, replacement, line)
    return hashlib.sha256(line.strip().encode()).hexdigest()


def resolve(block, lines):
    if block == "python_traceback":
        return lines[-1], lines[:-1]
    if block == "rust_panic":
        found = re.search("panicked at (.+)", lines[0])
        return (found[1].strip("'\"") if found else lines[0]), lines[1:]
    if block == "dart_exception" and len(lines) > 1:
        return lines[1], lines[:1] + lines[2:]
    if block == "gradle_failure":
        for at in range(len(lines) - 1):
            if re.search(r"\*\s+what went wrong", lines[at]):
                return lines[at + 1].lstrip("> ").strip(), lines[:at] + lines[at + 2:]
    return lines[0], lines[1:]


def scan(raw_lines, before=R.PRE_CONTEXT, after=R.POST_CONTEXT):
    text = [re.sub(r"[^\x00-\x7F]+", "", raw) + "\n" for raw in raw_lines]
    noise = [any(p.search(t) for p in NOISE) for t in text]
    clean = [unstamped(unwrapped(t)) for t in text]
    events, queue, at = [], [], 0
    while at < len(text):
        block, name = (None, None) if noise[at] else kind_of(clean[at])
        if name is None:
            queue.append(text[at] if noise[at] else clean[at])
            at += 1
            continue
        stop, lines = at + 1, [clean[at]]
        if block:
            while stop < len(text) and CONTINUES[block].search(unstamped(text[stop])):
                lines.append(unstamped(text[stop]))
                stop += 1
        error, inside = resolve(block, lines) if block else (clean[at], [])
        pre = "".join(queue[-before:])
        if "\n".join(inside):
            pre += "\n" + "\n".join(inside)
        events.append(
            {
                "line_no": at, "signal_type": name, "block_type": block,
                "fingerprint": fingerprint(error), "error_line": error,
                "pre_content": pre, "post_content": "".join(text[stop:stop + after]),
            }
        )
        gap = stop + after
        if gap < len(text):
            queue.append(text[gap])
        at = gap + 1
    return events
