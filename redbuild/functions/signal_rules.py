"""How a CI log line is recognised.

Everything in this module is data.  The patterns have to be these ones for the
results to be comparable, so they are written out as plain text, in order.
All text they are applied to is ASCII and lower-cased beforehand.
"""

# --- fixed values: signal types, highest priority first -----------------------
SIGNAL_TYPES = {
    "TEST_FAILURE": [
        r"\bassert(?:ion)?\s*failed\b",
        r"\btests?\s+failed\b",
    ],
    "BUILD_FAILURE": [
        r"\bbuild\s+failed\b",
        r"\baccess\s+denied\b",
        r"\bcould\s+not\s+resolve\s+(?:dependencies?|artifact)\b",
        r"\bcannot?\s+find\s+(?:module|package|symbol)\b",
        r"\bno\s+matching\s+distribution\s+found\b",
        r"\bnpm\s+err[!]?\b(?!\.\w)",
        r"\bcompilation\s+(?:error|failed)\b",
        r"\bfailed\s+to\s+pull\s+(?:image\b)?",
        r"\bpull\s+access\s+denied\b",
    ],
    "SECURITY": [
        r"\b(?:authentication|auth)\s+failed\b",
        r"\bunauthorized\b(?!\.\w)",
        r"\bpermission\s+denied\b(?!\.\w)",
        r"\bssl\s+(?:certificate\s+)?(?:verify\s+failed|handshake\s+(?:failed|error))\b",
    ],
    # A fifth, case-sensitive ENOSPC pattern can never match lower-cased text
    # and is therefore left out.
    "RESOURCE": [
        r"\boom(?:killed)?\b(?!\.\w)",
        r"\bout\s+of\s+memory\b",
        r"\bno\s+space\s+left\s+on\s+device\b",
        r"\bdisk\s+(?:quota\s+exceeded|full)\b",
    ],
    "ERROR": [
        r"(?:^|\s|\[)(error|exception|traceback|panic|fatal|critical)\b(?!\.\w)",
        r"\b(abort(?:ed|ing)?|crash(?:ed|ing)?|segfault)\b(?!\.\w)",
        r"\bhttp\s*error\b",
        r"\bhttperror\b",
        r"\bconnection\s+(?:refused|timed?\s*out|reset)\b",
        r"\bcould\s+not\s+(?:connect|resolve\s+host)\b",
        r"\bno\s+route\s+to\s+host\b",
        r"\bname\s+or\s+service\s+not\s+known\b",
        r"\b(?:execution\s+)?timed?\s*out\b(?!\.\w)",
        r"\bdeadline\s+exceeded\b",
    ],
    "EXIT_CODE": [
        r"\bexit\s*(?:code)?\s*(?!0\b)\d+\b",
        r"\b(?:returned|status)\s*[=:]?\s*[1-9]\d*\b",
    ],
}

# --- fixed values: multi-line blocks, in test order ---------------------------
BLOCK_TRIGGERS = {
    "python_traceback": r"traceback\s*\(most\s+recent\s+call\s+last\)\s*:",
    "java_exception": r"exception\s+in\s+thread\b|[a-z][\w.]+\.(?:exception|error):\s",
    "rust_panic": r"thread\s+'.+?'\s+panicked\s+at",
    "go_panic": r"^panic:\s",
    "node_error": r"^(?:Error|TypeError|ReferenceError|SyntaxError|RangeError|URIError|EvalError):\s",
    "ruby_exception": r"^[A-Z][A-Za-z:]+Error:\s",
    "php_fatal": r"^(?:Fatal|Parse)\s+error:\s",
    "dart_exception": r"^unhandled\s+exception:\s*$",
    "gradle_failure": r"^FAILURE:\s+Build\s+failed\s+with\s+an\s+exception",
}

BLOCK_CONTINUATIONS = {
    "python_traceback": r'^\s+File\s+"|^\s+|^[A-Za-z][\w.]*(?:Error|Exception)\s*:',
    "java_exception": r"^\s*at\s+[\w.$<>]+\(|^caused\s+by\s*:",
    "rust_panic": r"^note\s*:|^\s+\d+\s*\|\s|^\s+-+\^",
    "go_panic": r"^goroutine\s+\d+\s+\[|^\t\S|^\s*\S.*\.go:\d+",
    "node_error": r"^\s+at\s+(?:[\w.<>]+\s+)?\(|^\s+at\s+\S+:\d+:\d+",
    "ruby_exception": r"^\s+from\s+.+:\d+:in\s+",
    "php_fatal": r"^Stack\s+trace:|^\s*#\d+\s+",
    "dart_exception": r"^#\d+\s+[\w.<>\s]+\(",
    "gradle_failure": r"^\*\s+(?:What\s+went\s+wrong|Try\s+)|^>\s+\S|^Execution\s+failed\s+for",
}

# --- fixed values: noise lines (the last one is case-sensitive) ----------------
NOISE_LINES = [
    r"(?i:\[InfluxDB\s+(P|p)lugin\](\s+Collecting|\s+INFO:|\s+WARNING:|.*plugin\s+data\s+found))",
    r"(?i:^\s*(?:Downloading|Downloaded)\s+from\s+\S+:)",
    r"(?i:^\s*Progress\s*\(\s*\d+\s*/\s*\d+\s*\))",
    r"^\s*\[Pipeline\]\s+(?:\{|\}|//\s*\w+)\s*$",
]

# Every line that one of the patterns above matches holds one of these words, so
# they can be looked for first.  (Continuations: of stripped lines, besides "at".)
SIGNAL_WORDS = [
    "fail", "denied", "could", "find", "distribution", "npm", "compilation",
    "unauthorized", "ssl", "oom", "memory", "space", "disk", "error", "exception",
    "traceback", "panic", "fatal", "critical", "abort", "crash", "segfault", "connection",
    "route", "known", "out", "deadline", "exit", "returned", "status",
]
# Pattern by pattern, in the order of SIGNAL_TYPES and BLOCK_TRIGGERS: of these words every match holds one.
SIGNAL_TYPE_WORDS = {
    "TEST_FAILURE": [["assert"], ["test"]],
    "BUILD_FAILURE": [
        ["build"], ["access"], ["could"], ["find"], ["distribution"], ["npm"], ["compilation"], ["failed"], ["access"],
    ],
    "SECURITY": [["auth"], ["unauthorized"], ["permission"], ["ssl"]],
    "RESOURCE": [["oom"], ["memory"], ["space"], ["disk"]],
    "ERROR": [
        ["error", "exception", "traceback", "panic", "fatal", "critical"], ["abort", "crash", "segfault"], ["http"],
        ["httperror"], ["connection"], ["could"], ["route"], ["known"], ["out"], ["deadline"],
    ],
    "EXIT_CODE": [["exit"], ["returned", "status"]],
}
BLOCK_TRIGGER_WORDS = {
    "python_traceback": ["traceback"], "java_exception": ["exception", ".error:"], "rust_panic": ["panicked"],
    "go_panic": ["panic:"], "node_error": ["error:"], "ruby_exception": ["error:"], "php_fatal": ["error:"],
    "dart_exception": ["unhandled"], "gradle_failure": ["failure:"],
}
CONTINUATION_WORDS = [
    "error", "exception", "caused", "note", "goroutine", ".go:", "stack", "#", "*", ">", "execution",
]
NOISE_WORDS = ["influxdb", "download", "progress", "[pipeline]"]

# --- fixed values: timestamps removed from a line, JSON message fields ---------
TIMESTAMP = (
    r"\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?"
    r"|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b"
)
JSON_MESSAGE_KEYS = ["msg", "message", "error", "err", "text", "log"]

# --- fixed values: lines a plug-in marks as information only (optional filter) --
INFORMATIONAL_LINE = r"\[InfluxDB\s+(P|p)lugin\](\s+Collecting|\s+INFO:|\s+WARNING:|.*plugin\s+data\s+found)"

# --- fixed values: context sizes ------------------------------------------------
PRE_CONTEXT = 10
POST_CONTEXT = 20

# --- fixed values: ordered rewrites of an error line for its fingerprint -------
FINGERPRINT_REWRITES = [
    (r"\x1B\[[0-?]*[ -/]*[@-~]", ""),
    (r"\[\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}\.\d{3}z\]", ""),
    (r"[a-zA-Z]:\\[^\s]+", "<PATH>"),
    (r"/[^\s]+", "<PATH>"),
    (r"\d+", "<NUM>"),
    (r"#[a-f0-9]+", "#<ID>"),
    (r"[^\w\s<>]", " "),
    (r"\s+", " "),
]

# --- fixed values: ordered rewrites of a text before embedding -----------------
# "$1" is the first group.  The flag marks case-insensitive patterns.
EMBEDDING_REWRITES = [
    (r"\x1B\[[0-?]*[ -/]*[@-~]", "", False),
    (r"\d{2}:\d{2}:\d{2}\.\d+", "<TIME>", False),
    (r"\d{2}:\d{2}:\d{2}", "<TIME>", False),
    (r"\d{2}:\d{2}", "<TIME>", False),
    # The bracketed timestamp and the test-progress rewrite that follow here
    # need digits the previous rewrite has already taken: they never match.
    (r"[a-z]:[/\\][\w/\\]+[/\\](\w+\.dart)", "$1", True),
    (r"[a-z]:[/\\][\w/\\]+[/\\](\w+\.\w+)", "$1", True),
    (r"/[\w/]+/(\w+\.dart)", "$1", False),
    (r"/[\w/]+/(\w+\.\w+)", "$1", False),
    (r"[a-zA-Z]:\\[^\s]+", "<PATH>", False),
    (r"/[^\s/]+/[^\s]+", "<PATH>", False),
    # "line N" also covers "at line N".
    (r"line\s+\d+", "line <NUM>", True),
    (r"column\s+\d+", "column <NUM>", True),
    (r":\d+:\d+:", ":<NUM>:<NUM>:", False),
    (r"test\s+\d+", "test <NUM>", True),
    (r"\+\d+", "+<NUM>", False),
    (r"~\d+", "~<NUM>", False),
    (r"0x[0-9a-f]+", "<ADDR>", True),
    (r"\b[0-9a-f]{8,}\b", "<HASH>", True),
    (r"#[a-f0-9]+", "#<ID>", False),
    (r"\b\d+\.\d+\b", "<FLOAT>", False),
    (r"\b\d{4,}\b", "<BIGNUM>", False),
    (r"^(error|exception|warning|fatal):", "<ERROR_TYPE>:", True),
    (r"test\s+(failed|failure|error)", "test <FAILED>", True),
    (r"(when the exception was thrown|exception caught|stack trace)", "<EXCEPTION_MARKER>", True),
]
