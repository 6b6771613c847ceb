"""The failure-category catalogue and the numbers used for scoring."""

# --- fixed values: per category priority (lower wins ties), minimum regex ------
# --- confidence, minimum neighbour confidence, case-insensitive patterns -------
CATEGORY_SETTINGS = {
    "DEV_FAILURE": {"priority": 10, "regex_min": 0.55, "semantic_min": 0.35},
    "TEST_FAILURE": {"priority": 20, "regex_min": 0.55, "semantic_min": 0.35},
    "CI_INFRA_FAILURE": {"priority": 30, "regex_min": 0.50, "semantic_min": 0.30},
}

CATEGORY_PATTERNS = {
    "DEV_FAILURE": [
        # Build / compilation
        r"compilation\s+failed",
        r"compile\s+error",
        r"linker\s+error",
        r"undefined\s+reference",
        r"undefined\s+symbol",
        r"undefined\s+function",
        r"undefined\s+macro",
        r"preprocessor:",
        r"macro\s+.*assuming\s+0",
        r"\bsyntax\s+error\b",
        r"build\s+failed",
        r"make\s+failed",
        r"gradle\s+build\s+failed",
        r"maven\s+build\s+failed",
        r"\bfatal\s+error\b",
        r"\bcompilation\s+terminated\b",
        r"\bno\s+such\s+file\s+or\s+directory\b",
        r"\bopening\s+dependency\s+file\b",
        r"\bmake:\s+\*\*\*",
        r"\bmingw32-make:\s+\*\*\*",
        r"\bgcc:\s+(error|fatal)",
        r"\bclang:\s+(error|fatal)",
        r"\bld:\s+cannot",
        r"\bld:\s+undefined",
        r"error:\s+cannot\s+open\s+include\s+file",
        # Dependencies
        r"could\s+not\s+resolve\s+depend",
        r"dependency\s+resolution\s+failed",
        r"failed\s+to\s+resolve\s+depend",
        r"no\s+matching\s+distribution\s+found",
        r"npm\s+err.*404",
        r"package\s+not\s+found",
        r"module\s+not\s+found",
        r"cannot\s+resolve\s+import",
        r"unresolved\s+(import|dependency)",
        r"library\s+not\s+found\s+for",
        r"could\s+not\s+find\s+artifact",
        r"missing\s+(dependency|package|module|library)",
        r"failed\s+to\s+download\s+(artifact|package|dependency)",
        r"version\s+(conflict|mismatch|incompatib)",
        r"incompatible\s+(version|dependency)",
        r"^go:\s+.*@.*:\s+reading",
        # Code quality
        r"quality\s+gate.*failed",
        r"quality\s+gate\s+status.*failed",
        r"failed\s+quality\s+gate",
        r"coverage\s+is\s+less\s+than",
        r"new\s+code\s+coverage.*below",
        r"quality\s+gate\s+condition.*failed",
        r"code\s+coverage.*below.*threshold",
        r"static\s+analysis\s+failed",
        r"linting\s+failed",
        r"\d+\s+(blocker|critical)\s+issues?\s+found",
        r"pending\s+identifications?",
        r"files?\s+pending\s+for\s+identification",
        r"setting\s+stage\s+to\s+failure\s+because\s+of\s+pending\s+findings",
    ],
    "TEST_FAILURE": [
        r"tests?\s+failed",
        r"assert(ion)?\s+failed",
        r"\d+\s+tests?\s+failed",
        r"\bjunit\b",
        r"\bpytest\b",
        r"\btestng\b",
        r"test\s+execution\s+failed",
        r"\bfailures\b.*\berrors\b",
        r"test\s+suite\s+failed",
    ],
    "CI_INFRA_FAILURE": [
        # Pipeline / workflow
        r"pipeline\s+syntax\s+error",
        r"invalid\s+pipeline",
        r"failed\s+to\s+(parse|load)\s+pipeline",
        r"jenkinsfile\s+error",
        r"workflow\s+syntax\s+error",
        r"yaml\s+syntax\s+error",
        r"mapping\s+values\s+are\s+not\s+allowed",
        r"did\s+not\s+find\s+expected\s+key",
        r"while\s+parsing\s+a\s+block",
        r"groovy\s+compilation\s+error",
        r"script\s+returned\s+exit\s+code\s+1.*pipeline",
        r"org\.jenkinsci\.plugins\.workflow",
        r"no\s+such\s+dsl\s+method",
        r"workflow\s+script\s+error",
        r"invalid\s+workflow\s+file",
        r"jobs\.\w+\.\w+\s+is\s+not\s+a\s+mapping",
        r"pipeline\s+execution\s+failed\s+before",
        r"no\s+stages\s+defined\s+in\s+pipeline",
        r"expected\s+a\s+step",
        r"failed\s+to\s+retrieve\s+workflow",
        # Env / config / credentials / secrets
        r"environment\s+variable\s+\S+\s+(is\s+)?not\s+set",
        r"required\s+(env\s+var|environment\s+variable)\s+missing",
        r"missing\s+required\s+(configuration|config|env)",
        r"\bcredentials?\s+not\s+found\b",
        r"\bsecret\s+not\s+found\b",
        r"\btoken\s+not\s+(set|found|configured)\b",
        r"\bapi[\s_]?key\s+not\s+(set|found)\b",
        r"configuration\s+(file\s+)?not\s+found",
        r"config\s+error",
        r"failed\s+to\s+load\s+(settings|config|configuration)",
        r"\bunauthorized\b.*\b(token|credential|key|secret)\b",
        r"\bauthentication\s+failed\b",
        r"\bpermission\s+denied\b.*\b(secret|credential|token)\b",
        r"http.?401.*\b(auth|token|credential)\b",
        r"http.?403.*\b(auth|token|credential)\b",
        r"\baccess\s+rights?\b",
        r"scanner.*authentication\s+failed",
        r"failed\s+to\s+execute\s+(scanner|analysis)",
        r"analysis\s+server.*http.?401",
        # Artifacts / registry
        r"no\s+artifacts?\s+found",
        r"failed\s+to\s+archive",
        r"0\s+artifacts?\s+archived",
        r"no\s+files\s+to\s+upload",
        r"artifact.*not\s+found",
        r"failed\s+to\s+publish",
        r"failed\s+to\s+deploy\s+(artifact|package|image)",
        r"upload\s+failed",
        r"maven\s+deploy\s+failed",
        r"docker\s+push\s+failed",
        r"registry.*push.*failed",
        r"nexus.*failed",
        r"could\s+not\s+transfer\s+artifact",
        # Docker / container
        r"docker\s+build\s+failed",
        r"error\s+building\s+image",
        r"\bdockerfile\s+error\b",
        r"error\s+response\s+from\s+daemon",
        r"pull\s+access\s+denied",
        r"manifest\s+unknown",
        r"failed\s+to\s+pull\s+image",
        r"cannot\s+pull\s+image",
        r"\bimage\s+not\s+found\b",
        r"container\s+exited\s+with\s+(non-zero\s+)?code",
        r"oci\s+runtime\s+error",
        r"failed\s+to\s+create\s+container",
        r"docker\s+run\s+failed",
        r"\bdocker:\s+error\b",
        r"\bno\s+such\s+image\b",
        r"cannot\s+connect\s+to\s+the\s+docker\s+daemon",
        # Kubernetes / orchestration
        r"\bcrashloopbackoff\b",
        r"\bimagepullbackoff\b",
        r"\berrimagepull\b",
        r"pod\s+scheduling\s+failed",
        r"insufficient\s+(memory|cpu|resources)",
        r"\boomkilled\b",
        r"kubectl.*error",
        r"deployment.*failed",
        r"readiness\s+probe\s+failed",
        r"liveness\s+probe\s+failed",
        r"node\s+(is\s+)?not\s+ready",
        r"pod\s+(is\s+)?evicted",
        r"\bunschedulable\b",
        r"configmap\s+\S+\s+not\s+found",
        r"secret\s+\S+\s+not\s+found",
        r"failed\s+to\s+mount",
        r"container\s+failed\s+to\s+start",
        r"back-off\s+restarting\s+failed\s+container",
        # Network / connectivity
        r"connection\s+refused",
        r"connection\s+timed?\s+out",
        r"network\s+error",
        r"dns\s+resolution\s+failed",
        r"\bno\s+route\s+to\s+host\b",
        r"host\s+unreachable",
        r"failed\s+to\s+connect\s+to\s+\S+",
        r"socket\s+(timeout|timed?\s+out)",
        r"name\s+or\s+service\s+not\s+known",
        r"temporary\s+failure\s+in\s+name\s+resolution",
        r"http.?5\d\d",
        # Resources (OOM, disk, CPU)
        r"out\s+of\s+memory",
        r"\boom\b",
        r"\bkilled\b",
        r"\bsegfault\b",
        r"no\s+space\s+left\s+on\s+device",
        r"disk\s+quota\s+exceeded",
        r"process\s+exceeded\s+memory\s+limit",
        r"java\.lang\.OutOfMemoryError",
        r"GC\s+overhead\s+limit\s+exceeded",
        r"heap\s+space\s+exhausted",
        r"cpu\s+limit\s+exceeded",
        r"cannot\s+allocate\s+memory",
        # Agent / runner / executor
        r"node\s+is\s+offline",
        r"agent\s+is\s+offline",
        r"\brunner\s+offline\b",
        r"cannot\s+contact\s+node",
        r"connection\s+to\s+agent\s+lost",
        r"channel\s+closed",
        r"jenkins\s+agent\s+terminated",
        r"executor\s+lost",
        r"runner\s+has\s+stopped",
        r"\[InfluxDB\s+(P|p)lugin\].*Ignoring\s+Exception",
        r"\[InfluxDB\s+(P|p)lugin\].*connection\s+refused",
        r"\[InfluxDB\s+(P|p)lugin\].*timed?\s+out",
        r"\[InfluxDB\s+(P|p)lugin\].*network\s+error",
        r"\[InfluxDB\s+(P|p)lugin\].*failed\s+to\s+connect",
        r"\[InfluxDB\s+(P|p)lugin\].*unable\s+to\s+write",
        r"\[InfluxDB\s+(P|p)lugin\].*http.?5\d\d",
        # Unmatched file patterns
        r"doesn't\s+match\s+anything",
        r"doesnt\s+match\s+anything",
    ],
}

# --- fixed values: field weights and confidence levels -------------------------
FIELD_WEIGHTS = {"error_line": 5, "post_content": 2, "pre_content": 1, "stage": 1}
MAX_PER_PATTERN = 9
MEDIUM_SCORE = 4

# --- fixed values: fusion of pattern score and neighbour vote ------------------
REGEX_WEIGHT = 0.65
SEMANTIC_WEIGHT = 0.35
ABSOLUTE_MINIMUM = 0.20
NEIGHBOURS = 3
LEARN_ABOVE = 0.8
FEEDBACK_BATCH = 20

# --- fixed values: ownership ----------------------------------------------------
OWNERS = {
    "DEV_FAILURE": "DEVELOPERS",
    "TEST_FAILURE": "TEST_ENGINEERS",
    "CI_INFRA_FAILURE": "DEVOPS_ENGINEERS",
}
UNOWNED = "UNOWNED"
UNKNOWN = "UNKNOWN"

# --- fixed values: keyword rules for what stays unknown, in precedence order ----
KEYWORD_RULES = {
    "CI_INFRA_FAILURE": [
        "401", "unauthorized", "authentication failed", "token expired",
        "connection refused", "timeout", "network", "dns",
        "artifactory", "registry", "docker", "kubernetes", "k8s",
        "pipeline", "jenkinsfile", "workflow", "runner", "agent",
        "secret", "env", "oom", "out of memory", "resource", "disk full",
    ],
    "DEV_FAILURE": [
        "compilation error", "build failed", "linker error", "syntax error",
        "import error", "module not found", "dependency", "unresolved",
        "coverage", "lint", "checkstyle", "sonar", "fossid", "quality gate",
    ],
    "TEST_FAILURE": [
        "assertion", "assert", "expected", "actual", "test failed",
        "flaky", "fixture", "snapshot mismatch", "test timeout",
    ],
}
