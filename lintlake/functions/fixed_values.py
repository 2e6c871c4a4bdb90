"""Word lists, weights, labels and patterns that decide results.

Nothing in this module computes anything. The lists are plain data in their
significant order; operators turn them into Column expressions and the query
oracles turn them into SQL literals.
"""

from __future__ import annotations

# --- corpus ------------------------------------------------------------------

# Languages in report order, with the file extensions they own.
LANGUAGES = [
    ("Rust", ["rs"]),
    ("JavaScript", ["js", "jsx", "mjs", "cjs"]),
    ("TypeScript", ["ts", "tsx"]),
    ("Python", ["py", "pyw"]),
    ("Go", ["go"]),
    ("Ruby", ["rb"]),
    ("Java", ["java"]),
    ("C", ["c", "h"]),
    ("C++", ["cc", "cpp", "cxx", "hpp", "hxx"]),
    ("Shell", ["sh", "bash", "zsh"]),
]
OTHER_LANGUAGE = "Other"

# Directory names that are never scanned.
SKIPPED_DIRS = [
    ".git", "node_modules", "target", "dist", "build", "out", ".venv", "venv",
    "__pycache__", ".mypy_cache", ".pytest_cache", "vendor", ".idea", ".vscode",
    "coverage",
]

# Fixed value: how many leading bytes are sniffed for NUL.
SNIFF_BYTES = 8192

# Unicode White_Space code points.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- severities, categories, bands -------------------------------------------

# Fixed values: (label, rank, score weight), most serious first.
SEVERITIES = [("CRITICAL", 0, 25), ("HIGH", 1, 10), ("WARNING", 2, 3), ("INFO", 3, 1)]

# Words accepted as a severity.
SEVERITY_WORDS = {
    "critical": "CRITICAL",
    "high": "HIGH",
    "medium": "WARNING",
    "warning": "WARNING",
    "warn": "WARNING",
    "low": "INFO",
    "info": "INFO",
    "informational": "INFO",
}

# Finding categories in report order.
CATEGORIES = ["Security", "Quality", "Dependencies"]

# Score bands, trend glyphs and the width of a summary bar.
GOOD_SCORE = 80
FAIR_SCORE = 50
SPARK_GLYPHS = ["▁", "▂", "▃", "▄", "▅", "▆", "▇", "█"]
BAR_WIDTH = 24

# --- scan rules --------------------------------------------------------------

# Rule id -> (title, category, suggestion). None = no suggestion,
# and a None title is built from the marker.
RULES = {
    "hardcoded-secret": (
        "Hardcoded secret detected",
        "Security",
        "Load secrets from the environment (e.g. std::env::var / process.env) or a secrets vault.",
    ),
    "dangerous-command": (
        "Dangerous command execution",
        "Security",
        "Prefer argument arrays over shell strings and never interpolate untrusted input.",
    ),
    "large-file": (
        "Large file detected",
        "Quality",
        "Split into smaller modules with focused responsibilities.",
    ),
    "todo-tracker": (None, "Quality", None),
    "duplicate-code": (
        "Duplicate code block",
        "Quality",
        "Extract the repeated logic into a reusable function.",
    ),
    "race-condition": ("Possible race condition", "Security", None),
}

# Message tails of the scan rules.
SECRET_MESSAGE = " found in source. Move it to an environment variable or secret manager."
COMMAND_MESSAGE = " detected. Validate/sanitize inputs and avoid passing user data to a shell."
LARGE_FILE_MESSAGE = "). Large files are harder to navigate and review."
DUPLICATE_MESSAGE = ". Consider extracting a shared function."
RACE_MESSAGE = (
    " is updated with a non-atomic read-modify-write and no visible lock/transaction."
    " Concurrent updates can be lost."
)
RACE_FIX_RUST = (
    "Guard the update with a Mutex, use an atomic type (fetch_add/fetch_sub), or a DB transaction."
)
RACE_FIX_OTHER = (
    "Wrap the update in a lock or an atomic database transaction (e.g. SELECT ... FOR UPDATE)."
)

# Identifier fragments that suggest a secret.
SECRET_WORDS = [
    "api_key", "apikey", "api-key", "secret", "password", "passwd", "pwd", "token",
    "access_key", "accesskey", "private_key", "privatekey", "client_secret",
    "auth_token", "authtoken", "credential", "encryption_key",
]

# Literals that are never a real secret.
PLACEHOLDERS = [
    "", "x", "xx", "xxx", "xxxx", "changeme", "change_me", "your_key_here",
    "your-key-here", "yourkeyhere", "todo", "none", "null", "example",
    "placeholder", "test", "password", "secret", "redacted",
]

# Fragments that make a literal a lookup, not a secret.
LOOKUP_FRAGMENTS = ["process.env", "os.environ", "std::env", "${", "{{"]
MIN_SECRET_BYTES = 6
LONG_SECRET_BYTES = 16
GENERIC_SECRET = "Hardcoded credential"

# Provider tokens as (substring that must be there, pattern, label),
# first hit wins.
PROVIDER_TOKENS = [
    ("AKIA", "AKIA[A-Z0-9]{16}", "AWS access key id"),
    ("ghp_", "ghp_[A-Za-z0-9_-]{30}", "GitHub personal access token"),
    ("github_pat_", "github_pat_[A-Za-z0-9_-]{20}", "GitHub personal access token"),
    ("xoxb-", "xoxb-[A-Za-z0-9_-]{10}", "Slack token"),
    ("xoxp-", "xoxp-[A-Za-z0-9_-]{10}", "Slack token"),
    ("sk-", "sk-[A-Za-z0-9_-]{20}", "OpenAI-style secret key"),
]
PRIVATE_KEY_PARTS = ("-----BEGIN", "PRIVATE KEY-----")
PRIVATE_KEY_LABEL = "Private key block"

# Fixed values: (needle, language or None for any, label), first hit wins.
SINKS = [
    ("os.system(", "Python", "os.system() shell execution"),
    ("subprocess.call(", "Python", "subprocess call"),
    ("subprocess.Popen(", "Python", "subprocess Popen"),
    ("shell=True", "Python", "subprocess with shell=True"),
    ("eval(", "Python", "eval() of dynamic input"),
    ("exec(", "Python", "exec() of dynamic input"),
    ("Command::new(", "Rust", "std::process::Command execution"),
    ("child_process", None, "child_process usage"),
    ("exec(", "JavaScript", "exec() shell execution"),
    ("execSync(", None, "execSync() shell execution"),
    ("eval(", "JavaScript", "eval() of dynamic input"),
    ("eval(", "TypeScript", "eval() of dynamic input"),
    ("eval ", "Shell", "eval of dynamic input"),
]

# Fixed values: (marker, severity), first hit wins.
MARKERS = [("FIXME", "WARNING"), ("XXX", "WARNING"), ("HACK", "WARNING"), ("TODO", "INFO")]

# Defaults of the file rules.
LARGE_FILE_LINES = 1000
DUPLICATE_BLOCK = 6
MIN_SIGNIFICANT_BYTES = 4

# Names whose in-place update is shared state.
STATEFUL_NAMES = [
    "balance", "amount", "funds", "wallet", "credit", "credits", "quantity", "qty",
    "stock", "inventory", "count", "counter", "total", "points", "score", "supply",
]

# Fragments that show an update is already guarded.
SYNC_WORDS = [
    "lock", "mutex", "atomic", "transaction", "begin", "commit", "synchronized",
    "fetch_sub", "fetch_add", "with_lock", "select for update",
]

# Compound assignments in the order they are tried.
COMPOUND_OPS = ["-=", "+=", "*=", "/="]

# --- injection and exposure heuristics ---------------------------------------

# Fragments (lower case) of lines that read untrusted input.
INPUT_WORDS = [
    "input", "req.", "request.", "params", "query_params", "body", "argv", "user_input",
    "form", ".get(", ".post(", "getparameter", "read_line", "stdin", "$_get", "$_post",
    "$_request",
]

# Fragments of lines that build a string at run time.
DYNAMIC_STRING_WORDS = [
    '" +', '+ "', "' +", "+ '", 'f"', "f'", ".format(", "${", "format!", "%(",
]

# Fragments of lines that look sanitised.
SANITIZER_WORDS = [
    "sanitize", "escape", "prepared", "prepare(", "parameterized", "bind_param",
    "bindparam", "placeholder", "?", "$1", "%s", ":param",
]

# Database error text seen in a response body.
SQL_ERROR_WORDS = [
    "sql syntax", "syntax error at or near", "unclosed quotation mark",
    "quoted string not properly terminated", "you have an error in your sql syntax",
    "sqlite3.operationalerror", "psql:", "pg::", "ora-00933", "odbc sql", "mysql_fetch",
    "warning: mysql",
]

# Sensitive-file text seen in a response body (compared lower-cased).
EXPOSED_FILE_WORDS = [
    "root:x:0:0", "root:*:0:0", "daemon:x:", "[boot loader]", "for 16-bit app support",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----",
]

# Fragments of a path-traversal payload.
TRAVERSAL_WORDS = ["../", "..\\", "%2e%2e", "/etc/passwd", "\\windows\\", "boot.ini"]

# Fragments of an SQL-injection field value and of such a message.
SQLI_VALUE_WORDS = ["'", " or ", "1=1", "--", "union select", '" or']
SQLI_MESSAGE_WORDS = ["sql", "injection"]

# --- manifests and imports ----------------------------------------------------

# Manifest basename -> ecosystem label.
ECOSYSTEMS = {
    "Cargo.toml": "Rust (Cargo)",
    "package.json": "Node (npm)",
    "requirements.txt": "Python (PyPI)",
    "go.mod": "Go (modules)",
    "pom.xml": "Java (Maven)",
}
CSPROJ_SUFFIX = ".csproj"
CSPROJ_ECOSYSTEM = "C# (NuGet)"

# Ecosystems whose import names follow package names.
USAGE_ECOSYSTEMS = ["Rust (Cargo)", "Node (npm)", "Python (PyPI)", "Go (modules)"]

# Import heads that are local or standard library.
RUST_LOCAL_HEADS = ["crate", "self", "super", "std", "core", "alloc", ""]
POM_DEV_SCOPES = ["test", "provided"]

# --- framework mapping --------------------------------------------------------

# Framework categories in order.
FRAMEWORK_CATEGORIES = [
    ("A01:2021", "Broken Access Control"),
    ("A02:2021", "Cryptographic Failures"),
    ("A03:2021", "Injection"),
    ("A04:2021", "Insecure Design"),
    ("A05:2021", "Security Misconfiguration"),
    ("A06:2021", "Vulnerable and Outdated Components"),
    ("A07:2021", "Identification and Authentication Failures"),
    ("A08:2021", "Software and Data Integrity Failures"),
    ("A09:2021", "Security Logging and Monitoring Failures"),
    ("A10:2021", "Server-Side Request Forgery (SSRF)"),
]

# Finding key -> (category, CWE id, CWE title), in order.
FRAMEWORK_MAPPINGS = [
    ("hardcoded-secret", "A07:2021", "CWE-798", "Use of Hard-coded Credentials"),
    ("dangerous-command", "A03:2021", "CWE-78", "OS Command Injection"),
    ("KLR-SQLI", "A03:2021", "CWE-89", "SQL Injection"),
    (
        "KLR-PATH-TRAVERSAL",
        "A01:2021",
        "CWE-22",
        "Improper Limitation of a Pathname to a Restricted Directory (Path Traversal)",
    ),
    (
        "KLR-RATE-LIMIT",
        "A04:2021",
        "CWE-770",
        "Allocation of Resources Without Limits or Throttling",
    ),
    ("KLR-SESSION", "A07:2021", "CWE-384", "Session Fixation"),
]

# --- recorded probes ----------------------------------------------------------

# Issue ids, in the order the classes are tried.
ISSUE_TRAVERSAL = "KLR-PATH-TRAVERSAL"
ISSUE_RATE_LIMIT = "KLR-RATE-LIMIT"
ISSUE_SESSION = "KLR-SESSION"
ISSUE_SQLI = "KLR-SQLI"
ISSUE_GENERIC = "KLR-GENERIC"

# Issue id -> (title, summary, impact, remediation, references).
EXPLANATIONS = [
    (
        "KLR-SQLI",
        "SQL Injection",
        "Untrusted input is incorporated into a SQL query, letting an attacker alter the query's logic (e.g. `' OR 1=1`).",
        "Authentication bypass, reading or modifying arbitrary data, and in some cases full database or host compromise.",
        "Use parameterized queries / prepared statements. Never build SQL by string concatenation with user input. Apply least-privilege database accounts.",
        [
            "OWASP: SQL Injection",
            "CWE-89: Improper Neutralization of Special Elements used in an SQL Command",
        ],
    ),
    (
        "KLR-PATH-TRAVERSAL",
        "Path Traversal",
        "A file path derived from user input (e.g. `../../etc/passwd`) escapes the intended directory and reaches sensitive files.",
        "Disclosure of configuration, credentials, or system files; sometimes arbitrary file write leading to code execution.",
        "Canonicalize and validate paths against an allow-listed base directory. Reject `..` segments. Prefer opaque identifiers over raw file names.",
        [
            "OWASP: Path Traversal",
            "CWE-22: Improper Limitation of a Pathname to a Restricted Directory",
        ],
    ),
    (
        "KLR-RATE-LIMIT",
        "Missing Rate Limiting",
        "An endpoint accepts unlimited requests, so it never blocks abusive clients.",
        "Credential stuffing and brute-force attacks, resource exhaustion, and denial of service.",
        "Enforce per-IP and per-account rate limits, exponential backoff, and account lockout or CAPTCHA after repeated failures.",
        [
            "OWASP: Blocking Brute Force Attacks",
            "CWE-307: Improper Restriction of Excessive Authentication Attempts",
        ],
    ),
    (
        "KLR-SESSION",
        "Session Management Weakness",
        "A session identifier remains valid when it should not — for example a stolen cookie is still accepted after logout or reuse.",
        "Session hijacking and impersonation of authenticated users.",
        "Invalidate sessions server-side on logout and on privilege changes, rotate identifiers after login, and set `HttpOnly`, `Secure`, and `SameSite` cookie attributes.",
        ["OWASP: Session Management Cheat Sheet", "CWE-384: Session Fixation"],
    ),
    (
        "KLR-GENERIC",
        "Security Expectation Failed",
        "An attack's expectations were not met, indicating the target behaved insecurely under the tested conditions.",
        "Varies with the specific check that failed; review the attack report for the exact expectation and observed behavior.",
        "Inspect the failing expectation, reproduce it manually, and apply the appropriate input validation, authorization, or hardening.",
        ["OWASP Top 10"],
    ),
]

# Statuses that count as blocked, denied or invalidated.
BLOCKED_STATUSES = [403, 429, 503]
INVALIDATED_STATUSES = [401, 403]
DENIED_STATUSES = [401, 403, 302]
FAULT_STATUS = 500
DEFAULT_BASE_URL = "http://127.0.0.1:8080"
DEFAULT_LOGIN_TARGET = "/login"
DEFAULT_SUITE = "Tests"

# Shorthand check -> (kind, number, name). The default limit is 50.
CHECK_ALIASES = {
    "authentication": ("named", None, "requires_auth"),
    "auth": ("named", None, "requires_auth"),
    "rate_limit": ("blocked_after", 50, None),
    "rate_limiting": ("blocked_after", 50, None),
    "ratelimit": ("blocked_after", 50, None),
    "injection": ("named", None, "no_sql_error"),
    "sql_injection": ("named", None, "no_sql_error"),
    "sqli": ("named", None, "no_sql_error"),
}

# Input generators as (name, category, description, values).
GENERATORS = [
    ("negative_numbers", "boundary", "negative values where a non-negative number is expected", ["-1", "-999999"]),
    ("huge_values", "overflow", "very large integers that may overflow fixed-width types",
     ["999999999999999", "99999999999999999999999999"]),
    ("decimals", "type-confusion", "fractional values where an integer is expected", ["0.0001", "3.14159"]),
    ("zero", "boundary", "the zero value, a common off-by-one / divide-by-zero trigger", ["0"]),
    ("empty", "empty-input", "an empty string, exercising missing-input handling", [""]),
    ("sql_injection", "injection", "a classic tautology payload (' OR 1=1 --)", ["' OR 1=1 --"]),
    ("xss", "injection", "a reflected-script payload", ["<script>alert(1)</script>"]),
    ("null_bytes", "injection", "an embedded NUL byte that can truncate strings", ["a%00b"]),
    ("long_strings", "resource", "an oversized string to probe length limits and buffers", ["A" * 5000]),
    ("unicode", "encoding", "multi-byte and astral-plane characters", ["𝕏𝕏𝕏", "🔥🔥🔥"]),
]

# Other names a generator answers to.
GENERATOR_ALIASES = {
    "negatives": "negative_numbers",
    "huge": "huge_values",
    "overflow": "huge_values",
    "floats": "decimals",
    "sqli": "sql_injection",
    "long": "long_strings",
}
CUSTOM_GENERATOR_CATEGORY = "custom"

# Generators used when a field is to be varied without naming any.
DEFAULT_GENERATORS = ["sql_injection", "xss", "huge_values", "negative_numbers", "empty"]

# Longest value shown in full, and the mask for control characters.
DISPLAY_CHARS = 48
CONTROL_MASK = "·"

# The built-in probe suites, one dict per case.
SEED_CASES = [
    dict(suite="API", name="input_injection_fuzz", method="POST", target="/api/item",
         send={"id": "1"},
         mutations=[("id", ["sql_injection", "negative_numbers", "huge_values", "empty"])],
         checks=["injection"], severity="high",
         message="API input reaches the backend unsafely"),
    dict(suite="API", name="rate_limit", method="POST", target="/api/item", repeat=100,
         expectations=[("blocked_after", None, 30, None, None)], severity="medium",
         message="API endpoint is not rate limited"),
    dict(suite="Authentication", name="protected_requires_auth", target="/account",
         checks=["authentication"], severity="high",
         message="Protected endpoint is reachable without authentication"),
    dict(suite="Authentication", name="sql_login_bypass", method="POST", target="/login",
         send={"username": "' OR 1=1 --", "password": "anything"},
         expectations=[("status", "!=", 200, None, None), ("not_contains", None, None, "token", None)],
         severity="critical", message="SQL injection authentication bypass"),
    dict(suite="Authentication", name="brute_force", method="POST", target="/login", repeat=60,
         expectations=[("blocked_after", None, 20, None, None)], severity="high",
         message="Login endpoint has no brute-force rate limiting"),
    dict(suite="Crypto", name="no_private_key_leak", target="/config",
         expectations=[("not_contains", None, None, "PRIVATE KEY", None),
                       ("not_contains", None, None, "BEGIN RSA", None)],
         severity="critical", message="Private key material is exposed in a response"),
    dict(suite="Crypto", name="no_secret_leak", target="/debug",
         expectations=[("not_contains", None, None, "api_key", None),
                       ("not_contains", None, None, "secret", None)],
         severity="high", message="Secrets are exposed via a debug endpoint"),
    dict(suite="Database", name="sql_injection_fuzz", method="POST", target="/api/query",
         send={"q": "1"}, mutations=[("q", DEFAULT_GENERATORS)], checks=["injection"],
         severity="high", message="A query parameter is injectable"),
    dict(suite="Database", name="error_not_leaked", method="POST", target="/api/query",
         send={"q": "'"},
         expectations=[("not_contains", None, None, "SQL syntax", None),
                       ("not_contains", None, None, "syntax error", None)],
         severity="medium", message="Database errors leak to clients"),
    dict(suite="Filesystem", name="traversal_unix", target="/download", payload="../../etc/passwd",
         expectations=[("named", None, None, "file_not_exposed", True)], severity="high",
         message="Path traversal exposes /etc/passwd"),
    dict(suite="Filesystem", name="traversal_windows", target="/download",
         payload="..\\..\\windows\\win.ini",
         expectations=[("named", None, None, "file_not_exposed", True)], severity="high",
         message="Path traversal exposes Windows system files"),
    dict(suite="Web", name="reflected_xss", method="POST", target="/search", send={"q": "hello"},
         mutations=[("q", ["xss"])],
         expectations=[("not_contains", None, None, "<script>", None)], severity="high",
         message="Reflected XSS: script payload echoed back"),
    dict(suite="Web", name="path_traversal", target="/download", payload="../../etc/passwd",
         expectations=[("named", None, None, "file_not_exposed", True)], severity="high",
         message="Path traversal exposes server files"),
]
