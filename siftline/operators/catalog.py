"""Rule catalogs.

A rule carries the condition on a line (a case-insensitive pattern, or case-sensitive
literals) and the finding it yields. ``needles`` are folded literals, one of which every
match must contain; they let a scan skip the expression on most text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    severity: str
    message: str
    pattern: str | None = None
    literals: tuple[str, ...] = ()
    with_any: tuple[str, ...] = ()
    fold_line: bool = False
    needles: tuple[str, ...] = ()
    suggestion: str | None = None
    cwe_id: str | None = None
    confidence: str | None = "high"
    confidence_score: float | None = None
    details: str | None = None
    stage: str | None = None
    snippet_chars: int | None = None
    major: int = 0


@dataclass(frozen=True)
class Category:
    name: str
    cwe_id: str
    owasp: str
    severity: str
    suggestion: str
    patterns: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    @property
    def message(self) -> str:
        return f"Potential {self.owasp}: {self.name.replace('_', ' ').title()}"


# CWE to category, CWE to name and related CVEs.
CWE_TO_OWASP = {
    "CWE-89": "A03:2021 - Injection",
    "CWE-78": "A03:2021 - Injection",
    "CWE-79": "A03:2021 - Injection",
    "CWE-94": "A03:2021 - Injection",
    "CWE-20": "A03:2021 - Injection",
    "CWE-502": "A08:2021 - Software and Data Integrity Failures",
    "CWE-434": "A04:2021 - Insecure Design",
    "CWE-611": "A04:2021 - Insecure Design",
    "CWE-798": "A02:2021 - Cryptographic Failures",
    "CWE-295": "A02:2021 - Cryptographic Failures",
    "CWE-327": "A02:2021 - Cryptographic Failures",
    "CWE-352": "A01:2021 - Broken Access Control",
    "CWE-22": "A01:2021 - Broken Access Control",
    "CWE-862": "A01:2021 - Broken Access Control",
}
CWE_CVES = {
    "CWE-89": ("SQL Injection", ("CVE-2021-34473", "CVE-2019-18348")),
    "CWE-78": ("OS Command Injection", ("CVE-2021-4034", "CVE-2014-6271")),
    "CWE-79": ("Cross-Site Scripting", ("CVE-2021-21373", "CVE-2019-11358")),
    "CWE-94": ("Code Injection", ("CVE-2019-18348", "CVE-2018-1000862")),
    "CWE-502": ("Insecure Deserialization", ("CVE-2019-12384", "CVE-2017-9805")),
    "CWE-798": ("Hardcoded Credentials", ("CVE-2020-5217", "CVE-2019-18874")),
}

# Line checks. Pattern checks are (pattern, description, needles).
SQL_CHECKS = (
    (r"""execute\s*\(\s*f["'].*\{.*\}""", "f-string in execute", ("execute",)),
    (r"""execute\s*\(\s*["'].*%s.*["'].*%""", "String formatting in execute", ("execute",)),
    (r"""execute\s*\(\s*["'].*\+.*["'].*\)""", "String concatenation in execute", ("execute",)),
)
SECRET_CHECKS = (
    (r"""password\s*=\s*["'][^"']+["']""", "Hardcoded password", ("password",)),
    (r"""api[_-]?key\s*=\s*["'][^"']+["']""", "Hardcoded API key", ("api",)),
    (r"""secret\s*=\s*["'][^"']+["']""", "Hardcoded secret", ("secret",)),
    (r"""token\s*=\s*["'][^"']+["']""", "Hardcoded token", ("token",)),
    (r"aws[_-]?access[_-]?key", "AWS access key", ("aws",)),
    (r"private[_-]?key\s*=", "Private key", ("private",)),
)
COMMAND_NAMES = ("system", "exec", "popen", "subprocess")
COMMAND_JOINERS = ("+", 'f"', '" +')
UNSAFE_IMPORTS = ("pickle", "eval", "exec", "__import__")
WEAK_ALGORITHMS = ("md5", "sha1", "des")
DESERIALIZERS = ("yaml.load", "pickle.load", "marshal.load")
TRAVERSALS = ("../", "..\\", "/etc/passwd", "C:\\")

# Sensitive-assignment patterns by kind.
SENSITIVE_CHECKS = (
    ("password", r"""password\s*=\s*["'][^"']+["']""", ("password",)),
    ("api_key", r"""api[_-]?key\s*=\s*["'][^"']+["']""", ("api",)),
    ("secret", r"""secret\s*=\s*["'][^"']+["']""", ("secret",)),
    ("token", r"""token\s*=\s*["'][^"']+["']""", ("token",)),
    ("private_key", r"""private[_-]?key\s*=\s*["'][^"']+["']""", ("private",)),
    ("aws_key", r"aws[_-]?(access[_-]?key|secret)[_-]?id\s*=", ("aws",)),
)

# Secret kinds searched over whole texts.
SECRET_KINDS = (
    ("API Key", r"[a-zA-Z0-9]{32,}"),
    ("AWS Key", r"AKIA[0-9A-Z]{16}"),
    ("Private Key", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    ("Password", r"""password\s*=\s*["'][^"']+["']"""),
    ("Token", r"""token\s*=\s*["'][^"']+["']"""),
)

# Vulnerability categories searched over whole contents.
CATEGORIES = (
    Category(
        "sql_injection", "CWE-89", "A03:2021 - Injection", "critical",
        "Use parameterized queries or an ORM",
        (
            (r"""execute\s*\(\s*f["'].*\{.*\}""", ("execute",)),
            (r"""execute\s*\(\s*["'].*%s""", ("execute",)),
            (r"""execute\s*\(\s*["'].*\+""", ("execute",)),
            (r"cursor\.execute\s*\([^,)]*\%", ("cursor.execute",)),
            (r"\.format\s*\([^)]*\+[^)]*\)", (".format",)),
        ),
    ),
    Category(
        "hardcoded_secrets", "CWE-798", "A02:2021 - Cryptographic Failures", "high",
        "Use environment variables or a secrets manager",
        (
            (r"""password\s*=\s*["'][^"']+["']""", ("password",)),
            (r"""secret\s*=\s*["'][^"']+["']""", ("secret",)),
            (r"""api[_-]?key\s*=\s*["'][^"']+["']""", ("api",)),
            (r"""token\s*=\s*["'][^"']+["']""", ("token",)),
            (r"""private[_-]?key\s*=\s*["'][^"']+["']""", ("private",)),
            (r"""aws[_-]?access[_-]?key[_-]?id\s*=\s*["'][^"']+["']""", ("aws",)),
            (r"""aws[_-]?secret[_-]?access[_-]?key\s*=\s*["'][^"']+["']""", ("aws",)),
        ),
    ),
    Category(
        "weak_crypto", "CWE-327", "A02:2021 - Cryptographic Failures", "medium",
        "Use strong cryptographic algorithms (AES, SHA-256+)",
        (
            (r"md5\s*\(", ("md5",)),
            (r"sha1\s*\(", ("sha1",)),
            (r"""hashlib\.new\s*\(\s*["']md5""", ("hashlib.new",)),
            (r"""hashlib\.new\s*\(\s*["']sha1""", ("hashlib.new",)),
            (r"DES\s*\.new\s*\(", (".new",)),
            (r"RC4\s*\(", ("rc4",)),
        ),
    ),
    Category(
        "xss", "CWE-79", "A03:2021 - Injection", "high",
        "Use proper output encoding or sanitization",
        (
            (r"innerHTML\s*=", ("innerhtml",)),
            (r"dangerouslySetInnerHTML", ("dangerouslysetinnerhtml",)),
            (r"document\.write\s*\(", ("document.write",)),
            (r"\.html\s*\([^)]*\)", (".html",)),
        ),
    ),
    Category(
        "path_traversal", "CWE-22", "A01:2021 - Broken Access Control", "high",
        "Validate and sanitize user input for file paths",
        (
            (r"open\s*\([^,)]*\+[^,)]*\)", ("open",)),
            (r"os\.path\.join\s*\([^,)]*\+", ("os.path.join",)),
            (r"Path\s*\([^)]*\+[^)]*\)", ("path",)),
        ),
    ),
    Category(
        "deserialization", "CWE-502", "A08:2021 - Software and Data Integrity Failures", "critical",
        "Use safe serialization formats (JSON) or validate input",
        (
            (r"pickle\.load\s*\(", ("pickle.load",)),
            (r"yaml\.load\s*\(", ("yaml.load",)),
            (r"marshal\.load\s*\(", ("marshal.load",)),
            (r"yaml\.unsafe_load\s*\(", ("yaml.unsafe_load",)),
        ),
    ),
    Category(
        "command_injection", "CWE-78", "A03:2021 - Injection", "critical",
        "Avoid shell=True, use list arguments, sanitize inputs",
        (
            (r"os\.system\s*\(", ("os.system",)),
            (r"subprocess\.call\s*\([^,)]*\+[^,)]*\)", ("subprocess.call",)),
            (r"os\.popen\s*\(", ("os.popen",)),
            (r"subprocess\.run\s*\([^,)]*shell\s*=\s*True", ("subprocess.run",)),
            (r"os\.spawn", ("os.spawn",)),
        ),
    ),
    Category(
        "hardcoded_ip", "CWE-798", "A02:2021 - Cryptographic Failures", "medium",
        "Use configuration files or environment variables for IPs",
        ((r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", ()),),
    ),
    Category(
        "insecure_random", "CWE-338", "A02:2021 - Cryptographic Failures", "medium",
        "Use secrets module for cryptographic randomness",
        (
            (r"random\.random\s*\(\s*\)", ("random.random",)),
            (r"random\.choice\s*\(", ("random.choice",)),
            (r"random\.randint\s*\(", ("random.randint",)),
        ),
    ),
    Category(
        "debug_mode", "CWE-11", "A05:2021 - Security Misconfiguration", "medium",
        "Disable debug mode in production",
        (
            (r"DEBUG\s*=\s*True", ("debug",)),
            (r"debug\s*=\s*True", ("debug",)),
            (r"app\.run\s*\(\s*debug\s*=\s*True", ("app.run",)),
        ),
    ),
    Category(
        "bypass_auth", "CWE-287", "A01:2021 - Broken Access Control", "high",
        "Implement proper authentication and authorization",
        (
            (r"@app\.route.*methods.*POST.*if.*True", ("@app.route",)),
            (r"if.*admin.*return", ("admin",)),
        ),
    ),
    Category(
        "logger_exposure", "CWE-532", "A01:2021 - Broken Access Control", "medium",
        "Avoid logging sensitive information",
        (
            (r"logger\.(debug|info)\([^)]*password", ("logger.",)),
            (r"logger\.(debug|info)\([^)]*secret", ("logger.",)),
            (r"logger\.(debug|info)\([^)]*token", ("logger.",)),
        ),
    ),
)

# Bug patterns as (pattern, severity, type, CWE, message, suggestion, needles).
BUG_PATTERNS = (
    (r"""(execute|executemany|query)\s*\([^)]*["'].*%[^)]*\)|cursor\.execute\([^)]*\+""",
     "critical", "SQL Injection", "CWE-89",
     "User input directly concatenated into SQL query",
     "Use parameterized queries with placeholders", ("execute", "query")),
    (r"""(password|passwd|pwd|secret|api_key|token)\s*=\s*["'][^"']{8,}["']""",
     "critical", "Hardcoded Secret", "CWE-798",
     "Hardcoded password or secret in source code",
     "Use environment variables or secure vault",
     ("password", "passwd", "pwd", "secret", "api_key", "token")),
    (r"os\.system\([^)]*\+|subprocess\.(call|run|Popen)\([^)]*\+|exec\([^)]*\+",
     "critical", "Command Injection", "CWE-78",
     "User input passed to system commands",
     "Use subprocess with shell=False and proper escaping",
     ("os.system", "subprocess.", "exec(")),
    (r"(open|file|read)\([^)]*\+|Path\([^)]*\+",
     "high", "Path Traversal", "CWE-22",
     "File path constructed with user input",
     "Validate and sanitize file paths, use allowlists",
     ("open(", "file(", "read(", "path(")),
    (r"eval\s*\([^)]*\)", "critical", "Code Injection", "CWE-94",
     "Dynamic code execution with eval()",
     "Avoid eval(), use ast.literal_eval() or safer alternatives", ("eval",)),
    (r"exec\s*\([^)]*\)", "critical", "Code Injection", "CWE-94",
     "Dynamic code execution with exec()",
     "Avoid exec(), use safer alternatives", ("exec",)),
    (r"pickle\.loads\s*\([^)]*\)", "high", "Insecure Deserialization", "CWE-502",
     "Unpickling untrusted data",
     "Use JSON or validate data before unpickling", ("pickle.loads",)),
    (r"innerHTML\s*=|document\.write\(", "high", "Cross-Site Scripting", "CWE-79",
     "User input written to DOM without sanitization",
     "Sanitize user input, use textContent instead of innerHTML",
     ("innerhtml", "document.write")),
    (r"^\s*except\s*:", "medium", "Bare Except", "CWE-391",
     "Bare except catches all exceptions silently",
     "Catch specific exceptions or use 'except Exception:'", ("except",)),
    (r"^\s*except[^:]*:\s*\n\s*(pass|#)", "medium", "Empty Except Block", "CWE-391",
     "Exception is silently ignored",
     "Log or handle the exception properly", ("except",)),
    (r"def\s+\w+\([^)]*=\s*\[\]", "medium", "Mutable Default Argument", "CWE-484",
     "Mutable default arguments are shared between calls",
     "Use None as default and initialize inside function", ("def",)),
)
EMPTY_EXCEPT_INDEX = 9
BUG_STAGE = "codex-bug"
BUG_CONFIDENCE = 0.85

# Expressions carried by learned rules.
LEARNED_SECRET = r"""(?:password|secret|api_key|token)\s*=\s*["'][^"']{4,}["']"""
LEARNED_EXCEPT = r"except\s+\w+\s*:\s*\n\s*pass"


def cwe_details(description: str, cwe_id: str) -> str:
    name, cves = CWE_CVES.get(cwe_id, ("Unknown", ()))
    text = f"Analysis: {description}\n\nCWE: {name}"
    return text + (f"\nRelated: {', '.join(cves[:2])}" if cves else "")


def _line_checks() -> dict[str, tuple[Rule, ...]]:
    security = lambda rid, sev, msg, **kw: Rule(rid, "security", sev, msg, **kw)
    checks = {
        "sql_injection": [
            security("line-sql_injection", "critical", f"Potential SQL injection: {d}",
                     pattern=p, needles=n)
            for p, d, n in SQL_CHECKS
        ],
        "hardcoded_secrets": [
            security("line-hardcoded_secrets", "high", f"Security issue: {d}",
                     pattern=p, needles=n, snippet_chars=50)
            for p, d, n in SECRET_CHECKS
        ],
        "command_injection": [
            security("line-command_injection", "critical", f"Potential command injection: {f}",
                     literals=(f + "(",), with_any=COMMAND_JOINERS, needles=("(",))
            for f in COMMAND_NAMES
        ],
        "unsafe_imports": [
            security("line-unsafe_imports", "medium", f"Unsafe import: {m}",
                     literals=(f"import {m}", f"from {m} import"), needles=("import",))
            for m in UNSAFE_IMPORTS
        ],
        "weak_crypto": [
            security("line-weak_crypto", "medium", f"Weak cryptographic algorithm: {a}",
                     literals=(f'"{a}"', f"'{a}'"), fold_line=True, needles=(a,))
            for a in WEAK_ALGORITHMS
        ],
        "insecure_deserialization": [
            security("line-insecure_deserialization", "high", f"Insecure deserialization: {c}",
                     literals=(c,), needles=(".load",))
            for c in DESERIALIZERS
        ],
        "path_traversal": [
            security("line-path_traversal", "high", "Potential path traversal",
                     literals=(t,), snippet_chars=50,
                     needles=("..",) if t.startswith("..") else (t.lower(),))
            for t in TRAVERSALS
        ],
    }
    ordered = {}
    for major, (name, rules) in enumerate(checks.items()):
        ordered[name] = tuple(Rule(**{**r.__dict__, "major": major}) for r in rules)
    return ordered


LINE_CHECKS = _line_checks()
LINE_PACK = tuple(r for rules in LINE_CHECKS.values() for r in rules)

SENSITIVE_PACK = tuple(
    Rule(f"sensitive-{kind}", "security", "high", f"Sensitive assignment: {kind}",
         pattern=p, needles=n, suggestion="Use environment variables or a secrets manager instead")
    for kind, p, n in SENSITIVE_CHECKS
)

BUG_PACK = tuple(
    Rule(f"bug-{i}", kind, severity, message, pattern=p, needles=n, suggestion=fix, cwe_id=cwe,
         confidence=None, confidence_score=BUG_CONFIDENCE, details=cwe_details(message, cwe),
         stage=BUG_STAGE, major=i)
    for i, (p, severity, kind, cwe, message, fix, n) in enumerate(BUG_PATTERNS)
)
