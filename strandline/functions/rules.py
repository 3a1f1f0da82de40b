"""Fixed values of the review rules: lists, maps, patterns and prices."""

#: Extensions of source files.
SOURCE_EXTENSIONS = (".cs", ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rs", ".cpp", ".c", ".h", ".hpp", ".rb", ".php", ".swift", ".kt", ".scala", ".vue", ".svelte", ".razor", ".cshtml", ".fs", ".fsx", ".vb", ".lua", ".r", ".jl", ".dart", ".elm", ".clj", ".ex", ".exs", ".erl", ".hrl")

#: Folders whose files are left out.
EXCLUDED_DIRS = ("node_modules", "bin", "obj", ".git", ".vs", ".idea", ".vscode", "packages", "dist", "build", "__pycache__", ".venv", "venv", "coverage", ".nyc_output", "TestResults", ".nuget", "vendor", ".gradle", "target", "out", ".next", ".cache")

#: Extensions of binary files.
BINARY_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".pdb", ".obj", ".o", ".a", ".zip", ".tar", ".gz", ".rar", ".7z", ".jar", ".war", ".ear", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".wav", ".flac", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".eot", ".otf")

#: The router's languages (none for others), and the chunker's (text for others).
ROUTER_LANGUAGES = {".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".vue": "javascript", ".svelte": "javascript", ".razor": "csharp", ".cshtml": "csharp"}
CHUNKER_LANGUAGES = {".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c-header", ".hpp": "c-header", ".md": "markdown", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml"}

#: Substrings that each add a decision point.
DECISION_POINTS = (" if ", " if(", " else ", " switch ", " case ", " for ", " for(", " foreach ", " foreach(", " while ", " while(", " catch ", " catch(", " && ", " || ", " ? ", ": ")

#: Dollars for a million tokens of input.
PRICES = {"gpt-4o": "2.50", "gpt-4o-mini": "0.15", "gpt-4": "30.00", "gpt-4-turbo": "10.00", "gpt-3.5-turbo": "0.50", "text-embedding-ada-002": "0.10", "text-embedding-3-small": "0.02", "text-embedding-3-large": "0.13", "mock-embedding": "0", "mock": "0"}

#: Severity codes.
SEVERITY_CODES = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

#: Sizes in bytes: below DIRECT a file is sent whole, up to RAG in chunks.
DIRECT, RAG = 10240, 204800


#: Security rules: name, pattern, description, severity. Case is ignored.
SECURITY_RULES = (
    ("sql_injection", r"""("SELECT|'SELECT|"INSERT|'INSERT|"UPDATE|'UPDATE|"DELETE|'DELETE).*\+.*\w+""", "Potential SQL Injection vulnerability - string concatenation in SQL query", "Critical"),
    ("credential", r"""(password|passwd|pwd|secret|api[_-]?key|apikey|token|auth)\s*[=:]\s*["'][^"']+["']""", "Potential hardcoded credential or secret", "Critical"),
    ("weak_crypto", r"\b(MD5|SHA1|DES)\b", "Use of weak cryptographic algorithm", "High"),
    ("weak_random", r"new\s+Random\s*\(\s*\)", "Insecure random number generator - use cryptographic RNG for security", "Medium"),
    ("path_traversal", r"Path\.(Combine|Join).*Request\.(Query|Form|Path)", "Potential path traversal vulnerability", "High"),
    ("command_injection", r"Process\.Start\s*\(.*\+", "Potential command injection - dynamic process execution", "Critical"),
    ("xss", r"innerHTML\s*=|document\.write\(|\.html\(", "Potential XSS vulnerability - unsafe HTML manipulation", "High"),
    ("deserialization", r"BinaryFormatter|NetDataContractSerializer|ObjectStateFormatter", "Insecure deserialization - vulnerable to remote code execution", "Critical"),
    ("debug_code", r"console\.log\(|Debug\.WriteLine|debugger;", "Debug code that should be removed in production", "Low"),
    ("tls_off", r"verify\s*=\s*false|ssl[_-]?verify\s*=\s*false|checkServerIdentity.*null", "SSL/TLS verification disabled", "Critical"),
    ("open_endpoint", r"\[AllowAnonymous\]|\[Authorize\s*\(\s*\)\s*\]", "Review authentication configuration on endpoints", "Info"),
)

#: Advice of the security rules, and of those without one of their own.
ADVICE = {
    "sql_injection": "Use parameterized queries or an ORM to prevent SQL injection.",
    "credential": "Move secrets to environment variables, Azure Key Vault, or a secrets manager.",
    "weak_crypto": "Use SHA-256 or stronger for hashing, and bcrypt/Argon2 for passwords.",
    "weak_random": "Use RandomNumberGenerator for cryptographic purposes.",
    "command_injection": "Validate and sanitize all inputs used in process execution.",
    "xss": "Sanitize user input before rendering in HTML. Use textContent or proper encoding.",
    "deserialization": "Use JSON or XML serialization instead. Consider System.Text.Json or XmlSerializer.",
}
NO_ADVICE = "Review this code for security implications."

#: Secrets in configuration files (case is ignored), what marks a placeholder, and the extensions.
CONFIG_RULES = (
    ("password", r"""["']?password["']?\s*[:=]\s*["'][^"']+["']"""),
    ("connection", r"""["']?connectionstring["']?\s*[:=].*password\s*="""),
    ("api_key", r"""["']?apikey["']?\s*[:=]\s*["'][^"']+["']"""),
    ("secret", r"""["']?secret["']?\s*[:=]\s*["'][^"']+["']"""),
)
PLACEHOLDERS = ("${", "{{", "YOUR_", "REPLACE_")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".xml", ".config")

#: Sensitive files: name as a pattern, description, severity.
SENSITIVE_FILES = (
    (r".*\.pem", "Private key file", "Critical"),
    (r".*\.key", "Private key file", "Critical"),
    (r".*\.pfx", "Certificate with private key", "Critical"),
    (r".*\.p12", "Certificate with private key", "Critical"),
    (r"id_rsa", "SSH private key", "Critical"),
    (r"id_ed25519", "SSH private key", "Critical"),
    (r"\.env", "Environment file with potential secrets", "High"),
    (r".*\.env", "Environment file with potential secrets", "High"),
    (r"secrets\.json", "Secrets configuration file", "High"),
    (r"appsettings\..*\.json", "Configuration file - check for secrets", "Info"),
    (r"web\.config", "Configuration file - check for connection strings", "Info"),
)

#: Manifests: path as a pattern, notice.
MANIFESTS = (
    (r"package\.json", "package.json found. Run 'npm audit' to check for known vulnerabilities."),
    (r".*\.csproj", ".NET project files found. Use 'dotnet list package --vulnerable' to check for vulnerabilities."),
    (r"requirements\.txt", "requirements.txt found. Use 'pip-audit' or 'safety check' to check for vulnerabilities."),
)

#: Debt markers (case is ignored), empty catches and magic numbers.
DEBT_MARKER = r"\b(TODO|FIXME|HACK|XXX)\b"
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
MAGIC_NUMBER = r"(^|[^\w.])([2-9]\d+)\b"

#: Words, lower-cased, of which each match of a pattern has one; a text without them is not held against it.
_WORDS = {
    "sql_injection": tuple(q + w for q in "\"'" for w in ("select", "insert", "update", "delete")),
    "credential": ("password", "passwd", "pwd", "secret", "api", "token", "auth"),
    "weak_crypto": ("md5", "sha1", "des"),
    "weak_random": ("random",),
    "path_traversal": ("path.",),
    "command_injection": ("process.start",),
    "xss": ("innerhtml", "document.write(", ".html("),
    "deserialization": ("binaryformatter", "netdatacontractserializer", "objectstateformatter"),
    "debug_code": ("console.log(", "debug.writeline", "debugger;"),
    "tls_off": ("verify", "checkserveridentity"),
    "open_endpoint": ("[allowanonymous]", "[authorize"),
}
_CONFIG_WORDS = {"password": ("password",), "connection": ("connectionstring",), "api_key": ("apikey",), "secret": ("secret",)}
NEEDED = {r[1]: _WORDS[r[0]] for r in SECURITY_RULES} | {pattern: _CONFIG_WORDS[name] for name, pattern in CONFIG_RULES} | {DEBT_MARKER: ("todo", "fixme", "hack", "xxx")}

#: Types, methods and namespaces of C#.
TYPES = r"\b(class|struct|interface|record|enum)\s+\w+"
METHODS = r"\b(public|private|protected|internal)\s+(static\s+)?(async\s+)?[\w<>\[\],\s]+\s+\w+\s*\("
NAMESPACES = r"\bnamespace\s+[\w\.]+"

#: Themes of folders by words in their names.
THEMES = ((("service",), "Services"), (("controller",), "Controllers"), (("repository", "data"), "Data Access"), (("model", "entity"), "Models"), (("interface", "contract"), "Interfaces"), (("middleware",), "Middleware"), (("test", "spec"), "Tests"), (("util", "helper"), "Utilities"))

#: What is redacted; the e-mail pattern applies on demand.
BEARER, PAIR, EMAIL = r"Bearer\s+[a-zA-Z0-9\-_\.]+", r"(Password|Pwd|Secret|Key)=([^;]+)", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
REDACTED = "***REDACTED***"

#: Hosts that repositories are cloned from.
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "dev.azure.com")

#: Words of credentials in the simple heuristics, and lines with these are left out.
CREDENTIAL_WORDS, NO_CREDENTIAL = ("password", "secret", "apikey", "connectionstring"), ("string", "//", "todo")


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_case(subject: str, mapping: dict, default: str = "null", quote: bool = True) -> str:
    """A CASE that looks subject up; the same text in both SQL dialects."""
    return f"case {subject} " + " ".join(f"when '{k}' then {repr(v) if quote else v}" for k, v in mapping.items()) + f" else {default} end"

#: Advice for each agent: what is counted of its findings (all, high: High and Critical, medium, a category, or those
#: whose description has a word), above which number the advice is given, and its text.
AGENT_ADVICE = {
    "Security": (
        ("high", None, 0, "Address {n} high-severity security issue(s) immediately to reduce risk."),
        ("category", "Security", 2, "Consider implementing a security code review process to catch vulnerabilities early."),
        ("word", ("injection",), 0, "Use parameterized queries and input validation to prevent injection attacks."),
        ("word", ("authentication", "password"), 0, "Review authentication mechanisms and ensure secure password handling."),
    ),
    "CodeQuality": (
        ("all", None, 10, "Consider refactoring to reduce code complexity and improve maintainability."),
        ("category", "Performance", 0, "Profile the application to identify and optimize performance bottlenecks."),
        ("category", "Maintainability", 3, "Improve code documentation and add unit tests to enhance maintainability."),
        ("word", ("duplication",), 0, "Extract common code into reusable functions or classes to reduce duplication."),
    ),
    "ArchitectureAdvisor": (
        ("all", None, 0, "Review the overall architecture to ensure proper separation of concerns."),
        ("category", "Architecture", 2, "Consider adopting established design patterns to improve code organization."),
        ("word", ("dependency", "coupling"), 0, "Reduce coupling between components using dependency injection and interfaces."),
    ),
    "Structure": (
        ("all", None, 0, "Organize project files according to feature or layer-based structure."),
        ("word", ("naming",), 0, "Establish and follow consistent naming conventions across the codebase."),
    ),
}
#: Advice for any agent, behind its own, and for one without findings.
ADVICE_ANY = (("high", None, 5, "Prioritize fixing high-severity issues before adding new features."), ("medium", None, 10, "Schedule time to address medium-severity issues to prevent technical debt accumulation."))
ADVICE_NONE = "No issues found by {agent} agent. Keep up the good work!"
#: Metrics whose last value a health snapshot shows.
GAUGES = ("queue.length", "queue.dead_letter_length", "memory.peak_bytes", "disk.used_percent")
