"""Predicates and rewrites on paths and names that guard reading and writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that searches and learning skip.
IGNORED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".svn", ".eggs", ".mypy_cache", ".pytest_cache", ".ruff_cache")
#: Directories and names that scans skip.
SCAN_IGNORED_DIRS = (
    "node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", ".venv", "env", ".env", "dist", "build", "target", "out", ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache",
    ".tox", "vendor", "Pods", ".gradle", ".idea", ".vscode", ".vs", "bin", "obj",
)
SCAN_IGNORED_NAMES = (
    ".DS_Store", "Thumbs.db", "*.pyc", "*.pyo", "*.class", "*.o", "*.obj", "*.so", "*.dll", "*.dylib", "*.exe", "*.min.js", "*.min.css", "*.map", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock",
)
#: Paths of files that may hold secrets, whatever their case.
SENSITIVE = (
    r"\.env$", r"\.env\.[^/]+$", r"\.env\.local$", r"\.env\.production$", r"\.secret[s]?$", r"\.pem$", r"\.key$", r"\.p12$", r"\.pfx$", r"id_rsa$", r"id_dsa$", r"id_ed25519$", r"id_ecdsa$",
    r"credentials\.json$", r"credentials\.yaml$", r"credentials\.yml$", r"\.htpasswd$", r"\.netrc$", r"\.aws/credentials$", r"\.aws/config$", r"\.ssh/", r"authorized_keys$", r"known_hosts$",
    r"kubeconfig$", r"\.kube/config$", r"\.docker/config\.json$", r"\.sqlite$", r"\.db$", r"\.bash_history$", r"\.zsh_history$", r"\.history$",
)
#: Reasons in the order in which they are tried.
SENSITIVE_REASONS = (
    (r"\.env", "Environment file may contain secrets"),
    (r"\.(pem|key|p12|pfx)$", "Private key file"),
    (r"credentials\.(json|yaml|yml)$", "Credentials file"),
    (r"id_(rsa|dsa|ed25519|ecdsa)$", "SSH private key"),
    (r"\.aws/", "AWS configuration"),
    (r"\.ssh/", "SSH configuration"),
    (r"\.kube/|kubeconfig", "Kubernetes configuration"),
    (r"\.db$|\.sqlite$", "Database file"),
)
#: Device names that no file may have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{device}{k}" for device in ("COM", "LPT") for k in range(1, 10)))


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def _unix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_sensitive(path: Column) -> Column:
    return _unix(path).rlike(any_of(SENSITIVE))


def sensitivity_reason(path: Column) -> Column:
    """The first reason that fits, else null."""
    return F.coalesce(*[F.when(_unix(path).rlike("(?i)" + pattern), F.lit(reason)) for pattern, reason in SENSITIVE_REASONS])


def is_ignored(path: Column) -> Column:
    """A segment is an ignored directory or ends with .egg-info, or the file is sensitive."""
    parts = F.split(_unix(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | F.exists(parts, lambda p: p.endswith(".egg-info")) | is_sensitive(path)


def is_scan_ignored(path: Column) -> Column:
    """A segment is a scan-ignored directory, or the file's name is in the list or fits one of its wildcards."""
    parts = F.split(_unix(path), "/")
    name = F.element_at(parts, -1)
    plain = [n for n in SCAN_IGNORED_NAMES if "*" not in n]
    ends = [n.removeprefix("*") for n in SCAN_IGNORED_NAMES if n.startswith("*")]
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, SCAN_IGNORED_DIRS))) | name.isin(*plain)
    for end in ends:
        hit = hit | name.endswith(end)
    return hit


def escape_like(value: str) -> str:
    """Escape the wildcards of LIKE, with backslash as escape."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def escape_like_column(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\%_])", r"\\$1")


def escape_literal(value: Column) -> Column:
    """Double single quotes; prefer bind parameters."""
    return F.regexp_replace(value, "'", "''")


def sanitize_path(path: Column) -> Column:
    """Without leading tildes, '..' steps and NUL, with single separators."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^~+", ""), r"\.\.[\\/]?", "")
    return F.regexp_replace(F.regexp_replace(plain, "\\x00", ""), r"[\\/]+", "/")


def is_safe_filename(name: Column) -> Column:
    device = F.upper(F.substring_index(name, ".", 1))
    return ~(name.rlike(r"[/\\\x00]") | name.contains("..") | device.isin(*RESERVED_NAMES))


def clamp(value: int, low: int, high: int) -> int:
    """Limits are clamped when the plan is built."""
    return max(low, min(value, high))


#: Extensions and names of files that are watched as text.
TEXT_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "cs", "php", "rb", "swift", "kt", "scala", "clj", "hs", "ml", "fs", "elm", "dart", "r", "jl", "lua", "pl",
    "sh", "ps1", "sql", "html", "css", "scss", "sass", "less", "json", "xml", "yaml", "yml", "toml", "ini", "cfg", "conf", "md", "rst", "tex", "txt", "log",
)
TEXT_NAMES = (".gitignore", ".dockerignore", ".editorconfig", ".env", ".eslintrc", ".prettierrc", ".babelrc", ".npmrc", ".gitattributes", ".mailmap")


def is_text_file(path: Column) -> Column:
    """By extension, or by name for files that are all extension; whatever the case."""
    name = F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))
    return F.regexp_extract(name, r"[^.]\.([^.]+)$", 1).isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_NAMES)


def is_within(path: Column, roots: list[str] | None) -> Column:
    """Whether a resolved path is one of the roots or lies below one; without roots every path is, with none no path."""
    if roots is None:
        return F.lit(True)
    inside = F.lit(False)
    for root in roots:
        base = root.rstrip("/")
        inside = inside | (path == base) | path.startswith(base + "/")
    return inside


def safe_join(root: str, relative: Column) -> Column:
    """The path below the root, with '.' and '..' resolved; null where it is empty, holds NUL or would lead out of the root."""
    base = root.rstrip("/")
    absolute = F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit(base + "/"), relative))
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))
    full = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(absolute, "/"), F.array().cast("array<string>"), step), "/"))
    return F.when((relative != "") & ~relative.contains("\x00") & is_within(full, [base]), full)


def uri_to_relative(uri: Column, root: str) -> Column:
    """The path below the root of a file URI; the absolute path outside of it; anything else as it is."""
    path = F.substring(uri, 8, 1 << 30)
    base = root.rstrip("/") + "/"
    below = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    return F.when(uri.startswith("file://"), below).otherwise(uri)
