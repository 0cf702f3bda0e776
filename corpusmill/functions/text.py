"""Column expressions over paths, texts, questions and URLs (P1-P12). All run inside Catalyst; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Names of languages, words of intents and question kinds, kinds of paths.
LANGUAGE_ALIASES = {
    "py": "Python", "python": "Python", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "jsx": "JavaScript (React JSX)", "go": "Go", "java": "Java", "rb": "Ruby", "rs": "Rust", "c": "C", "cpp": "C++", "c++": "C++", "cs": "C#", "c#": "C#", "php": "PHP",
    "kt": "Kotlin", "swift": "Swift", "scala": "Scala", "sh": "Shell", "bash": "Shell", "sql": "SQL", "md": "Markdown", "yml": "YAML", "yaml": "YAML", "json": "JSON",
}
CHAT_INTENTS = {
    "architecture": ("architecture", "design", "components", "module", "flow", "dependency"),
    "setup": ("setup", "install", "run", "start", "configure", "env", "docker", "deploy"),
    "debug": ("bug", "error", "failing", "exception", "debug", "issue", "fix", "broken"),
    "security": ("auth", "token", "permission", "secret", "security", "csrf", "oauth"),
}
DIFF_INTENTS = {
    "security": ("security", "auth", "secret", "token", "vulnerab", "risk", "credential", "password"),
    "architecture": ("architecture", "design", "structure", "coupling"),
    "debug": ("break", "broke", "fail", "bug", "regress", "impact", "affect", "caller"),
}
LANGUAGE_QUESTIONS = ("language", "languages", "tech stack", "stack", "what is this built with", "what is this written in")
SUMMARY_QUESTIONS = ("summarize", "summary", "high-level", "high level", "overview", "purpose", "core modules", "runtime flow", "output format")
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "go.mod", "cargo.toml")
DOCKER_FILES = ("dockerfile", "docker-compose.yml", "docker-compose.yaml")
ENTRY_POINTS = ("/main.", "/index.", "/app.", "/server.", "/cli.")
SOURCE_DIRS = ("/src/", "/app/", "/lib/", "/core/", "/services/", "/components/")


#: A word boundary among ASCII letters, digits and underscores; Java's own also knows other letters.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """The pattern with each \\b meaning an ASCII boundary."""
    return pattern.replace(r"\b", BOUNDARY)


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def language_tag(path: Column) -> Column:
    """The lower suffix without its dot, else the lower file name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(suffix != "", suffix).otherwise(name)


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line break; an empty text has none, a final break adds none."""
    lines = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def normalize_language(raw: Column) -> Column:
    """P3"""
    trimmed = F.trim(raw)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    return F.when(trimmed != "", F.coalesce(F.try_element_at(table, F.lower(trimmed)), trimmed))


def first_intent(text: Column, intents: dict[str, tuple[str, ...]]) -> Column:
    """The first intent with a word that the lower text holds, else general."""
    found = F.lit("general")
    for name, words in reversed(intents.items()):
        found = F.when(F.lower(text).rlike(any_of(words)), name).otherwise(found)
    return found


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """P5"""
    return F.coalesce(F.lower(text).rlike(any_of(words)), F.lit(False))


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0)


def tokens(text: Column) -> Column:
    """Distinct tokens in order of appearance."""
    return F.array_distinct(all_tokens(text))


def canonical_urls(urls: DataFrame, url: str = "url", host: str = r"github\.com") -> DataFrame:
    """Canonical repository URLs, each once; rows that are none are left out. host: a regular expression."""
    parts = rf"(?i)^(https?)://({host})/([^/?#]+)/([^/?#]+)(?:[/?#].*)?$"
    owner, name = F.regexp_extract(url, parts, 3), F.regexp_replace(F.regexp_extract(url, parts, 4), r"\.git$", "")
    site = F.lower(F.regexp_extract(url, parts, 2))
    return urls.where(F.col(url).rlike(parts)).select(F.concat(F.lit("https://"), site, F.lit("/"), owner, F.lit("/"), name).alias("canonical"), F.concat(owner, F.lit("/"), name).alias("full_name")).distinct()


def rejected_urls(urls: DataFrame, url: str = "url", host: str = r"github\.com") -> DataFrame:
    return urls.where(F.col(url).isNull() | ~F.col(url).rlike(rf"(?i)^https?://{host}/[^/?#]+/[^/?#]+(?:[/?#].*)?$"))


#: White space as Python's str knows it, spelled for Java and RE2 alike.
SPACES = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")


def one_line(text: Column) -> Column:
    """The text with each run of white space as one space, without those at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def content_hash(text: Column) -> Column:
    """P9"""
    return F.sha2(text, 256)


def path_weight(path: Column) -> Column:
    """P10: readme 0, manifests 1, docker 2, entry points 3, source folders 4, others 5."""
    p = F.lower(path)
    quoted = lambda names: "(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")"
    return F.when(p.endswith("readme.md"), 0).when(p.rlike(quoted(MANIFESTS) + "$"), 1).when(p.rlike(quoted(DOCKER_FILES) + "$"), 2).when(p.rlike(quoted(ENTRY_POINTS)), 3).when(p.rlike(quoted(SOURCE_DIRS)), 4).otherwise(5)


def is_test_path(path: Column) -> Column:
    """P11"""
    p = F.lower(path)
    return p.contains("/tests/") | p.startswith("tests/") | p.contains("test_")


def client_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Telemetry JSON to typed columns with defaults; rows that don't parse are left out (see rejected_events)."""
    v = F.try_parse_json(payload)
    text = lambda name, default: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default))
    number = F.when(F.schema_of_variant(F.variant_get(v, "$.duration_ms", "variant")).rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.duration_ms", "double"))
    metadata = F.coalesce(F.to_json(F.try_variant_get(v, "$.metadata", "variant")), F.lit("{}"))
    kept = raw.where(v.isNotNull())
    return kept.select("*", text("event", "unknown").alias("event"), text("route", "").alias("route"), text("message", "").alias("message"), number.alias("duration_ms"), F.when(metadata == "null", "{}").otherwise(metadata).alias("metadata"))


def rejected_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    return raw.where(F.try_parse_json(payload).isNull())
