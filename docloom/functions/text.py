"""Text columns: headers, paths, routes, globs, secret lines, languages. All run inside the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names by file ending.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby", "cs": "csharp",
    "sql": "sql", "sh": "shell", "tf": "terraform", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "properties": "properties", "css": "css", "md": "markdown", "mdx": "markdown",
}
HEADER = r"\A### FILE: ([^\r\n]*)\r?\n?"
SECRET_LINE = r"(?i)(password|passwd|secret|token|api[_-]?key)[A-Za-z_]*['\"]?[ \t]*[:=][ \t]*['\"]?[^ \t'\"]"
SCRUBBED = "[line removed]"


def header_path(text: Column) -> Column:
    """The path in a leading ``### FILE:`` line, or empty."""
    return F.trim(F.regexp_extract(text, HEADER, 1))


def strip_header(text: Column) -> Column:
    return F.regexp_replace(text, HEADER, "")


def tidy_path(path: Column) -> Column:
    """One spelling per path: no blanks around, forward slashes, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(\./)+", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(tidy_path(path), r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language of a file by its ending; ``text`` where unknown."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[ending(path)], F.lit("text"))


def fold(text: Column) -> Column:
    """Lower case, blanks joined, none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def strip_line(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def scrub(text: Column) -> Column:
    """Every line that assigns a secret is replaced as a whole."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(line.rlike(SECRET_LINE), F.lit(SCRUBBED)).otherwise(line)), "\n")


VERB = r"(?i)^\s*(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\s+(?=/)"


def route(path: Column) -> Column:
    """One spelling of a route: no verb, host, query or fragment; variables as ``{}``; lower case; a leading and no
    trailing slash (``/`` stays); empty for an empty one."""
    p = F.trim(F.regexp_replace(path, VERB, ""))
    p = F.regexp_replace(p, r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", "")
    p = F.regexp_replace(p, r"(?s)[?#].*$", "")
    p = F.regexp_replace(p, r"\$?\{[^}]*\}|<[^>]*>", "{}")
    p = F.regexp_replace(p, r"(?<=^|/):[A-Za-z_][A-Za-z0-9_]*(?=/|$)", "{}")
    p = F.regexp_replace(F.lower(p), r"/{2,}", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/+$", ""))
    return F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


@lru_cache(maxsize=1024)
def glob_regex(glob: str) -> str:
    """An anchored pattern: ``**/`` any or no folders, ``**`` anything, ``*`` within a folder, ``?`` one character of it."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(p) or re.sub(r"([.^$+(){}|\[\]\\])", r"\\\1", p) for p in parts) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """One alternation for all globs; no glob matches nothing."""
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def selected(path: Column, scope: list[str], exclude: list[str]) -> Column:
    """In scope (everything, where no scope is given) and not excluded."""
    wanted = matches_any(path, scope) if scope else F.lit(True)
    return wanted & ~matches_any(path, exclude)


def joint_scope(scopes: list[list[str] | None]) -> list[str]:
    """The globs of several pages together, each once, in order; a page without any covers everything, so the result
    then is empty, which ``selected`` reads as everything."""
    return list(dict.fromkeys(g for scope in scopes for g in scope)) if all(scopes) else []


def present(value: Column, number: bool = False) -> Column:
    """Neither null, nor empty, nor (a number) NaN; never null itself."""
    return value.isNotNull() & ~F.coalesce(F.isnan(value) if number else value == "", F.lit(False))


# Files and folders that hold secrets, endings of documents, and marks of what a document's reader must not pass on.
SENSITIVE_PATH = r"(?i)(^|/)(\.env(\..+)?$|[^/]*\.(pem|key|p12|pfx|keystore)$|id_(rsa|ed25519|ecdsa)$|credentials\.(json|ya?ml)$|service[-_]?account[^/]*\.json$|secrets?\.(json|ya?ml)$|secrets?/)"
DOCUMENT_PATH = r"(?i)\.(md|mdx|txt|csv|json|ya?ml)$"
SENSITIVE_TEXT = r"(?i)(classification[ \t]*:[^\n]*\b(restricted|confidential|secret)\b|internal use only|do not distribute|strictly confidential|confidential and proprietary)"


def sensitive(path: Column, content: Column | None = None) -> Column:
    """``path``, ``content`` or null: why a file is sensitive. Its path is that of secrets, or it is a document whose
    text is marked. Null paths and texts are not."""
    marked = F.lit(False) if content is None else path.rlike(DOCUMENT_PATH) & content.rlike(SENSITIVE_TEXT)
    return F.when(path.rlike(SENSITIVE_PATH), "path").when(marked, "content")


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clip(text: Column, length: int, marker: str = "…") -> Column:
    """At most ``length`` characters, with a marker where something was cut."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length - len(marker))), F.lit(marker))).otherwise(text)


def human_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``; empty for an empty list."""
    size = F.size(items)
    return F.when(size > 1, F.concat(F.array_join(F.slice(items, F.lit(1), size - 1), ", "), F.lit(" and "), F.element_at(items, -1))).when(size == 1, F.get(items, F.lit(0))).otherwise("")


def escape_html(text: Column) -> Column:
    """The five characters that HTML reserves."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
