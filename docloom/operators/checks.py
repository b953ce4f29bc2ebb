"""Configuration keys, quoted headings found again, and checks of a page's text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import ending, fold, tidy_path
from docloom.operators.sections import rows_of
from docloom.session import spread, table, written

KEY = r"(?md)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*="
CALL = r"(?:(?:fetch|axios\.[a-z]+|requests\.[a-z]+|http\.(?:Get|Post|Put|Delete))\([ \t]*[\"'](?:https?://[^/\"'\s]+)?|curl[^\n]*?https?://[^/\s\"']+)(/[^\"'?#\s]*)"


def config_keys(spark, sf_dir: str) -> DataFrame:
    """Keys of assignment files (properties, environment, TOML) with the number of times each is set."""
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after is not null")
    path = tidy_path(F.col("filePath"))
    files = units.where(ending(F.col("filePath")).isin("properties", "toml", "env") | path.rlike(r"(^|/)\.env(\.[a-z]+)?$"))
    keys = files.select("change_id", F.explode(F.regexp_extract_all("after", F.lit(KEY), F.lit(1))).alias("key"))
    return keys.groupBy("change_id", "key").agg(F.count("*").alias("n"))


def yaml_keys(text: str) -> list[tuple[str]]:
    """Dotted paths of the keys of an indented file, in order; list items belong to their key, blocks of text
    and comments hold no keys."""
    out: list[tuple[str]] = []
    stack: list[tuple[int, str]] = []
    block = None
    for line in text.split("\n"):
        bare = line.strip()
        depth = len(line) - len(line.lstrip(" "))
        if block is not None and (not bare or depth > block):
            continue
        block = None
        if not bare or bare[0] in "#-[{\"'":
            continue
        m = re.match(r"([A-Za-z0-9_.\-/]+):(?:\s+(.*))?$", bare)
        if not m:
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, m[1]))
        out.append((".".join(k for _, k in stack),))
        if m[2] and re.match(r"[|>][+-]?\d?\s*(#.*)?$", m[2]):
            block = depth
    return out


def nested_keys(spark, sf_dir: str) -> DataFrame:
    """Key paths of indented configuration files."""
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after <> ''").where(ending(F.col("filePath")).isin("yaml", "yml"))
    schema = pa.schema([("change_id", pa.int64()), ("place", pa.int64()), ("key", pa.string())])
    return rows_of(units, ["change_id", "after"], yaml_keys, "change_id long, place long, key string", schema)


def called_paths(spark, sf_dir: str) -> DataFrame:
    """Paths that code or shell lines call over HTTP, per repository."""
    units = table(spark, sf_dir, "change_units").where("after is not null")
    calls = units.select("repo", F.explode(F.regexp_extract_all("after", F.lit(CALL), F.lit(1))).alias("path"))
    return calls.groupBy("repo", "path").agg(F.count("*").alias("calls"))


# What stands before a path literal in a call, endings of files that are no API, first folders that are none, and file endings of code that calls.
LITERAL = r"(?:^|[^A-Za-z0-9_.@])(@[A-Za-z0-9_.]+[ \t]*\([^\"'`()\r\n]*|[A-Za-z0-9_.]+[ \t]*\([ \t]*|\+[ \t]*)?[fF]?[\"'`]((?:\$\{[^}\"'`\r\n]*\}|\$[A-Za-z0-9_]+|\{[A-Za-z0-9_.]+\})?/[A-Za-z0-9_\-./{}:$<>?=&%,~@+]*)[\"'`]([ \t]*\+)?"
BASE = r"^(?:\$\{[^}]*\}|\$[A-Za-z0-9_]+|\{[A-Za-z0-9_.]+\})"
ASSET = r"(?i)\.(?:js|mjs|css|map|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|html?|txt|xml|pdf|md|json|ya?ml|properties|java|kt|py)$"
NO_API = r"(?i)^/(?:usr|etc|var|tmp|home|opt|dev|proc|bin|static|assets|images|img|css|js|fonts|node_modules|public|favicon\.ico)/"
API = r"(?i)^/(?:api|rest|v[0-9]+)(?:/|$)"
ONLY_BASE = r"(?i)^(?:/+(?:api|rest|v[0-9]+))+$"
HTTP = r"(?i)(?:^|\.)(?:fetch|axios|http|https|api|client|request|requests|httpx|session|uri|path|get|post|put|patch|delete|exchange|getfor|postfor|retrieve)[A-Za-z0-9_]*[ \t]*\([ \t]*$"
SERVES = r"(?:^|\.)(?:app|router|server)\.(?:get|post|put|patch|delete|all|use)[ \t]*\([ \t]*$"
CALLERS = ("java", "kt", "js", "jsx", "mjs", "cjs", "ts", "tsx", "py")


def client_paths(units: DataFrame) -> DataFrame:
    """(repo, path, units): the API paths that code requests. A literal counts that has two segments or more beyond a
    variable base, is no asset, no file of the system and not only a base path, and either begins like an API or is
    the argument of an HTTP call. Pieces of a concatenation are no calls, and routes that the code serves itself
    (annotations, router calls) aren't either. Null and empty texts call nothing."""
    code = units.where("kind = 'code' and after <> ''").where(ending(F.col("filePath")).isin(*CALLERS))
    met = code.select("repo", "change_id", F.explode(F.array_distinct(F.regexp_extract_all("after", F.lit("(?md)" + LITERAL), F.lit(0)))).alias("m"))
    part = lambda n: F.regexp_extract("m", LITERAL, n)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(2), BASE, ""), r"[?#].*$", ""), r"/+$", "")
    cut = met.select("repo", "change_id", part(1).alias("lead"), part(3).alias("more"), path.alias("path"))
    whole = cut.where("more = '' and lead not like '+%' and lead not like '@%'").where(~F.col("lead").rlike(SERVES))
    paths = whole.where(F.col("path").rlike("^/[^/]+/+[^/]") & ~F.col("path").rlike(ASSET) & ~F.col("path").rlike(NO_API) & ~F.col("path").rlike(ONLY_BASE))
    return paths.where(F.col("path").rlike(API) | F.col("lead").rlike(HTTP)).groupBy("repo", "path").agg(F.countDistinct("change_id").alias("units"))


def called_routes(spark, sf_dir: str) -> DataFrame:
    return client_paths(table(spark, sf_dir, "change_units"))


#: Characters of quotes that one automaton is built from; more quotes mean further scans of the texts.
BLOCK_CHARS = 4_000_000


def grounded(quotes: DataFrame, texts: DataFrame, group: str, quote: str, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(group, quote, first, texts): quotes with the texts of their group that contain them, blanks and case
    aside; the first by key, and how many. Quotes of letters or digits only by the block go to every task as one
    automaton, which reads each text once; the texts stay where they are."""
    word = r"[\p{L}\p{N}_]"
    q = written(quotes.select(F.col(group).cast("string").alias("g"), F.col(quote).alias("quote"), fold(F.col(quote)).alias("q")).where(F.col("q").rlike(word)).distinct())
    t = texts.select(F.col(group).cast("string").alias("g"), F.col(key).cast("long").alias("key"), fold(F.col(text)).alias("t")).where("t <> ''")
    size = q.agg(F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // block_chars))
    out = None
    for block in range(count):
        shared = quotes.sparkSession.sparkContext.broadcast([tuple(r) for r in q.where(F.pmod(F.xxhash64("q"), F.lit(count)) == block).collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[tuple[str, str]]] = {}
            for g, said, folded in shared.value:
                held.setdefault(folded, []).append((g, said))
            known = ahocorasick.Automaton()
            for folded, where in held.items():
                known.add_word(folded, (folded, where))
            if held:
                known.make_automaton()
            for b in batches:
                found = []
                for g, k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    met = {folded: where for _, (folded, where) in known.iter(x)} if held else {}
                    found += [(g, said, k) for where in met.values() for other, said in where if other == g]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], type=x) for n, x in enumerate((pa.string(), pa.string(), pa.int64()))], names=["g", "quote", "key"])

        part = spread(t).mapInArrow(run, "g string, quote string, key long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("g").alias(group), "quote").agg(F.min("key").alias("first"), F.count("*").alias("texts"))


def grounded_headings(spark, sf_dir: str) -> DataFrame:
    """Headings of stored chunks that documents of the repository hold."""
    points = table(spark, sf_dir, "vector_points").where("heading is not null and repo is not null")
    docs = table(spark, sf_dir, "documents").where("text is not null and repo is not null")
    return grounded(points, docs, "repo", "heading", "doc_id", "text")


def page_checks(spark, sf_dir: str) -> DataFrame:
    """What is wrong with a new page's text, in a fixed order; empty where nothing is."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and after is not null")
    size, old = F.length("after"), F.length(F.coalesce("existing", F.lit("")))
    reasons = [
        F.when(size < 200, "short"), F.when(size > 120_000, "long"), F.when(F.regexp_count("after", F.lit(r"(?md)^(?:```|~~~)")) % 2 == 1, "open fence"),
        F.when(F.regexp_count("after", F.lit(r"(?md)^#{1,6} ")) == 0, "no heading"), F.when((old > 400) & ((size < 0.25 * old) | (size > 4 * old)), "size"),
    ]
    return units.select("change_id", F.array_join(F.filter(F.array(*reasons), lambda r: r.isNotNull()), ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (config_keys, nested_keys, called_paths, called_routes, grounded_headings, page_checks)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_FOLD = "trim(regexp_replace(lower({}), '[ \\t\\r\\n]+', ' ', 'g'))"
_sql = lambda pattern: pattern.replace("'", "''")
SQL = {
    "config_keys": rf"WITH u AS (SELECT change_id, after, {_PATH.format('filePath')} AS p FROM change_units WHERE kind = 'code' AND after IS NOT NULL) SELECT change_id, key, count(*) AS n FROM (SELECT change_id, unnest(regexp_extract_all(after, '(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=', 1)) AS key FROM u WHERE regexp_matches(lower(p), '\.(properties|toml|env)$') OR regexp_matches(p, '(^|/)\.env(\.[a-z]+)?$')) GROUP BY 1, 2",
    "called_paths": f"SELECT repo, path, count(*) AS calls FROM (SELECT repo, unnest(regexp_extract_all(after, '{CALL.replace(chr(39), chr(39) * 2)}', 1)) AS path FROM change_units WHERE after IS NOT NULL) GROUP BY 1, 2",
    "called_routes": rf"""WITH m AS (SELECT repo, change_id, unnest(list_distinct(regexp_extract_all(after, '(?m){_sql(LITERAL)}', 0))) AS m FROM change_units
        WHERE kind = 'code' AND after <> '' AND lower(regexp_extract(trim(filePath), '\.([A-Za-z0-9]+)$', 1)) IN {CALLERS}),
        c AS (SELECT repo, change_id, regexp_extract(m, '{_sql(LITERAL)}', 1) AS lead, regexp_extract(m, '{_sql(LITERAL)}', 3) AS more, regexp_replace(regexp_replace(regexp_replace(regexp_extract(m, '{_sql(LITERAL)}', 2), '{BASE}', ''), '[?#].*$', ''), '/+$', '') AS path FROM m)
        SELECT repo, path, count(DISTINCT change_id) AS units FROM c WHERE more = '' AND NOT starts_with(lead, '+') AND NOT starts_with(lead, '@') AND NOT regexp_matches(lead, '{SERVES}')
        AND regexp_matches(path, '^/[^/]+/+[^/]') AND NOT regexp_matches(path, '{ASSET}') AND NOT regexp_matches(path, '{NO_API}') AND NOT regexp_matches(path, '{ONLY_BASE}') AND (regexp_matches(path, '{API}') OR regexp_matches(lead, '{HTTP}')) GROUP BY 1, 2""",
    "grounded_headings": f"WITH q AS (SELECT DISTINCT repo, heading AS quote, {_FOLD.format('heading')} AS q FROM vector_points WHERE heading IS NOT NULL AND repo IS NOT NULL), d AS (SELECT repo, doc_id, {_FOLD.format('text')} AS t FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL) SELECT q.repo, q.quote, min(doc_id) AS first, count(*) AS texts FROM q JOIN d ON d.repo = q.repo AND contains(d.t, q.q) WHERE regexp_matches(q.q, '[\\p{{L}}\\p{{N}}_]') GROUP BY 1, 2",
    "page_checks": "SELECT change_id, concat_ws(',', CASE WHEN length(after) < 200 THEN 'short' END, CASE WHEN length(after) > 120000 THEN 'long' END, CASE WHEN len(regexp_extract_all(after, '(?m)^(?:```|~~~)')) % 2 = 1 THEN 'open fence' END, CASE WHEN len(regexp_extract_all(after, '(?m)^#{1,6} ')) = 0 THEN 'no heading' END, CASE WHEN length(coalesce(existing, '')) > 400 AND (length(after) < 0.25 * length(existing) OR length(after) > 4 * length(existing)) THEN 'size' END) AS reasons FROM change_units WHERE kind = 'docs' AND after IS NOT NULL",
}
