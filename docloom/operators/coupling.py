"""Which documents and claims depend on which symbols and routes: inverted indexes joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import ending, matches_any, route, selected, tidy_path
from docloom.session import table, written

# What a language shows to others, by file ending; the first group is the name.
PUBLIC = {
    "export": (["js", "ts"], r"(?md)^export +(?:default +)?(?:async +)?(?:function|class|const|let|interface|type|enum) +([A-Za-z_][A-Za-z0-9_]*)"),
    "func": (["go"], r"(?md)^func +(?:\([^)\n]*\) *)?([A-Z][A-Za-z0-9_]*)"),
    "type": (["go"], r"(?md)^type +([A-Z][A-Za-z0-9_]*)"),
    "def": (["py"], r"(?md)^(?:async +)?(?:def|class) +([A-Za-z][A-Za-z0-9_]*)"),
    "class": (["java"], r"(?md)^ *public +(?:static +|final +|abstract +)*(?:class|interface|enum) +([A-Za-z_][A-Za-z0-9_]*)"),
    "method": (["java"], r"(?md)^ *public +[A-Za-z0-9_<>, \[\]]+ ([A-Za-z_][A-Za-z0-9_]*)\("),
    "model": (["sql"], r"(?md)^CREATE TABLE +([A-Za-z_][A-Za-z0-9_]*)"),
}
CONFIG = r"(?:Getenv\(|getenv\(|process\.env\.|environ(?:\.get)?[\[(])[\"']?([A-Z][A-Z0-9_]+)"
TOKEN = r"([A-Za-z_][A-Za-z0-9_]{3,})"
ROUTE = r"(/v[0-9]+/[A-Za-z0-9_{}/:-]*[A-Za-z0-9_}])"


def _named(kind: str, pattern: str) -> Column:
    """An array of (kind, name) of all matches."""
    return F.transform(F.regexp_extract_all("after", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def symbols(units: DataFrame) -> DataFrame:
    """(repo, path, kind, name), distinct: public names of each code file, in one pass over the texts."""
    x = ending(F.col("filePath"))
    found = [F.when(x.isin(endings), _named(kind, pattern)) for kind, (endings, pattern) in PUBLIC.items()] + [_named("config", CONFIG)]
    code = units.where("kind = 'code' and after is not null")
    rows = code.select("repo", tidy_path(F.col("filePath")).alias("path"), F.explode(F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))).alias("s"))
    return rows.select("repo", "path", "s.kind", "s.name").distinct()


def public_symbols(spark, sf_dir: str) -> DataFrame:
    return symbols(table(spark, sf_dir, "change_units"))


def coupling_stats(spark, sf_dir: str) -> DataFrame:
    return public_symbols(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("symbols"), F.countDistinct("kind").alias("kinds"))


#: So many names, about 50 bytes each, are broadcast.
SHARED = 500_000


def doc_references(spark, sf_dir: str) -> DataFrame:
    """(symbol, doc_repo, doc_path): documents that mention a public name of at least four characters. Up to
    ``SHARED`` names go to every task, so only words that are names are exchanged; beyond, words made distinct per
    document meet the names by an ordinary join."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = docs.select(F.col("repo").alias("doc_repo"), F.col("path").alias("doc_path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)))).alias("symbol"))
    names = written(public_symbols(spark, sf_dir).where("length(name) >= 4").select(F.col("name").alias("symbol")).distinct())
    return words.join(F.broadcast(names) if names.count() <= SHARED else names, "symbol", "left_semi").distinct()


def foreign_references(spark, sf_dir: str) -> DataFrame:
    """Documents per repository and symbol kind that mention a name of it, without its own documents."""
    owned = public_symbols(spark, sf_dir).select("repo", "kind", F.col("name").alias("symbol")).distinct()
    met = owned.join(doc_references(spark, sf_dir), "symbol").where(F.col("doc_repo") != F.col("repo"))
    pages = met.select("repo", "kind", "doc_repo", "doc_path").distinct()
    return pages.groupBy("repo", "kind").agg(F.count("*").alias("docs"))


def found_routes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ROUTE), F.lit(1)), route))


def route_links(spark, sf_dir: str) -> DataFrame:
    """Routes that both documents and claims name: how many of each. Both sides are normalised, so the match
    is an equality, and counted before they meet."""
    docs = table(spark, sf_dir, "documents").select(F.explode(found_routes(F.col("text"))).alias("route")).groupBy("route").agg(F.count("*").alias("docs"))
    claims = table(spark, sf_dir, "claims").select(F.explode(found_routes(F.col("claim"))).alias("route")).groupBy("route").agg(F.count("*").alias("claims"))
    return docs.join(claims, "route", "full_outer").select("route", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("claims", F.lit(0)).alias("claims"))


def undocumented_routes(spark, sf_dir: str) -> DataFrame:
    """Routes of documents by repository that no approved claim of that repository names."""
    provided = table(spark, sf_dir, "documents").where("repo is not null").select("repo", F.explode(found_routes(F.col("text"))).alias("route")).distinct()
    known = table(spark, sf_dir, "claims").where("approved").select("repo", F.explode(found_routes(F.col("claim"))).alias("route"))
    return provided.join(known, ["repo", "route"], "left_anti")


def documented_symbols(spark, sf_dir: str) -> DataFrame:
    """Public names that claims of any repository have as a word, case aside, with the number of claims."""
    words = table(spark, sf_dir, "claims").select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("([a-z_][a-z0-9_]{3,})"), F.lit(1)))).alias("word"))
    names = public_symbols(spark, sf_dir).where("length(name) >= 4").select(F.lower("name").alias("word")).distinct()
    return words.join(names, "word").groupBy("word").agg(F.count("*").alias("claims"))


# Parameters of the selection below.
SCOPE, EXCLUDE = ["src/**", "lib/**", "services/**/*.py", "**/*.go"], ["**/generated/**", "**/*.min.js", "vendor/**", "**/vend?rs/**"]


def selected_files(spark, sf_dir: str) -> DataFrame:
    """Facts per repository whose source file is in scope and not excluded, and those that are excluded."""
    path = tidy_path(F.col("source_path"))
    facts = table(spark, sf_dir, "repo_facts").where("source_path <> '' and not startswith(source_path, '@')")
    return facts.groupBy("repo").agg(F.count_if(selected(path, SCOPE, EXCLUDE)).alias("chosen"), F.count_if(matches_any(path, EXCLUDE)).alias("excluded"))


def superseded(spark, sf_dir: str) -> DataFrame:
    """Earlier changes of a page whose changed files are all among those of a later one, with the last such.
    A set that holds all files of another holds its rarest one: candidates are found over an inverted list of
    that file only, per repository and page, and each distinct set stands once in the lists."""
    units = table(spark, sf_dir, "change_units").where("size(changedFiles) > 0").select("repo", tidy_path(F.col("filePath")).alias("path"), "change_id", F.array_sort(F.array_distinct("changedFiles")).alias("files"))
    lists = units.groupBy("repo", "path", "files").agg(F.max("change_id").alias("last")).select("repo", "path", F.explode("files").alias("file"), F.col("files").alias("more"), "last")
    lengths = lists.groupBy("repo", "path", "file").agg(F.count("*").alias("n"))
    own = units.select("repo", "path", "change_id", "files", F.explode("files").alias("file")).join(lengths, ["repo", "path", "file"])
    rarest = own.groupBy("repo", "path", "change_id").agg(F.min_by(F.struct("file", "files"), F.struct("n", "file")).alias("r")).select("repo", "path", "change_id", "r.file", "r.files")
    met = rarest.join(lists, ["repo", "path", "file"]).where("change_id < last").where(F.size(F.array_except("files", "more")) == 0)
    return met.groupBy("change_id").agg(F.max("last").alias("by_change"))


def linked_files(spark, sf_dir: str) -> DataFrame:
    """Links between files that change together, with the number of changes: each file of a change is linked to
    its first one. That star connects the same files as all pairs would, with one row per file."""
    files = table(spark, sf_dir, "change_units").where("size(changedFiles) > 1").select("repo", "change_id", F.array_sort(F.array_distinct(F.transform("changedFiles", tidy_path))).alias("f"))
    star = files.select("repo", "change_id", F.get("f", F.lit(0)).alias("a"), F.explode("f").alias("b")).where("a <> b")
    return star.groupBy("repo", "a", "b").agg(F.count("*").alias("changes"))


QUERIES = {f.__name__: f for f in (public_symbols, coupling_stats, doc_references, foreign_references, route_links, undocumented_routes, documented_symbols, selected_files, superseded, linked_files)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_END = rf"lower(regexp_extract({_PATH.format('filePath')}, '\.([A-Za-z0-9]+)$', 1))"
_SYMBOLS = "SELECT DISTINCT repo, path, kind, name FROM (" + " UNION ALL ".join(
    [f"SELECT repo, {_PATH.format('filePath')} AS path, '{k}' AS kind, unnest(regexp_extract_all(after, '{p.replace('(?md)', '(?m)')}', 1)) AS name FROM change_units WHERE kind = 'code' AND {_END} IN ({', '.join(repr(e) for e in es)})" for k, (es, p) in PUBLIC.items()]
    + [f"SELECT repo, {_PATH.format('filePath')}, 'config', unnest(regexp_extract_all(after, '{CONFIG.replace(chr(39), chr(39) * 2)}', 1)) FROM change_units WHERE kind = 'code'"]
) + ")"
_ROUTES = (
    "list_distinct(list_transform(regexp_extract_all({}, '" + ROUTE + r"', 1), lambda p: regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split(regexp_replace(p, '\$?\{[^}]*\}', '{{}}', 'g'), '/'), lambda g: CASE WHEN regexp_full_match(g, ':[A-Za-z_][A-Za-z0-9_]*') THEN '{{}}' ELSE g END), '/')), '/{{2,}}', '/', 'g'), '/$', '')))"
).replace("{{}}", "\0").replace("{{2,}}", "\1")


def _routes(column: str) -> str:
    return _ROUTES.replace("{}", column, 1).replace("\0", "{}").replace("\1", "{2,}")


_REFS = f"WITH s AS ({_SYMBOLS}), w AS (SELECT DISTINCT repo AS doc_repo, path AS doc_path, unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS symbol FROM documents) SELECT symbol, doc_repo, doc_path FROM w WHERE symbol IN (SELECT name FROM s WHERE length(name) >= 4)"
SQL = {
    "public_symbols": _SYMBOLS,
    "coupling_stats": f"SELECT repo, count(*) AS symbols, count(DISTINCT kind) AS kinds FROM ({_SYMBOLS}) GROUP BY repo",
    "doc_references": _REFS,
    "foreign_references": f"WITH o AS (SELECT DISTINCT repo, kind, name FROM ({_SYMBOLS})), r AS ({_REFS}) SELECT repo, kind, count(*) AS docs FROM (SELECT DISTINCT o.repo, o.kind, r.doc_repo, r.doc_path FROM o JOIN r ON r.symbol = o.name WHERE r.doc_repo <> o.repo) GROUP BY 1, 2",
    "route_links": f"WITH d AS (SELECT route, count(*) AS docs FROM (SELECT unnest({_routes('text')}) AS route FROM documents) GROUP BY 1), c AS (SELECT route, count(*) AS claims FROM (SELECT unnest({_routes('claim')}) AS route FROM claims) GROUP BY 1) SELECT route, coalesce(docs, 0) AS docs, coalesce(claims, 0) AS claims FROM d FULL JOIN c USING (route)",
    "undocumented_routes": f"WITH p AS (SELECT DISTINCT repo, unnest({_routes('text')}) AS route FROM documents WHERE repo IS NOT NULL), k AS (SELECT repo, unnest({_routes('claim')}) AS route FROM claims WHERE approved) SELECT repo, route FROM p ANTI JOIN k USING (repo, route)",
    "documented_symbols": f"WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(claim), '([a-z_][a-z0-9_]{{3,}})', 1)) AS word FROM claims) SELECT word, count(*) AS claims FROM w WHERE word IN (SELECT lower(name) FROM ({_SYMBOLS}) WHERE length(name) >= 4) GROUP BY 1",
    "selected_files": rf"""WITH f AS (SELECT repo, {_PATH.format('source_path')} AS p FROM repo_facts WHERE source_path <> '' AND NOT starts_with(source_path, '@')),
        m AS (SELECT repo, regexp_matches(p, '^src/.*$|^lib/.*$|^services/(?:.*/)?[^/]*\.py$|^(?:.*/)?[^/]*\.go$') AS s, regexp_matches(p, '^(?:.*/)?generated/.*$|^(?:.*/)?[^/]*\.min\.js$|^vendor/.*$|^(?:.*/)?vend[^/]rs/.*$') AS x FROM f)
        SELECT repo, count(*) FILTER (WHERE s AND NOT x) AS chosen, count(*) FILTER (WHERE x) AS excluded FROM m GROUP BY repo""",
    "superseded": f"WITH u AS (SELECT repo, {_PATH.format('filePath')} AS path, change_id, changedFiles AS f FROM change_units WHERE len(changedFiles) > 0) SELECT a.change_id, max(b.change_id) AS by_change FROM u a JOIN u b ON a.repo = b.repo AND a.path = b.path AND a.change_id < b.change_id WHERE list_has_all(b.f, a.f) GROUP BY 1",
    "linked_files": f"WITH x AS (SELECT DISTINCT repo, change_id, {_PATH.format('f')} AS f FROM (SELECT repo, change_id, unnest(changedFiles) AS f FROM change_units WHERE len(changedFiles) > 1)), m AS (SELECT *, min(f) OVER (PARTITION BY change_id) AS a FROM x) SELECT repo, a, f AS b, count(*) AS changes FROM m WHERE a <> f GROUP BY 1, 2, 3",
}
