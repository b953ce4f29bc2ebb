"""Texts put together and taken apart: front matter, target paths, templates, identifiers, references, links."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import slug, tidy_path
from docloom.operators.coupling import _REFS, _SYMBOLS, doc_references, public_symbols
from docloom.session import table

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def clean(text: Column) -> Column:
    """Without control characters; tabs and line ends stay."""
    return F.regexp_replace(text, CONTROL, "")


def join_path(*parts: Column) -> Column:
    """Parts joined by single slashes, empty ones left out, with a leading slash."""
    bare = [F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "") for p in parts]
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(*bare), lambda p: p != ""), "/"))


def target_path(path: Column, root: str, folder: Column) -> Column:
    """Where a page of a file goes: its folder below the root, its own path with dashes and a page's ending."""
    name = F.concat(F.regexp_replace(F.regexp_replace(tidy_path(path), r"\.[A-Za-z0-9]+$", ""), "[^A-Za-z0-9._-]+", "-"), F.lit(".md"))
    return F.array_join(F.filter(F.array(F.lit(root), folder, name), lambda p: F.coalesce(p, F.lit("")) != ""), "/")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{{NAME}}`` replaced by its value, null as nothing; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def with_front_matter(text: Column, title: Column, repo: Column, commit: Column) -> Column:
    """The page with a new leading block in place of any it had."""
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n", "")
    field = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", field("title", title), field("repo", repo), field("repo_commit", commit)), F.lit("\n---\n"), body)


def policy_version(policy: dict) -> str:
    """``v1-`` and eight digits of a policy's canonical JSON."""
    return "v1-" + hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def unit_parts(unit: Column) -> Column:
    """(repo, commit, page) of ``<repo>@<commit>:<page>``; nulls where it is not of that form."""
    part = lambda i: F.nullif(F.regexp_extract(unit, r"(?s)\A([^@]+)@([^:]+):(.+)\z", i), F.lit(""))
    return F.struct(part(1).alias("repo"), part(2).alias("commit"), part(3).alias("page"))


def body_parts(body: Column) -> Column:
    """(repo, sha, pages) of a request's description."""
    pages = F.regexp_extract_all(body, F.lit(r"(?md)^[ \t]*[-*][ \t]+`?([^`\s]+\.mdx?)`?"), F.lit(1))
    return F.struct(F.regexp_extract(body, r"(?i)source:?[ \t]+`?([\w.-]+/[\w.-]+)", 1).alias("repo"), F.regexp_extract(body, r"\b([0-9a-f]{7,40})\b", 1).alias("sha"), F.array_distinct(pages).alias("pages"))


def folder_spec(instructions: Column) -> Column:
    """The folder that instructions name, or empty."""
    return F.regexp_extract(instructions, r"(?im)^[ \t]*(?:target )?folder:[ \t]*`?([\w./-]+)", 1)


def declared(links: DataFrame, most: int = 10) -> DataFrame:
    """(repo, other): the first ``most`` sound links of each repository, in their order (``at``)."""
    sound = links.where(F.col("other").rlike(r"^\s*[\w.-]+/[\w.-]+\s*$")).select("repo", F.trim("other").alias("other"), "at")
    return sound.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("at"))).where(F.col("r") <= most).select("repo", "other", "at")


def closure(links: DataFrame, most: int = 10) -> DataFrame:
    """(repo, other): declared links in both directions, each once, no repository with itself, the repository's own
    first, at most twice ``most``."""
    own = declared(links, most).select("repo", "other", F.lit(0).alias("way"), "at")
    back = own.select(F.col("other").alias("repo"), F.col("repo").alias("other"), F.lit(1).alias("way"), "at")
    once = own.unionByName(back).where("repo <> other").groupBy("repo", "other").agg(F.min(F.struct("way", "at")).alias("p"))
    order = Window.partitionBy("repo").orderBy("p.way", "p.at", "other")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * most).select("repo", "other")


def consumers(links: DataFrame, roles: DataFrame, most: int = 10) -> DataFrame:
    """(repo, other): linked repositories that may call a repository, none where it is a consumer only. A role that
    is missing is ``both``."""
    role = lambda key, name: roles.select(F.col("repo").alias(key), F.col("role").alias(name))
    met = closure(links, most).join(role("repo", "own"), "repo", "left").join(role("other", "theirs"), "other", "left")
    return met.where("coalesce(own, 'both') <> 'consumer' and coalesce(theirs, 'both') in ('consumer', 'both')").select("repo", "other")


def link_warnings(config: DataFrame, most: int = 10) -> DataFrame:
    """(repo, warning, detail) of a configuration (repo, links array, links_is_list, contract_is_object, role, gate): the nine
    things that can be wrong with links, roles and gates."""
    rows = config.withColumn("links", F.when(F.col("links_is_list"), F.coalesce("links", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    entry = rows.select("repo", F.posexplode(F.slice("links", 1, most)).alias("at", "raw")).select("repo", "at", "raw", F.trim("raw").alias("other"), F.trim("raw").rlike(r"^[\w.-]+/[\w.-]+$").alias("sound"))
    warn = lambda df, name, detail: df.select("repo", F.lit(name).alias("warning"), detail.cast("string").alias("detail"))
    good = entry.where("sound and other <> repo")
    known = rows.select(F.col("repo").alias("other"))
    mirrored = good.alias("a").join(good.select(F.col("other").alias("repo_"), F.col("repo").alias("other_")).distinct(), (F.col("repo") == F.col("repo_")) & (F.col("other") == F.col("other_"))).where("repo < other").select("repo", "other").distinct()
    parts = [
        warn(config.where("not links_is_list"), "links are no list", F.lit(None)), warn(rows.where(F.size("links") > most), "too many links", F.size("links")), warn(entry.where("not coalesce(sound, false)"), "no owner/repo", F.col("raw")), warn(entry.where("sound and other = repo"), "links itself", F.col("other")),
        warn(good.join(known, "other", "left_anti"), "unknown repository", F.col("other")), warn(mirrored, "declared on both sides", F.col("other")), warn(rows.where("not contract_is_object"), "contract is no object", F.lit(None)),
        warn(rows.where("role is not null and role not in ('provider', 'consumer', 'both')"), "unknown role", F.col("role")), warn(rows.where("gate is not null and gate not in ('off', 'warn', 'block')"), "unknown gate", F.col("gate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cleaned_texts(spark, sf_dir: str) -> DataFrame:
    """Documents with control characters: how many go."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.length("text") - F.length(clean(F.col("text")))).cast("long").alias("removed"))
    return docs.where("removed > 0")


def target_paths(spark, sf_dir: str) -> DataFrame:
    """Where the page of each changed file goes, and its path below the repository."""
    units = table(spark, sf_dir, "change_units").where("filePath <> ''")
    return units.select("change_id", target_path(F.col("filePath"), "docs", slug(F.coalesce("styleKey", F.lit("")))).alias("target"), join_path(F.col("repo"), tidy_path(F.col("filePath"))).alias("joined"))


def composed_pages(spark, sf_dir: str) -> DataFrame:
    """Digest of each new page with its leading block composed anew."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and after is not null")
    return units.select("change_id", F.md5(with_front_matter(F.col("after"), F.col("title"), F.col("repo"), F.col("commit"))).alias("digest"))


TEMPLATE = "{{TITLE}}: {{REPO}} at {{SHA}} ({{OTHER}})"


def filled_briefs(spark, sf_dir: str) -> DataFrame:
    """A line on each change from a template; null values are left empty, unknown names stay."""
    return table(spark, sf_dir, "change_units").select("change_id", fill(F.lit(TEMPLATE), {"TITLE": F.col("title"), "REPO": F.col("repo"), "SHA": F.left("commit", F.lit(7))}).alias("line"))


def style_ids(spark, sf_dir: str) -> DataFrame:
    """Content-addressed ids of the briefs in use: the style's name and eight digits of the text's hash."""
    briefs = table(spark, sf_dir, "change_units").where("brief <> ''").groupBy("styleKey", "brief").agg(F.count("*").alias("uses"))
    return briefs.select(F.concat(slug(F.coalesce("styleKey", F.lit("plain"))), F.lit("@"), F.left(F.sha2("brief", 256), F.lit(8))).alias("style"), "uses")


def unit_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of decisions composed and split again: the parts come back."""
    unit = F.concat("repo", F.lit("@"), "commit", F.lit(":"), "path")
    return table(spark, sf_dir, "decisions").select("id", unit_parts(unit).alias("p")).select("id", "p.repo", "p.commit", "p.page")


def ticket_refs(spark, sf_dir: str) -> DataFrame:
    """References to tickets in documents, with the first document and the number of them."""
    all_ = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:#|\b[A-Z]{2,}-|No\. )([0-9]{2,})"), F.lit(1)))
    refs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(all_).alias("ref"))
    return refs.groupBy("ref").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))


def related_edits(spark, sf_dir: str) -> DataFrame:
    """Changes with changed files: whether the new text, case aside, names any of these by its name without
    ending; else the edit has nothing to do with the change."""
    units = table(spark, sf_dir, "change_units").where("after is not null and size(changedFiles) > 0")
    names = F.filter(F.transform("changedFiles", lambda f: F.lower(F.regexp_extract(f, r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1))), lambda n: F.length(n) >= 3)
    return units.select("change_id", F.exists(names, lambda n: F.contains(F.lower("after"), n)).alias("related"))


def repo_links(spark, sf_dir: str) -> DataFrame:
    """Links of repositories derived from their symbols: a repository declares those whose documents mention most of
    its names; both directions, the first ten declared, at most twenty."""
    owned = public_symbols(spark, sf_dir).select("repo", F.col("name").alias("symbol")).distinct()
    met = owned.join(doc_references(spark, sf_dir), "symbol").where("doc_repo <> repo").groupBy("repo", F.col("doc_repo").alias("other")).agg(F.countDistinct("symbol").alias("n"))
    return closure(met.select("repo", "other", F.struct((-F.col("n")).alias("n"), "other").alias("at")))


def unapproved_symbols(spark, sf_dir: str) -> DataFrame:
    """Public names, the repositories whose documents mention them, and of these the ones without an approved claim
    that has the name as a word."""
    owned = public_symbols(spark, sf_dir).where("length(name) >= 4").select("repo", F.col("name").alias("symbol")).distinct()
    needed = owned.join(doc_references(spark, sf_dir), "symbol").where("doc_repo <> repo").select("repo", "symbol", "doc_repo").distinct()
    words = table(spark, sf_dir, "claims").where("approved").select(F.col("repo").alias("doc_repo"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("([a-z_][a-z0-9_]{3,})"), F.lit(1)))).alias("word")).distinct()
    return needed.withColumn("word", F.lower("symbol")).join(words, ["doc_repo", "word"], "left_anti").select("repo", "symbol", "doc_repo")


QUERIES = {f.__name__: f for f in (cleaned_texts, target_paths, composed_pages, filled_briefs, style_ids, unit_ids, ticket_refs, related_edits, repo_links, unapproved_symbols)}


_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FM = r"'---' || chr(10) || concat_ws(chr(10), CASE WHEN title <> '' THEN 'title: ' || title END, CASE WHEN repo <> '' THEN 'repo: ' || repo END, CASE WHEN commit <> '' THEN 'repo_commit: ' || commit END) || chr(10) || '---' || chr(10) || regexp_replace(after, '(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n', '')"
SQL = {
    "cleaned_texts": r"SELECT * FROM (SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS BIGINT) AS removed FROM documents) WHERE removed > 0",
    "target_paths": f"SELECT change_id, array_to_string(list_filter(['docs', {_SLUG.format(chr(99) + 'oalesce(styleKey, ' + chr(39) * 2 + ')')}, regexp_replace(regexp_replace({_PATH.format('filePath')}, '\\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9._-]+', '-', 'g') || '.md'], lambda p: coalesce(p, '') <> ''), '/') AS target, '/' || array_to_string(list_filter([regexp_replace(coalesce(repo, ''), '^/+|/+$', '', 'g'), regexp_replace({_PATH.format('filePath')}, '^/+|/+$', '', 'g')], lambda p: p <> ''), '/') AS joined FROM change_units WHERE filePath <> ''",
    "composed_pages": f"SELECT change_id, md5({_FM}) AS digest FROM change_units WHERE kind = 'docs' AND after IS NOT NULL",
    "filled_briefs": "SELECT change_id, coalesce(title, '') || ': ' || coalesce(repo, '') || ' at ' || coalesce(left(commit, 7), '') || ' ({{OTHER}})' AS line FROM change_units",
    "style_ids": f"SELECT {_SLUG.format(chr(99) + 'oalesce(styleKey, ' + chr(39) + 'plain' + chr(39) + ')')} || '@' || left(sha256(brief), 8) AS style, count(*) AS uses FROM change_units WHERE brief <> '' GROUP BY styleKey, brief",
    "unit_ids": "SELECT id, CASE WHEN repo IS NOT NULL AND commit IS NOT NULL AND path IS NOT NULL THEN repo END AS repo, CASE WHEN repo IS NOT NULL AND commit IS NOT NULL AND path IS NOT NULL THEN commit END AS commit, CASE WHEN repo IS NOT NULL AND commit IS NOT NULL AND path IS NOT NULL THEN path END AS page FROM decisions",
    "ticket_refs": r"SELECT ref, min(doc_id) AS first, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:#|\b[A-Z]{2,}-|No\. )([0-9]{2,})', 1))) AS ref FROM documents) GROUP BY 1",
    "related_edits": r"SELECT change_id, list_count(list_filter(list_filter(list_transform(changedFiles, lambda f: lower(regexp_extract(f, '([^/]*?)(?:\.[A-Za-z0-9]+)?$', 1))), lambda n: length(n) >= 3), lambda n: contains(lower(after), n))) > 0 AS related FROM change_units WHERE after IS NOT NULL AND len(changedFiles) > 0",
    "repo_links": f"WITH o AS (SELECT DISTINCT repo, name AS symbol FROM ({_SYMBOLS})), m AS (SELECT o.repo, r.doc_repo AS other, count(DISTINCT symbol) AS n FROM o JOIN ({_REFS}) r USING (symbol) WHERE r.doc_repo <> o.repo GROUP BY 1, 2), d AS (SELECT repo, other, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, other) AS r, other AS oo FROM m), k AS (SELECT * FROM d WHERE r <= 10), b AS (SELECT repo, other, 0 AS way, n, oo FROM k UNION ALL SELECT other, repo, 1, n, oo FROM k), x AS (SELECT repo, other, min((way, -n, oo)) AS p FROM b GROUP BY 1, 2) SELECT repo, other FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY p, other) AS r FROM x) WHERE r <= 20",
    "unapproved_symbols": f"WITH o AS (SELECT DISTINCT repo, name AS symbol FROM ({_SYMBOLS}) WHERE length(name) >= 4), n AS (SELECT DISTINCT o.repo, symbol, r.doc_repo FROM o JOIN ({_REFS}) r USING (symbol) WHERE r.doc_repo <> o.repo), w AS (SELECT DISTINCT repo AS doc_repo, unnest(regexp_extract_all(lower(claim), '([a-z_][a-z0-9_]{{3,}})', 1)) AS word FROM claims WHERE approved) SELECT repo, symbol, doc_repo FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_repo = n.doc_repo AND w.word = lower(n.symbol))",
}
