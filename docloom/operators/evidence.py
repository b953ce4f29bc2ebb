"""What a draft is written from and what it cost: a page's files under a budget, what is recorded of texts and
documents, facts that manifests state, sizes by language, spend per page, outcomes per segment, recent stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.running import running
from docloom.functions.stats import wilson
from docloom.functions.text import DOCUMENT_PATH, SENSITIVE_PATH, SENSITIVE_TEXT, clip, language, sensitive, tidy_path
from docloom.session import table

#: Characters of source text that a page's unit, or a record of one text, carries; ``None`` for no limit.
BUDGET = 30_000
FILE_LINE = "### FILE: "


def kept(before: Column, chars: Column, budget: int | None) -> Column:
    """Characters that still fit when ``before`` are used."""
    return chars if budget is None else F.greatest(F.lit(0), F.least(chars, F.lit(budget) - before))


def newest_files(units: DataFrame, *values: Column) -> DataFrame:
    """(repo, path, change_id, values) of the newest delivery of each code file; rows without an id, a repository
    or a path are left out."""
    path = tidy_path(F.col("filePath"))
    rows = units.where("kind = 'code' and change_id is not null and repo is not null").select("repo", path.alias("path"), F.struct("change_id", *values).alias("v")).where("path <> ''")
    return rows.groupBy("repo", "path").agg(F.max_by("v", "v.change_id").alias("v")).select("repo", "path", "v.*")


def page_files(units: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """Files of each page that a commit touches: one row per file with its state (changed, removed, same), its place
    (changed ones first, then by delivery), its length and how much of it fits the page's budget. A page is a
    repository's top folder; sensitive files are left out, pages without a change too."""
    state = F.when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    path = tidy_path(F.col("filePath"))
    hidden = F.coalesce(sensitive(path, F.col("after")), sensitive(path, F.col("before")))  # marks count on both sides
    files = newest_files(units, state.alias("state"), hidden.alias("hidden"), F.coalesce(F.length("after"), F.lit(0)).cast("long").alias("chars"))
    files = files.where("hidden is null").drop("hidden")
    files = files.withColumn("page", F.concat(F.when(F.instr("path", "/") > 1, F.substring_index("path", "/", 1)).otherwise("overview"), F.lit(".md")))
    touched = files.groupBy("repo", "page").agg(F.count_if(F.col("state") != "same").alias("n")).where("n > 0")
    ordered = files.join(touched, ["repo", "page"], "left_semi").withColumn("key", F.col("change_id") + F.when(F.col("state") == "same", F.lit(1 << 50)).otherwise(F.lit(0)))
    rows = running(ordered, ["repo", "page"], "key", "chars")
    return rows.select("repo", "page", "path", "state", "place", "chars", kept(F.col("before"), F.col("chars"), budget).alias("kept"))


def page_unit_files(spark, sf_dir: str) -> DataFrame:
    return page_files(table(spark, sf_dir, "change_units"))


def sensitive_units(spark, sf_dir: str) -> DataFrame:
    """Newest code files that change detection must not see, and why."""
    path = tidy_path(F.col("filePath"))
    why = F.coalesce(sensitive(path, F.col("after")), sensitive(path, F.col("before")))
    return newest_files(table(spark, sf_dir, "change_units"), why.alias("reason")).where("reason is not null").select("repo", "path", "reason")


def page_units(spark, sf_dir: str) -> DataFrame:
    """One row per touched page: its files by state, and the characters in and beyond its budget."""
    totals = page_files(table(spark, sf_dir, "change_units")).groupBy("repo", "page").agg(
        F.count("*").alias("files"), F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "removed").alias("removed"),
        F.sum("chars").alias("chars"), F.sum("kept").alias("kept"),
    )
    return totals.withColumn("dropped", F.col("chars") - F.col("kept"))


def recorded(units: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """What a record of each new text holds: its files, those that changed first, up to the budget, the characters
    left out, and a digest of the whole. A text without a file line is one file named ``(source)``; null and empty texts
    have no record."""
    split = F.split(F.concat(F.lit("\n"), "after"), "\n" + FILE_LINE, -1)
    named = units.where("after <> ''").select("change_id", "after", F.array_compact(F.coalesce(F.transform("changedFiles", lambda f: F.trim(f)), F.array())).alias("touched"), split.alias("b"))
    path = lambda t: F.trim(F.regexp_replace(F.substring_index(t, "\n", 1), "\r$", ""))
    several = F.transform(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(1))), lambda t: F.struct(path(t).alias("path"), (F.length(t) + len(FILE_LINE)).cast("long").alias("n")))
    alone = F.array(F.struct(F.lit("(source)").alias("path"), (F.length("after") + len(FILE_LINE) + 9).cast("long").alias("n")))
    files = named.select("change_id", "after", "touched", F.when(F.size("b") > 1, several).otherwise(alone).alias("f"))
    first = F.filter("f", lambda x: F.array_contains("touched", x["path"]))
    ordered = files.select("change_id", "after", F.size(first).cast("long").alias("changed"), F.concat(first, F.filter("f", lambda x: ~F.array_contains("touched", x["path"]))).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    used = total if budget is None else F.least(total, F.lit(budget).cast("long"))
    return ordered.select("change_id", F.size("f").cast("long").alias("files"), "changed", F.get("f", F.lit(0))["path"].alias("first"), total.alias("chars"), used.alias("recorded"), (total - used).alias("dropped"), F.sha2("after", 256).alias("digest"))


def recorded_sources(spark, sf_dir: str) -> DataFrame:
    return recorded(table(spark, sf_dir, "change_units"))


def recorded_documents(spark, sf_dir: str, most: int = 12, chars: int = 1500) -> DataFrame:
    """The documents recorded with a repository's work: the ``most`` newest ones (a top-k report), each clipped."""
    docs = table(spark, sf_dir, "documents").where("repo is not null and text <> ''").select("repo", "doc_id", "updated_at", clip(F.col("text"), chars).alias("t"))
    placed = docs.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc_nulls_last("updated_at"), "doc_id"))).where(F.col("place") <= most)
    return placed.select("repo", F.col("place").cast("long").alias("place"), "doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def language_sizes(spark, sf_dir: str) -> DataFrame:
    """Bytes of each repository's newest code files by language, their share in per cent and rank; files of no known
    language or with NUL characters don't count."""
    units = table(spark, sf_dir, "change_units")
    size = F.when(~F.contains("after", F.lit("\0")), F.octet_length("after")).cast("long")
    sized = newest_files(units, size.alias("bytes")).where("bytes > 0").groupBy("repo", language(F.col("path")).alias("language")).agg(F.sum("bytes").alias("bytes")).where("language <> 'text'")
    whole = Window.partitionBy("repo")  # as many rows as there are languages
    rank = F.row_number().over(whole.orderBy(F.desc("bytes"), "language"))
    return sized.select("repo", "language", "bytes", F.round(F.col("bytes") * 100 / F.sum("bytes").over(whole), 6).alias("share"), rank.cast("long").alias("rank"))


# What manifests state, as (sort, pattern of the path, pattern of the text with the value as its group).
MANIFESTS = (
    ("go_version", r"(^|/)go\.mod$", r"^go[ \t]+([0-9]+\.[0-9]+(?:\.[0-9]+)?)"),
    ("go_module", r"(^|/)go\.mod$", r"^module[ \t]+([^ \t\r\n]+)"),
    ("go_package", r"(^|/)go\.sum$", r"^([^ \t\r\n]+)[ \t]+v"),
    ("java_version", r"(^|/)pom\.xml$", r"<(?:java\.version|maven\.compiler\.release|maven\.compiler\.source)>[ \t]*([^< \t\r\n]+)"),
    ("java_version", r"(^|/)build\.gradle(\.kts)?$", r"(?:sourceCompatibility|languageVersion)[^0-9\r\n]*([0-9]+(?:\.[0-9]+)?)"),
    ("node_version", r"(^|/)package\.json$", r'"node"[ \t]*:[ \t]*"([^"\r\n]+)"'),
    ("node_package", r"(^|/)package-lock\.json$", r'"node_modules/([^"\r\n]+)"'),
    ("python_version", r"(^|/)pyproject\.toml$", r"""^(?:requires-python|python)[ \t]*=[ \t]*["']([^"'\r\n]+)"""),
    ("python_package", r"(^|/)poetry\.lock$", r'^name[ \t]*=[ \t]*"([^"\r\n]+)"'),
    ("make_target", r"(^|/)Makefile$", r"^([A-Za-z][A-Za-z0-9_-]*)[ \t]*:(?:[^=]|$)"),
    ("workflow", r"^\.github/workflows/[^/]+\.ya?ml$", r"^name:[ \t]*([^\r\n]+)"),
    ("base_image", r"(^|/)Dockerfile$", r"^FROM[ \t]+([^ \t\r\n]+)"),
    ("container_port", r"(^|/)Dockerfile$", r"^EXPOSE[ \t]+([0-9]+)"),
    ("container_setting", r"(^|/)Dockerfile$", r"^(?:ENV|ARG)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"),
)


def stated(units: DataFrame) -> DataFrame:
    """(repo, sort, value, files): what the newest manifests of each repository state. Only the texts of manifests
    are moved; a file that states a value twice counts once."""
    manifests = units.where(tidy_path(F.col("filePath")).rlike("|".join(sorted({p for _, p, _ in MANIFESTS}))))
    newest = newest_files(manifests, F.col("after")).where("after is not null")

    def facts(sort: str, path: str, text: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all("after", F.lit("(?md)" + text), F.lit(1)))
        return F.when(F.col("path").rlike(path), F.transform(values, lambda v: F.struct(F.lit(sort).alias("sort"), F.trim(v).alias("value"))))

    found = [facts(*m) for m in MANIFESTS]
    each = newest.select("repo", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x")).select("repo", "x.*")
    return each.groupBy("repo", "sort", "value").agg(F.count("*").alias("files"))


def manifest_facts(spark, sf_dir: str) -> DataFrame:
    return stated(table(spark, sf_dir, "change_units"))


def page_spend(spark, sf_dir: str) -> DataFrame:
    """Calls and spend per page and tier over all its runs; broken or absent notes count as nothing. Exact decimals."""
    part = lambda tier, field, t: F.sum(F.coalesce(F.get_json_object("note", f"$.usage.{tier}.{field}").try_cast(t), F.lit(0).cast(t)))
    logs = table(spark, sf_dir, "node_logs").groupBy("repo", "path")
    return logs.agg(*[part(tier, "calls", "long").alias(f"{tier}_calls") for tier in ("cheap", "expensive")], *[part(tier, "usd", "decimal(18,6)").cast("double").alias(f"{tier}_usd") for tier in ("cheap", "expensive")])


def segment_outcomes(spark, sf_dir: str, least: int = 20, threshold: float = 0.3) -> DataFrame:
    """Per repository and tier of the last attempt: judged decisions by what became of them, and why the segment isn't
    ready yet (too few, share of published ones too low), empty where it is. Broken lists have no tier."""
    tier = F.try_element_at(F.from_json("attempts", "array<struct<tier string>>"), F.lit(-1))["tier"]
    d = table(spark, sf_dir, "decisions").select("repo", F.coalesce(tier, F.lit("none")).alias("tier"), "outcome")
    counted = d.groupBy("repo", "tier").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("published", "pending_review", "fallback")])
    low, _ = wilson(F.col("published"), F.col("n"))
    reasons = F.concat_ws(", ", F.when(F.col("n") < least, "few"), F.when(F.round(low, 9) < threshold, "low"))
    return counted.select("*", F.round(low, 9).alias("low"), reasons.alias("reasons"))


def action_order(spark, sf_dir: str) -> DataFrame:
    """Per repository: the distinct actions in the order in which they first occurred, with the time of the first and
    last one. What is gathered per repository is one row per action."""
    d = table(spark, sf_dir, "decisions").where("reviewer_action <> ''")
    each = d.groupBy("repo", "reviewer_action").agg(F.min(F.struct("created_at", "id")).alias("first"), F.max("created_at").alias("last_at"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "reviewer_action")))
    return each.groupBy("repo").agg(F.min("first.created_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_join(F.transform(ordered, lambda x: x["reviewer_action"]), ",").alias("actions"))


def recent_stages(spark, sf_dir: str, node: str = "verify_draft", hours: int = 240, most: int = 100) -> DataFrame:
    """The newest ``most`` rows of one stage (a top-k report) within ``hours`` of the newest row of all."""
    logs = table(spark, sf_dir, "node_logs")
    newest = logs.agg(F.max("created_at").alias("t")).first()["t"]
    rows = logs.where(F.col("node") == node)
    if newest is not None:
        rows = rows.where(F.col("created_at") >= F.lit(newest).cast(logs.schema["created_at"].dataType) - F.make_interval(hours=F.lit(hours)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "run_id", "repo", "status", "created_at")


def scored_decisions(spark, sf_dir: str, node: str = "verify_draft") -> DataFrame:
    """Decisions with a score whose run has a row of the stage."""
    runs = table(spark, sf_dir, "node_logs").where(F.col("node") == node).select("run_id")
    score = F.get_json_object("metrics", "$.minChunkSimilarity").try_cast("double")
    return table(spark, sf_dir, "decisions").select("id", "run_id", score.alias("score")).where("score is not null").join(runs, "run_id", "left_semi").select("id", "run_id", "score")


QUERIES = {f.__name__: f for f in (page_unit_files, page_units, sensitive_units, recorded_sources, recorded_documents, language_sizes, manifest_facts, page_spend, segment_outcomes, action_order, recent_stages, scored_decisions)}

_PATH = r"regexp_replace(regexp_replace(trim(filePath), '\\', '/', 'g'), '^(\./)+', '')"
_NEWEST = f"SELECT * FROM (SELECT repo, {_PATH} AS path, change_id, before, after, row_number() OVER (PARTITION BY repo, {_PATH} ORDER BY change_id DESC) AS r FROM change_units WHERE kind = 'code' AND repo IS NOT NULL) WHERE r = 1 AND path <> ''"
_hidden = f"CASE WHEN regexp_matches(path, '{SENSITIVE_PATH}') THEN 'path' WHEN regexp_matches(path, '{DOCUMENT_PATH}') AND (coalesce(regexp_matches(after, '{SENSITIVE_TEXT}'), false) OR coalesce(regexp_matches(before, '{SENSITIVE_TEXT}'), false)) THEN 'content' END"
_FILES = f"""WITH f AS (SELECT repo, CASE WHEN instr(path, '/') > 1 THEN split_part(path, '/', 1) ELSE 'overview' END || '.md' AS page, path, change_id, CASE WHEN after IS NULL THEN 'removed' WHEN before = after THEN 'same' ELSE 'changed' END AS state, coalesce(length(after), 0) AS chars
        FROM ({_NEWEST}) WHERE {_hidden} IS NULL),
        t AS (SELECT *, count(*) FILTER (WHERE state <> 'same') OVER (PARTITION BY repo, page) AS touched FROM f),
        w AS (SELECT *, row_number() OVER o AS place, sum(chars) OVER o - chars AS used FROM t WHERE touched > 0 WINDOW o AS (PARTITION BY repo, page ORDER BY state = 'same', change_id ROWS UNBOUNDED PRECEDING))
        SELECT repo, page, path, state, place, chars, CAST(greatest(0, least(chars, {BUDGET} - used)) AS BIGINT) AS kept FROM w"""
_JSON = "CASE WHEN json_valid(note) THEN TRY_CAST(json_extract_string(note, '$.usage.{}.{}') AS {}) END"
_LOW = "greatest(0, (k / m + 3.8416 / (2 * m)) / (1 + 3.8416 / m) - 1.96 * sqrt(k / m * (1 - k / m) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m))"
_LANGUAGE = "CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'sh' THEN 'shell' WHEN 'tf' THEN 'terraform' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown' ELSE CASE WHEN x IN ('go', 'java', 'sql', 'yaml', 'json', 'toml', 'xml', 'properties', 'css') THEN x ELSE 'text' END END"
_quoted = lambda p: p.replace("'", "''")
SQL = {
    "page_unit_files": _FILES,
    "sensitive_units": f"SELECT repo, path, reason FROM (SELECT repo, path, {_hidden} AS reason FROM ({_NEWEST})) WHERE reason IS NOT NULL",
    "page_units": f"SELECT repo, page, count(*) AS files, count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'removed') AS removed, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(chars) - sum(kept) AS BIGINT) AS dropped FROM ({_FILES}) GROUP BY 1, 2",
    "recorded_sources": rf"""WITH u AS (SELECT change_id, after, list_transform(changedFiles, lambda c: trim(c)) AS c, string_split(chr(10) || after, chr(10) || '{FILE_LINE}') AS b FROM change_units WHERE after <> ''),
        p AS (SELECT change_id, after, c, len(b) AS k, unnest(b) AS t, generate_subscripts(b, 1) AS i FROM u),
        f AS (SELECT change_id, after, i, CASE WHEN k = 1 THEN '(source)' ELSE trim(regexp_replace(split_part(t, chr(10), 1), '\r$', '')) END AS path, CASE WHEN k = 1 THEN length(after) + 19 ELSE length(t) + 10 END AS n, c FROM p WHERE k = 1 OR i > 1),
        m AS (SELECT *, coalesce(list_contains(c, path), false) AS hit FROM f)
        SELECT change_id, count(*) AS files, count(*) FILTER (WHERE hit) AS changed, arg_min(path, (NOT hit, i)) AS first, CAST(sum(n) AS BIGINT) AS chars, CAST(least(sum(n), {BUDGET}) AS BIGINT) AS recorded, CAST(greatest(sum(n) - {BUDGET}, 0) AS BIGINT) AS dropped, sha256(any_value(after)) AS digest FROM m GROUP BY 1""",
    "recorded_documents": "WITH d AS (SELECT repo, doc_id, CASE WHEN length(text) > 1500 THEN left(text, 1499) || '…' ELSE text END AS t, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC NULLS LAST, doc_id) AS place FROM documents WHERE repo IS NOT NULL AND text <> '') SELECT repo, place, doc_id, length(t) AS chars, md5(t) AS digest FROM d WHERE place <= 12",
    "language_sizes": rf"WITH s AS (SELECT repo, {_LANGUAGE} AS language, CAST(sum(strlen(after)) AS BIGINT) AS bytes FROM (SELECT *, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS x FROM ({_NEWEST})) WHERE after <> '' AND NOT contains(after, chr(0)) GROUP BY 1, 2) SELECT repo, language, bytes, round(bytes * 100 / sum(bytes) OVER (PARTITION BY repo), 6) AS share, row_number() OVER (PARTITION BY repo ORDER BY bytes DESC, language) AS rank FROM s WHERE language <> 'text'",
    "manifest_facts": f"WITH n AS ({_NEWEST}), x AS (" + " UNION ALL ".join(f"SELECT repo, '{s}' AS sort, unnest(list_distinct(regexp_extract_all(after, '(?m){_quoted(t)}', 1))) AS value FROM n WHERE regexp_matches(path, '{p}')" for s, p, t in MANIFESTS) + ") SELECT repo, sort, trim(value) AS value, count(*) AS files FROM x GROUP BY 1, 2, 3",
    "page_spend": "SELECT repo, path, " + ", ".join([f"CAST(coalesce(sum({_JSON.format(t, 'calls', 'BIGINT')}), 0) AS BIGINT) AS {t}_calls" for t in ("cheap", "expensive")] + [f"CAST(coalesce(sum({_JSON.format(t, 'usd', 'DECIMAL(18,6)')}), 0) AS DOUBLE) AS {t}_usd" for t in ("cheap", "expensive")]) + " FROM node_logs GROUP BY 1, 2",
    "segment_outcomes": f"WITH d AS (SELECT repo, coalesce(CASE WHEN json_valid(attempts) AND json_array_length(attempts) > 0 THEN json_extract_string(CAST(attempts AS JSON[])[-1], '$.tier') END, 'none') AS tier, outcome FROM decisions), c AS (SELECT repo, tier, count(*) AS n, count(*) FILTER (WHERE outcome = 'published') AS published, count(*) FILTER (WHERE outcome = 'pending_review') AS pending_review, count(*) FILTER (WHERE outcome = 'fallback') AS fallback FROM d GROUP BY 1, 2), l AS (SELECT *, CAST(n AS DOUBLE) AS m, CAST(published AS DOUBLE) AS k FROM c), w AS (SELECT *, round({_LOW}, 9) AS low FROM l) SELECT repo, tier, n, published, pending_review, fallback, low, concat_ws(', ', CASE WHEN n < 20 THEN 'few' END, CASE WHEN low < 0.3 THEN 'low' END) AS reasons FROM w",
    "action_order": "WITH e AS (SELECT repo, reviewer_action, min((created_at, id)) AS f, min(created_at) AS a, max(created_at) AS z FROM decisions WHERE reviewer_action <> '' GROUP BY 1, 2) SELECT repo, min(a) AS first_at, max(z) AS last_at, string_agg(reviewer_action, ',' ORDER BY f) AS actions FROM e GROUP BY 1",
    "recent_stages": "SELECT id, run_id, repo, status, created_at FROM node_logs WHERE node = 'verify_draft' AND created_at >= (SELECT max(created_at) FROM node_logs) - INTERVAL 240 HOUR ORDER BY created_at DESC, id DESC LIMIT 100",
    "scored_decisions": "SELECT * FROM (SELECT id, run_id, CASE WHEN json_valid(metrics) THEN TRY_CAST(json_extract_string(metrics, '$.minChunkSimilarity') AS DOUBLE) END AS score FROM decisions) d WHERE score IS NOT NULL AND run_id IN (SELECT run_id FROM node_logs WHERE node = 'verify_draft')",
}
