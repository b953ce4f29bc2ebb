"""What a repository is made of, and what of it is missing or contradicts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import clip, human_list, language, slug, tidy_path
from docloom.operators.coupling import CONFIG, _routes, found_routes
from docloom.session import table

KINDS = {"containers": r"(^|/)Dockerfile$", "makefiles": r"(^|/)Makefile$", "manifests": r"(^|/)(package\.json|go\.mod|pom\.xml|pyproject\.toml)$", "pages": r"\.mdx?$"}


def repo_profile(spark, sf_dir: str) -> DataFrame:
    """Per repository: distinct source files of its facts by sort, and the language of most files."""
    files = table(spark, sf_dir, "repo_facts").where("source_path <> '' and not startswith(source_path, '@')").select("repo", tidy_path(F.col("source_path")).alias("path")).distinct()
    sorts = [F.count_if(F.col("path").rlike(p)).alias(n) for n, p in KINDS.items()]
    counted = files.groupBy("repo").agg(F.count("*").alias("files"), *sorts)
    by_language = files.groupBy("repo", language(F.col("path")).alias("l")).agg(F.count("*").alias("n"))
    # the most frequent; of equal ones the first by name
    main = by_language.where("l <> 'text'").groupBy("repo").agg(F.min_by("l", F.struct((-F.col("n")).alias("n"), "l")).alias("main_language"))
    return counted.join(main, "repo", "left")


def config_names(spark, sf_dir: str) -> DataFrame:
    """Distinct configuration names that each repository's code reads."""
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after is not null")
    names = units.select("repo", F.explode(F.regexp_extract_all("after", F.lit(CONFIG), F.lit(1))).alias("name"))
    return names.groupBy("repo", "name").agg(F.count("*").alias("uses"))


def route_examples(spark, sf_dir: str) -> DataFrame:
    """Distinct routes per repository of the documents, with the first three as a sentence."""
    routes = table(spark, sf_dir, "documents").where("repo is not null").select("repo", F.explode(found_routes(F.col("text"))).alias("route")).distinct()
    first = routes.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("route"))).where("r <= 3")
    examples = first.groupBy("repo").agg(human_list(F.array_sort(F.collect_list("route"))).alias("examples"))
    return routes.groupBy("repo").agg(F.count("*").alias("routes")).join(examples, "repo")


VALUE = r"(?<![A-Za-z0-9_.-])v?[0-9]+(?:[.,][0-9]+)*(?![A-Za-z0-9_-])"


def fact_conflicts(spark, sf_dir: str) -> DataFrame:
    """Statements that facts make with different numbers or versions: the wording with ``#`` for each of them, a
    closing remark in parentheses aside, how many different values and repositories, and how many flagged facts."""
    facts = table(spark, sf_dir, "repo_facts").select("repo", "flag", F.regexp_replace(F.trim("fact"), r"\s*\([^()]*\)\.?$", "").alias("f"))
    said = facts.select("repo", "flag", F.regexp_replace("f", VALUE, "#").alias("statement"), F.array_join(F.regexp_extract_all("f", F.lit("(" + VALUE + ")"), F.lit(1)), " ").alias("value")).where("value <> ''")
    return said.groupBy("statement").agg(F.countDistinct("value").alias("values_"), F.countDistinct("repo").alias("repos"), F.count("flag").alias("flagged")).where("values_ > 1")


def missing_state(spark, sf_dir: str) -> DataFrame:
    """Repositories of the other tables that have no index state, with the table."""
    known = table(spark, sf_dir, "context_state").select("repo")
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("source"), "repo").where("repo is not null").distinct() for n in ("change_units", "decisions", "claims", "documents", "vector_points")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(known, "repo", "left_anti").select("source", "repo")


def outcome_tally(spark, sf_dir: str) -> DataFrame:
    """Decisions per repository, outcome and action."""
    return table(spark, sf_dir, "decisions").groupBy("repo", "outcome", "reviewer_action").agg(F.count("*").alias("n"))


def page_titles(spark, sf_dir: str) -> DataFrame:
    """Each page's title (of the leading block, else the first heading, else the file name), clipped, and its slug."""
    block = F.regexp_extract("text", r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---", 1)
    own = F.regexp_extract(block, r"(?m)^title:[ \t]*([^\r\n]*)", 1)
    heading = F.regexp_extract("text", r"(?md)^#{1,4}[ \t]+([^\r\n]*)", 1)
    name = F.regexp_extract(tidy_path(F.col("path")), r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    title = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (own, heading, name)], F.lit(""))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", clip(title, 40).alias("title"), slug(title).alias("slug"))


QUERIES = {f.__name__: f for f in (repo_profile, config_names, route_examples, fact_conflicts, missing_state, outcome_tally, page_titles)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_LANG = "CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'sh' THEN 'shell' WHEN 'tf' THEN 'terraform' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown' ELSE CASE WHEN x IN ('go', 'java', 'sql', 'yaml', 'json', 'toml', 'xml', 'properties', 'css') THEN x ELSE 'text' END END"
_ROUTE = "unnest(" + _routes("text") + ")"
SQL = {
    "repo_profile": f"WITH f AS (SELECT DISTINCT repo, {_PATH.format('source_path')} AS path FROM repo_facts WHERE source_path <> '' AND NOT starts_with(source_path, '@')), c AS (SELECT repo, count(*) AS files, "
    + ", ".join(f"count(*) FILTER (WHERE regexp_matches(path, '{p}')) AS {n}" for n, p in KINDS.items())
    + rf" FROM f GROUP BY 1), l AS (SELECT repo, {_LANG} AS l, count(*) AS n FROM (SELECT repo, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS x FROM f) GROUP BY 1, 2), m AS (SELECT repo, arg_min(l, (-n, l)) AS main_language FROM l WHERE l <> 'text' GROUP BY 1) SELECT * FROM c LEFT JOIN m USING (repo)",
    "config_names": f"SELECT repo, name, count(*) AS uses FROM (SELECT repo, unnest(regexp_extract_all(after, '{CONFIG.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM change_units WHERE kind = 'code' AND after IS NOT NULL) GROUP BY 1, 2",
    "route_examples": f"WITH r AS (SELECT DISTINCT repo, {_ROUTE} AS route FROM documents WHERE repo IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY route) AS i, count(*) OVER (PARTITION BY repo) AS c FROM r) SELECT repo, max(c) AS routes, CASE least(max(c), 3) WHEN 1 THEN max(route) FILTER (WHERE i = 1) WHEN 2 THEN max(route) FILTER (WHERE i = 1) || ' and ' || max(route) FILTER (WHERE i = 2) ELSE max(route) FILTER (WHERE i = 1) || ', ' || max(route) FILTER (WHERE i = 2) || ' and ' || max(route) FILTER (WHERE i = 3) END AS examples FROM n GROUP BY repo",
    "fact_conflicts": r"""WITH f AS (SELECT repo, flag, regexp_replace(trim(fact), '\s*\([^()]*\)\.?$', '') AS f FROM repo_facts),
        t AS (SELECT repo, flag, f, list_transform(regexp_split_to_array(f, '[ ]'), lambda w: regexp_extract(w, '^([^A-Za-z0-9_.-]*)(v?[0-9]+(?:[.,][0-9]+)*)([^A-Za-z0-9_-]*)$', ['a', 'v', 'b'])) AS w, string_split(f, ' ') AS o FROM f),
        s AS (SELECT repo, flag, array_to_string(list_transform(w, lambda x, i: CASE WHEN x.v <> '' THEN x.a || '#' || x.b ELSE o[i] END), ' ') AS statement, array_to_string(list_transform(list_filter(w, lambda x: x.v <> ''), lambda x: x.v), ' ') AS value FROM t)
        SELECT statement, count(DISTINCT value) AS values_, count(DISTINCT repo) AS repos, count(flag) AS flagged FROM s WHERE value <> '' GROUP BY 1 HAVING count(DISTINCT value) > 1""",
    "missing_state": "SELECT source, repo FROM (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS source, repo FROM {n}" for n in ("change_units", "decisions", "claims", "documents", "vector_points")) + ") WHERE repo IS NOT NULL AND repo NOT IN (SELECT repo FROM context_state WHERE repo IS NOT NULL)",
    "outcome_tally": "SELECT repo, outcome, reviewer_action, count(*) AS n FROM decisions GROUP BY 1, 2, 3",
    "page_titles": rf"""WITH t AS (SELECT doc_id, trim(regexp_extract(regexp_extract(text, '(?s)\A\x{{FEFF}}?---[ \t]*\r?\n(.*?)\r?\n---', 1), '(?m)^title:[ \t]*([^\r\n]*)', 1)) AS a, trim(regexp_extract(text, '(?m)^#{{1,4}}[ \t]+([^\r\n]*)', 1)) AS b, trim(regexp_extract({_PATH.format('path')}, '([^/]*?)(?:\.[A-Za-z0-9]+)?$', 1)) AS c FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') AS title FROM t)
        SELECT doc_id, CASE WHEN length(title) > 40 THEN left(title, 39) || '…' ELSE title END AS title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM u""",
}
