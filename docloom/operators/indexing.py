"""Index states applied: which points go, stay and are built anew; marks, flags, totals and checks of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.identity import content_hash
from docloom.functions.text import language, selected, tidy_path
from docloom.operators.facts import latest
from docloom.session import table

#: Price of a million tokens of embedding, a parameter of the totals.
TOKEN_USD = 0.02
# Files that hold documentation.
DOC_FILE = r"(?i)(^|/)(readme|changelog|contributing)[^/]*$|(^|/)docs?/|\.(md|mdx|rst|adoc)$"
SENSITIVE = r"(?i)(^|/)\.env(\.[^/]*)?$|\.(env|pem|key|p12|jks|pfx)$|(^|/)(id_rsa|credentials?|secrets?)[^/]*$"


def files_now(spark, sf_dir: str) -> DataFrame:
    """(repo, path, change_id, after): the last delivery of each file."""
    units = table(spark, sf_dir, "change_units").where("repo is not null and filePath is not null").select("repo", tidy_path(F.col("filePath")).alias("path"), "change_id", "after")
    return latest(units, ["repo", "path"], "change_id")


def index_modes(spark, sf_dir: str) -> DataFrame:
    """(repo, mode): a repository without a complete state is indexed in full, all others bring theirs up to date."""
    repos = files_now(spark, sf_dir).select("repo").distinct()
    state = table(spark, sf_dir, "context_state").select("repo", F.col("chunks").isNotNull().alias("whole"), F.lit(True).alias("known"))
    return repos.join(state, "repo", "left").select("repo", F.when(F.col("whole"), "incremental").otherwise("full").alias("mode"), F.when(F.col("known").isNull(), "first run").when(F.col("whole"), "index known").otherwise("index incomplete").alias("reason"))


def synced_points(points: DataFrame, files: DataFrame, modes: DataFrame) -> DataFrame:
    """(point_id, repo, path, fate) of every stored point after a sync: ``rebuilt`` with all of its repository,
    ``removed`` where its file is gone, ``replaced`` where its file was delivered anew, ``kept`` else."""
    now = files.select("repo", "path", F.col("after").isNotNull().alias("present"))
    met = points.join(modes.select("repo", "mode"), "repo", "left").join(now, ["repo", "path"], "left")
    fate = F.when(F.col("mode") == "full", "rebuilt").when(~F.col("present"), "removed").when(F.col("present"), "replaced").otherwise("kept")
    return met.select("point_id", "repo", "path", fate.alias("fate"))


def index_sync(spark, sf_dir: str) -> DataFrame:
    """Per repository: how it is indexed, stored points by fate, and the files read for it: all in full mode, else
    those delivered."""
    points = table(spark, sf_dir, "vector_points").where("repo is not null").select(F.col("vec_id").alias("point_id"), "repo", tidy_path(F.col("path")).alias("path"))
    files, modes = files_now(spark, sf_dir), index_modes(spark, sf_dir)
    fates = synced_points(points, files, modes).groupBy("repo").agg(*[F.count_if(F.col("fate") == x).alias(x) for x in ("kept", "removed", "replaced", "rebuilt")])
    read = files.groupBy("repo").agg(F.count_if(F.col("after").isNotNull()).alias("files_indexed"), F.count_if(F.col("after").isNull()).alias("files_gone"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "removed", "replaced", "rebuilt")]
    return modes.join(read, "repo").join(fates, "repo", "left").select("repo", "mode", "reason", "files_indexed", "files_gone", *counts)


def touched_commits(spark, sf_dir: str) -> DataFrame:
    """Points that stay as they are and are marked with the commit their repository's index stands at."""
    state = table(spark, sf_dir, "context_state").where("commit is not null").select("repo", F.col("commit").alias("now"))
    points = table(spark, sf_dir, "vector_points").select("vec_id", "repo", "commit")
    return points.join(state, "repo").where("not (commit <=> now)").select("vec_id", F.col("commit").alias("was"), F.col("now").alias("commit"))


def flagged_facts(spark, sf_dir: str) -> DataFrame:
    """(repo, fact, flag): flags after an update that marks facts whose source changed; a set flag stays."""
    facts = table(spark, sf_dir, "repo_facts").select("repo", "fact", "flag", "source_hash", tidy_path(F.col("source_path")).alias("path"))
    now = files_now(spark, sf_dir).where("after is not null").select("repo", "path", content_hash(F.col("after")).alias("digest"))
    stale = F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("source_hash"))
    return facts.join(now, ["repo", "path"], "left").select("repo", "fact", F.coalesce("flag", F.when(stale, "source_changed")).alias("flag")).where("flag is not null")


def onboarding_totals(spark, sf_dir: str) -> DataFrame:
    """Per repository: code files, their characters, tokens at four characters each, and what embedding them costs."""
    files = files_now(spark, sf_dir).where("after is not null")
    chars = F.length("after").cast("long")
    per = files.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.col("path").rlike(DOC_FILE)).alias("doc_files"), F.sum(chars).alias("chars"))
    tokens = F.round(F.col("chars") / 4).cast("long")
    return per.select("repo", "files", "doc_files", "chars", tokens.alias("tokens"), F.round(tokens * TOKEN_USD / 1e6, 9).alias("usd"))


def sensitive_files(spark, sf_dir: str) -> DataFrame:
    """Changed files that look like holding secrets and that the repository's map does not list."""
    units = table(spark, sf_dir, "change_units").where("size(changedFiles) > 0")
    found = F.filter("changedFiles", lambda f: f.rlike(SENSITIVE))
    return units.select("change_id", F.explode(F.array_except(found, F.coalesce("repoMap", F.array().cast("array<string>")))).alias("file"))


def listing_order(spark, sf_dir: str) -> DataFrame:
    """Files of each change's map, changed ones first, in the map's order within both."""
    units = table(spark, sf_dir, "change_units").where("size(repoMap) > 0").select("change_id", F.posexplode("repoMap").alias("at", "file"), "changedFiles")
    changed = F.coalesce(F.array_contains("changedFiles", F.col("file")), F.lit(False))
    order = Window.partitionBy("change_id").orderBy(F.col("changed").desc(), "at")  # one change's list of files
    return units.select("change_id", "at", "file", changed.alias("changed")).select("change_id", "file", "changed", F.row_number().over(order).cast("long").alias("place"))


def kept_references(spark, sf_dir: str) -> DataFrame:
    """Changed files of each change that its map knows: order and repeats stay."""
    units = table(spark, sf_dir, "change_units").where("size(changedFiles) > 0")
    kept = F.filter("changedFiles", lambda f: F.coalesce(F.array_contains("repoMap", f), F.lit(False)))
    return units.select("change_id", F.array_join(kept, "|").alias("kept"), F.size(kept).cast("long").alias("n"))


OPT_OUT = r"(?i)\[(?:skip|no)[ -]docs?\]|\bdocs?:[ ]*(?:skip|none)\b"


def unit_marks(spark, sf_dir: str) -> DataFrame:
    """Per change: whether its file is documentation, whether its title or brief opts out, and which evidence
    there is for it (text and map, text only, map only, none)."""
    has_text, has_map = F.coalesce(F.col("after") != "", F.lit(False)), F.size(F.coalesce("repoMap", F.array().cast("array<string>"))) > 0
    evidence = F.when(has_text & has_map, "source+map").when(has_text, "source").when(has_map, "map").otherwise("none")
    said = F.concat_ws(" ", "title", "brief")
    return table(spark, sf_dir, "change_units").select("change_id", F.coalesce(tidy_path(F.col("filePath")).rlike(DOC_FILE), F.lit(False)).alias("doc_file"), said.rlike(OPT_OUT).alias("opted_out"), evidence.alias("evidence"))


def checks(df: DataFrame, name: str, key: str, conditions: dict[str, Column]) -> DataFrame:
    """(source, check, n): rows that break each condition, and keys that are not unique."""
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    broken = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in conditions])).alias("c")).select(F.lit(name).alias("source"), "c.check", "c.n")
    repeated = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), F.lit("repeated_key").alias("check"), "n")
    return broken.unionByName(repeated)


def table_checks(spark, sf_dir: str) -> DataFrame:
    """What a schema with constraints would refuse, as counts per table."""
    c = F.col
    parts = [
        checks(table(spark, sf_dir, "node_logs"), "node_logs", "id", {"null_key": c("id").isNull(), "null_status": c("status").isNull(), "negative_ms": c("ms") < 0, "null_ms": c("ms").isNull()}),
        checks(table(spark, sf_dir, "decisions"), "decisions", "id", {"null_key": c("id").isNull(), "null_outcome": c("outcome").isNull(), "short_commit": F.length("commit") < 40}),
        checks(table(spark, sf_dir, "claims"), "claims", "id", {"null_key": c("id").isNull(), "empty_claim": F.coalesce(F.trim("claim"), F.lit("")) == "", "null_approved": c("approved").isNull()}),
        checks(table(spark, sf_dir, "repo_facts"), "repo_facts", "id", {"null_key": c("id").isNull(), "empty_hash": F.coalesce("source_hash", F.lit("")) == "", "flag_without_detail": c("flag").isNotNull() & c("flag_detail").isNull()}),
        checks(table(spark, sf_dir, "vector_points"), "vector_points", "id", {"null_key": c("id").isNull(), "null_vector": c("embedding").isNull(), "other_dimension": F.size("embedding") != 64}),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def onboarding_plan(spark, sf_dir: str) -> DataFrame:
    """Per repository and language: files in scope, files excluded, characters to read; nothing is written."""
    files = files_now(spark, sf_dir).where("after is not null")
    chosen = selected(F.col("path"), [], ["**/vendor/**", "**/node_modules/**", "**/generated/**", "**/*.min.js"])
    return files.groupBy("repo", language(F.col("path")).alias("language")).agg(F.count_if(chosen).alias("chosen"), F.count_if(~chosen).alias("excluded"), F.coalesce(F.sum(F.when(chosen, F.length("after"))), F.lit(0)).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (index_modes, index_sync, touched_commits, flagged_facts, onboarding_totals, sensitive_files, listing_order, kept_references, unit_marks, table_checks, onboarding_plan)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_FILES = f"SELECT repo, path, arg_max(a, change_id).a AS after FROM (SELECT repo, {_PATH.format('filePath')} AS path, change_id, struct_pack(a := after) AS a FROM change_units WHERE repo IS NOT NULL AND filePath IS NOT NULL) GROUP BY 1, 2"
_MODES = f"SELECT f.repo, CASE WHEN s.chunks IS NOT NULL THEN 'incremental' ELSE 'full' END AS mode, CASE WHEN s.repo IS NULL THEN 'first run' WHEN s.chunks IS NOT NULL THEN 'index known' ELSE 'index incomplete' END AS reason FROM (SELECT DISTINCT repo FROM ({_FILES})) f LEFT JOIN context_state s ON s.repo = f.repo"
_LANG = "CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'sh' THEN 'shell' WHEN 'tf' THEN 'terraform' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown' ELSE CASE WHEN x IN ('go', 'java', 'sql', 'yaml', 'json', 'toml', 'xml', 'properties', 'css') THEN x ELSE 'text' END END"


def _check(name: str, key: str, conditions: dict[str, str]) -> str:
    parts = [f"SELECT '{name}' AS source, '{n}' AS \"check\", count(*) FILTER (WHERE {c}) AS n FROM {name}" for n, c in conditions.items()]
    return " UNION ALL ".join([*parts, f"SELECT '{name}', 'repeated_key', count(*) FROM (SELECT {key} FROM {name} GROUP BY 1 HAVING count(*) > 1)"])


SQL = {
    "index_modes": _MODES,
    "index_sync": f"""WITH f AS ({_FILES}), m AS ({_MODES}), p AS (SELECT vec_id, repo, {_PATH.format('path')} AS path FROM vector_points WHERE repo IS NOT NULL),
        x AS (SELECT p.repo, CASE WHEN m.mode = 'full' THEN 'rebuilt' WHEN f.path IS NULL THEN 'kept' WHEN f.after IS NULL THEN 'removed' ELSE 'replaced' END AS fate FROM p LEFT JOIN m USING (repo) LEFT JOIN f ON f.repo = p.repo AND f.path = p.path),
        c AS (SELECT repo, count(*) FILTER (WHERE fate = 'kept') AS kept, count(*) FILTER (WHERE fate = 'removed') AS removed, count(*) FILTER (WHERE fate = 'replaced') AS replaced, count(*) FILTER (WHERE fate = 'rebuilt') AS rebuilt FROM x GROUP BY 1),
        r AS (SELECT repo, count(after) AS files_indexed, count(*) - count(after) AS files_gone FROM f GROUP BY 1)
        SELECT m.repo, mode, reason, files_indexed, files_gone, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(replaced, 0) AS replaced, coalesce(rebuilt, 0) AS rebuilt FROM m JOIN r USING (repo) LEFT JOIN c USING (repo)""",
    "touched_commits": "SELECT p.vec_id, p.commit AS was, s.commit FROM vector_points p JOIN context_state s ON s.repo = p.repo WHERE s.commit IS NOT NULL AND p.commit IS DISTINCT FROM s.commit",
    "flagged_facts": f"WITH f AS ({_FILES}) SELECT r.repo, r.fact, coalesce(r.flag, CASE WHEN f.after IS NOT NULL AND sha256(f.after) IS DISTINCT FROM r.source_hash THEN 'source_changed' END) AS flag FROM repo_facts r LEFT JOIN f ON f.repo = r.repo AND f.path = {_PATH.format('r.source_path')} WHERE r.flag IS NOT NULL OR (f.after IS NOT NULL AND sha256(f.after) IS DISTINCT FROM r.source_hash)",
    "onboarding_totals": f"WITH p AS (SELECT repo, count(*) AS files, count(*) FILTER (WHERE regexp_matches(path, '{DOC_FILE}')) AS doc_files, CAST(sum(length(after)) AS BIGINT) AS chars FROM ({_FILES}) WHERE after IS NOT NULL GROUP BY 1) SELECT *, CAST(round(chars / 4) AS BIGINT) AS tokens, round(CAST(round(chars / 4) AS BIGINT) * 0.02 / 1e6, 9) AS usd FROM p",
    "sensitive_files": f"SELECT DISTINCT change_id, file FROM (SELECT change_id, repoMap, unnest(changedFiles) AS file FROM change_units) WHERE regexp_matches(file, '{SENSITIVE}') AND NOT coalesce(list_contains(repoMap, file), false)",
    "listing_order": "WITH f AS (SELECT change_id, unnest(repoMap) AS file, generate_subscripts(repoMap, 1) AS pos, changedFiles FROM change_units WHERE len(repoMap) > 0), c AS (SELECT *, coalesce(list_contains(changedFiles, file), false) AS changed FROM f) SELECT change_id, file, changed, row_number() OVER (PARTITION BY change_id ORDER BY changed DESC, pos) AS place FROM c",
    "kept_references": "SELECT change_id, array_to_string(list_filter(changedFiles, lambda x: coalesce(list_contains(repoMap, x), false)), '|') AS kept, CAST(len(list_filter(changedFiles, lambda x: coalesce(list_contains(repoMap, x), false))) AS BIGINT) AS n FROM change_units WHERE len(changedFiles) > 0",
    "unit_marks": f"SELECT change_id, coalesce(regexp_matches({_PATH.format('filePath')}, '{DOC_FILE}'), false) AS doc_file, regexp_matches(concat_ws(' ', title, brief), '{OPT_OUT}') AS opted_out, CASE WHEN coalesce(after <> '', false) AND coalesce(len(repoMap), 0) > 0 THEN 'source+map' WHEN coalesce(after <> '', false) THEN 'source' WHEN coalesce(len(repoMap), 0) > 0 THEN 'map' ELSE 'none' END AS evidence FROM change_units",
    "table_checks": " UNION ALL ".join((
        _check("node_logs", "id", {"null_key": "id IS NULL", "null_status": "status IS NULL", "negative_ms": "ms < 0", "null_ms": "ms IS NULL"}), _check("decisions", "id", {"null_key": "id IS NULL", "null_outcome": "outcome IS NULL", "short_commit": "length(commit) < 40"}),
        _check("claims", "id", {"null_key": "id IS NULL", "empty_claim": "coalesce(trim(claim), '') = ''", "null_approved": "approved IS NULL"}), _check("repo_facts", "id", {"null_key": "id IS NULL", "empty_hash": "coalesce(source_hash, '') = ''", "flag_without_detail": "flag IS NOT NULL AND flag_detail IS NULL"}),
        _check("vector_points", "id", {"null_key": "id IS NULL", "null_vector": "embedding IS NULL", "other_dimension": "len(embedding) <> 64"}),
    )),
    "onboarding_plan": f"WITH f AS (SELECT repo, path, after, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x, NOT regexp_matches(path, '^(?:.*/)?vendor/.*$|^(?:.*/)?node_modules/.*$|^(?:.*/)?generated/.*$|^(?:.*/)?[^/]*\\.min\\.js$') AS chosen FROM ({_FILES}) WHERE after IS NOT NULL) SELECT repo, {_LANG} AS language, count(*) FILTER (WHERE chosen) AS chosen, count(*) FILTER (WHERE NOT chosen) AS excluded, CAST(coalesce(sum(length(after)) FILTER (WHERE chosen), 0) AS BIGINT) AS chars FROM f GROUP BY 1, 2",
}
