"""Keyed tables without a transaction log: keep-first, latest per key, slices, staleness, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.identity import content_hash, point_id, signature_hash, span_id
from docloom.functions.text import fold, tidy_path
from docloom.session import table


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-if-absent: the first row of each key. An aggregate with partial results, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Upsert: the last row of each key, over an append-only log."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest])


def inserted(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` that an insert-if-absent would add."""
    return keep_first(new, keys, order).join(existing, keys, "left_anti")


def replace_slice(existing: DataFrame, new: DataFrame, keys: list[str], slices: DataFrame) -> DataFrame:
    """``existing`` without the named slices, and ``new`` in their place. No slice leaves it as it is."""
    return existing.join(slices, keys, "left_anti").unionByName(new)


def first_claims(spark, sf_dir: str) -> DataFrame:
    """The first claim of each wording per repository, blanks and case aside."""
    claims = table(spark, sf_dir, "claims").select("repo", fold(F.col("claim")).alias("wording"), "id", "path")
    return keep_first(claims, ["repo", "wording"], "id")


def latest_points(spark, sf_dir: str) -> DataFrame:
    """The stored point of each repository, path and chunk after all upserts."""
    points = table(spark, sf_dir, "vector_points").select("repo", "path", "chunk", "vec_id", "kind", "refreshed_at")
    return latest(points, ["repo", "path", "chunk"], "refreshed_at", "vec_id").drop("refreshed_at")


def first_deliveries(spark, sf_dir: str) -> DataFrame:
    """Log rows that are the first of their kind; later deliveries of the same content are left out."""
    logs = table(spark, sf_dir, "node_logs")
    keys = ["run_id", "repo", "path", "commit", "node", "status", "ms", "note", "created_at"]
    return logs.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("deliveries")).select("id", "deliveries")


def approved_claims(spark, sf_dir: str) -> DataFrame:
    """The fifty newest supported and approved claims of each page: a top-k report."""
    order = Window.partitionBy("repo", "path").orderBy(F.desc("created_at"), F.desc("id"))
    good = table(spark, sf_dir, "claims").where("supported and approved").select("id", "repo", "path", "created_at")
    return good.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 50").select("id", "repo", "path", "place")


def approvals(spark, sf_dir: str) -> DataFrame:
    """Supported claims that an approval of their page and commit would flip: pages published at that commit."""
    done = table(spark, sf_dir, "decisions").where("outcome = 'published'").select("repo", "path", "commit").distinct()
    return table(spark, sf_dir, "claims").where("supported and not coalesce(approved, false)").join(done, ["repo", "path", "commit"], "left_semi").select("id")


def fact_states(spark, sf_dir: str) -> DataFrame:
    """Facts by state of their source: its digest is the stored one, another, or the file is not there. Of a
    file delivered several times the last text counts."""
    units = table(spark, sf_dir, "change_units").where("after is not null").select("repo", tidy_path(F.col("filePath")).alias("path"), "change_id", content_hash(F.col("after")).alias("digest"))
    now = latest(units, ["repo", "path"], "change_id").drop("change_id")
    facts = table(spark, sf_dir, "repo_facts").select("id", "repo", tidy_path(F.col("source_path")).alias("path"), "source_hash")
    state = F.when(F.col("path").startswith("@"), "aggregate").when(F.col("digest").isNull(), "missing").when(F.col("digest").eqNullSafe(F.col("source_hash")), "fresh").otherwise("stale")
    return facts.join(now, ["repo", "path"], "left").groupBy("repo", state.alias("state")).agg(F.count("*").alias("n"))


def folder_digests(spark, sf_dir: str) -> DataFrame:
    """One digest per repository over its files: a hash over the digests of 4,096 parts, each a hash of its
    sorted lines of path and content hash. Parts are chosen by the path's hash, so no task gathers the lines of
    a whole repository, and the second step gathers at most 4,096 digests."""
    units = table(spark, sf_dir, "change_units").where("after is not null").select("repo", tidy_path(F.col("filePath")).alias("path"), F.sha2("after", 256).alias("h")).distinct()
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit("\t"), "h", F.lit("\n"))))
    parts = units.groupBy("repo", F.left(F.md5("path"), F.lit(3)).alias("part")).agg(F.sha2(F.array_join(lines, ""), 256).alias("d"), F.count("*").alias("n"))
    digests = F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "d")))
    return parts.groupBy("repo").agg(F.sha2(F.array_join(digests, ","), 256).alias("digest"), F.sum("n").alias("files"))


def identifiers(spark, sf_dir: str) -> DataFrame:
    """Deterministic identifiers of documents."""
    return table(spark, sf_dir, "documents").where("repo is not null and path is not null and commit is not null").select(
        "doc_id", point_id(F.col("repo"), F.col("path"), F.col("doc_id")).alias("point"), signature_hash(F.concat_ws("/", "repo", "path")).alias("signature"), span_id(F.col("repo"), F.col("commit"), F.col("path")).alias("span"),
    )


def sync_plan(spark, sf_dir: str) -> DataFrame:
    """Per repository of the decisions: whether its index is current, can be brought up to date from the
    commit it stands at, or has to be built."""
    last = latest(table(spark, sf_dir, "decisions").where("commit is not null").select("repo", "id", "commit"), ["repo"], "id")
    seen = table(spark, sf_dir, "decisions").select("repo", F.left("commit", F.lit(7)).alias("short")).distinct()
    state = table(spark, sf_dir, "context_state").select("repo", F.left("commit", F.lit(7)).alias("short"))
    known = state.join(seen, ["repo", "short"], "left_semi").select("repo", F.lit(True).alias("known"))
    plan = F.when(F.col("short").isNull(), "build").when(F.col("short") == F.left("commit", F.lit(7)), "current").when(F.col("known"), "update").otherwise("rebuild")
    return last.join(state, "repo", "left").join(known, "repo", "left").select("repo", plan.alias("plan"))


def changed_pages(spark, sf_dir: str) -> DataFrame:
    """Pages whose published and new text differ, appear, or vanish: two revisions joined on their path."""
    u = table(spark, sf_dir, "change_units").select("change_id", "repo", tidy_path(F.col("filePath")).alias("path"), "existing", "after")
    last = latest(u, ["repo", "path"], "change_id")
    old = last.where("existing <> ''").select("repo", "path", F.sha2("existing", 256).alias("o"))
    new = last.where("after is not null").select("repo", "path", F.sha2("after", 256).alias("n"))
    both = old.join(new, ["repo", "path"], "full_outer").where("not (o <=> n)")
    return both.select("repo", "path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


QUERIES = {f.__name__: f for f in (first_claims, latest_points, first_deliveries, approved_claims, approvals, fact_states, folder_digests, identifiers, sync_plan, changed_pages)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
SQL = {
    "first_claims": "SELECT repo, wording, min(id) AS id, arg_min(path, id) AS path FROM (SELECT repo, trim(regexp_replace(lower(claim), '[ \\t\\r\\n]+', ' ', 'g')) AS wording, id, path FROM claims) GROUP BY 1, 2",
    "latest_points": "SELECT repo, path, chunk, vec_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, chunk ORDER BY refreshed_at DESC NULLS LAST, vec_id DESC) AS r FROM vector_points) WHERE r = 1",
    "first_deliveries": "SELECT min(id) AS id, count(*) AS deliveries FROM node_logs GROUP BY run_id, repo, path, commit, node, status, ms, note, created_at",
    "approved_claims": "SELECT id, repo, path, place FROM (SELECT id, repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY created_at DESC NULLS LAST, id DESC) AS place FROM claims WHERE supported AND approved) WHERE place <= 50",
    "approvals": "SELECT id FROM claims c WHERE supported AND NOT coalesce(approved, false) AND EXISTS (SELECT 1 FROM decisions d WHERE d.outcome = 'published' AND d.repo = c.repo AND d.path = c.path AND d.commit = c.commit)",
    "fact_states": f"WITH n AS (SELECT repo, {_PATH.format('filePath')} AS path, arg_max(sha256(after), change_id) AS digest FROM change_units WHERE after IS NOT NULL GROUP BY 1, 2), f AS (SELECT id, repo, {_PATH.format('source_path')} AS path, source_hash FROM repo_facts) SELECT repo, CASE WHEN starts_with(path, '@') THEN 'aggregate' WHEN digest IS NULL THEN 'missing' WHEN digest IS NOT DISTINCT FROM source_hash THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n FROM f LEFT JOIN n USING (repo, path) GROUP BY 1, 2",
    "folder_digests": f"WITH f AS (SELECT DISTINCT repo, {_PATH.format('filePath')} AS path, sha256(after) AS h FROM change_units WHERE after IS NOT NULL), p AS (SELECT repo, left(md5(path), 3) AS part, sha256(string_agg(path || chr(9) || h || chr(10), '' ORDER BY path || chr(9) || h || chr(10))) AS d, count(*) AS n FROM f GROUP BY 1, 2) SELECT repo, sha256(string_agg(part || ':' || d, ',' ORDER BY part || ':' || d)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM p GROUP BY 1",
    "identifiers": "WITH d AS (SELECT doc_id, sha1(repo || chr(0) || path || chr(0) || doc_id) AS h, repo, path, commit FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL AND commit IS NOT NULL) SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS point, left(sha1(repo || '/' || path), 12) AS signature, left(sha256(repo || chr(31) || commit || chr(31) || path), 16) AS span FROM d",
    "sync_plan": "WITH l AS (SELECT repo, arg_max(commit, id) AS commit FROM decisions WHERE commit IS NOT NULL GROUP BY 1), s AS (SELECT repo, left(commit, 7) AS short FROM context_state) SELECT l.repo, CASE WHEN s.short IS NULL THEN 'build' WHEN s.short = left(l.commit, 7) THEN 'current' WHEN EXISTS (SELECT 1 FROM decisions d WHERE d.repo = l.repo AND left(d.commit, 7) = s.short) THEN 'update' ELSE 'rebuild' END AS plan FROM l LEFT JOIN s ON s.repo = l.repo",
    "changed_pages": f"WITH l AS (SELECT repo, {_PATH.format('filePath')} AS path, existing, after, row_number() OVER (PARTITION BY repo, {_PATH.format('filePath')} ORDER BY change_id DESC) AS r FROM change_units) SELECT repo, path, CASE WHEN existing IS NULL OR existing = '' THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM l WHERE r = 1 AND ((existing <> '') IS TRUE OR after IS NOT NULL) AND NOT ((existing <> '') IS TRUE AND after IS NOT NULL AND existing = after)",
}
