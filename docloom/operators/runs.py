"""Run history: roll-ups, outcomes, backlog, spend, latest decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.running import running
from docloom.session import table


def usd(note: Column) -> Column:
    """Spend that a stage notes, over both tiers; broken or absent notes count as nothing. Exact decimals."""
    tier = lambda name: F.coalesce(F.get_json_object(note, f"$.usage.{name}.usd").try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return tier("cheap") + tier("expensive")


def rollup(logs: DataFrame) -> DataFrame:
    """One row per run and repo."""
    return logs.groupBy("run_id", "repo").agg(
        F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.count("*").alias("stages"),
        F.count_if(F.col("status") == "error").alias("errors"), F.sum(usd(F.col("note"))).cast("double").alias("spent"),
    )


def outcomes(decisions: DataFrame) -> DataFrame:
    """(run_id, outcomes): counts per outcome as one text, ordered by outcome."""
    counted = decisions.groupBy("run_id", "outcome").count()
    return counted.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("outcome", F.lit("-")), "count"))), ",").alias("outcomes"))


def run_rollup(spark, sf_dir: str) -> DataFrame:
    return rollup(table(spark, sf_dir, "node_logs")).join(outcomes(table(spark, sf_dir, "decisions")), "run_id", "left")


def newest_runs(spark, sf_dir: str) -> DataFrame:
    """The twenty newest runs: a top-k report."""
    return rollup(table(spark, sf_dir, "node_logs")).orderBy(F.desc("started"), "run_id", "repo").limit(20)


def root_cause_backlog(spark, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "decisions").where("outcome = 'fallback' and root_cause_tag <> ''")
    return failed.groupBy("repo", "root_cause_tag").agg(F.count("*").alias("n"))


def run_positions(spark, sf_dir: str) -> DataFrame:
    """Each stage's place in its run, in order of id."""
    logs = table(spark, sf_dir, "node_logs").select("id", "run_id", "node", F.lit(0).alias("v"))
    return running(logs, ["run_id"], "id", "v").select("id", "run_id", "place", "node")


def spend_guard(spark, sf_dir: str, ceiling: float = 0.5) -> DataFrame:
    """Spend of a run before each stage, the change against the stage before, and whether the stage is still
    below the ceiling."""
    spent = table(spark, sf_dir, "node_logs").select("id", "run_id", usd(F.col("note")).alias("usd"))
    rows = running(spent, ["run_id"], "id", "usd")
    return rows.select("id", "run_id", F.col("before").cast("double").alias("before"), (F.col("usd") - F.coalesce("previous", F.lit(0))).cast("double").alias("delta"), (F.col("before") < ceiling).alias("attempted"))


def latest_decision(spark, sf_dir: str) -> DataFrame:
    """For each page of the logs, by short commit: its latest decision whose commit begins with it."""
    pages = table(spark, sf_dir, "node_logs").where("length(commit) >= 7").select("repo", "path", F.left("commit", F.lit(7)).alias("short")).distinct()
    # a commit begins with a short one of seven characters exactly if its first seven are the same: an equality
    decisions = table(spark, sf_dir, "decisions").select("repo", "path", F.left("commit", F.lit(7)).alias("short"), "id", "outcome")
    met = pages.join(decisions, ["repo", "path", "short"])
    return met.groupBy("repo", "path", "short").agg(F.max("id").alias("id"), F.max_by("outcome", "id").alias("outcome"))


def pending(pages: DataFrame, decisions: DataFrame, least: int = 7) -> DataFrame:
    """For each (repo, path, short) of the pages: its newest decision that waits for review and whose commit begins
    with ``short``, however long that is. Shorter ones than ``least`` characters meet nothing. The first characters are
    an equality; the rest is tested on what meets."""
    head = lambda c: F.left(F.col(c), F.lit(least))
    asked = pages.where(F.length("short") >= least).select("repo", "path", "short", head("short").alias("head")).distinct()
    waiting = decisions.where("outcome = 'pending_review' and commit is not null").select("repo", "path", head("commit").alias("head"), "id", F.col("commit").alias("whole"))
    met = asked.join(waiting, ["repo", "path", "head"]).where(F.startswith("whole", "short"))
    return met.groupBy("repo", "path", "short").agg(F.max("id").alias("id"), F.max_by("whole", "id").alias("commit"))


def pending_decision(spark, sf_dir: str) -> DataFrame:
    return pending(table(spark, sf_dir, "node_logs").select("repo", "path", F.col("commit").alias("short")), table(spark, sf_dir, "decisions"))


def stage_status(spark, sf_dir: str) -> DataFrame:
    """Rows per stage and status, with the shares within the stage."""
    counted = table(spark, sf_dir, "node_logs").groupBy("node", "status").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("node")), 9))


def attempts(spark, sf_dir: str) -> DataFrame:
    """Judged attempts of each decision: number, best and first precision, and whether the best is no better
    than the first by 0.05 after three (no convergence). Broken lists count as none."""
    schema = "array<struct<n int, widened boolean, topK int, precision double, recall double, tier string>>"
    parsed = table(spark, sf_dir, "decisions").select("id", F.from_json("attempts", schema).alias("a"))
    scores = parsed.select("id", F.transform("a", lambda x: x["precision"]).alias("p")).where(F.size("p") > 0)
    return scores.select("id", F.size("p").cast("long").alias("n"), F.array_max("p").alias("best"), F.get("p", F.lit(0)).alias("first"), ((F.size("p") >= 3) & (F.array_max("p") - F.get("p", F.lit(0)) < 0.05)).alias("stuck"))


QUERIES = {f.__name__: f for f in (run_rollup, newest_runs, root_cause_backlog, run_positions, spend_guard, latest_decision, pending_decision, stage_status, attempts)}
_USD = "(coalesce(CASE WHEN json_valid(note) THEN TRY_CAST(json_extract_string(note, '$.usage.cheap.usd') AS DECIMAL(18,6)) END, 0) + coalesce(CASE WHEN json_valid(note) THEN TRY_CAST(json_extract_string(note, '$.usage.expensive.usd') AS DECIMAL(18,6)) END, 0))"
_ROLLUP = f"SELECT run_id, repo, min(created_at) AS started, max(created_at) AS ended, count(*) AS stages, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum({_USD}) AS DOUBLE) AS spent FROM node_logs GROUP BY run_id, repo"
SQL = {
    "run_rollup": f"WITH r AS ({_ROLLUP}), o AS (SELECT run_id, string_agg(coalesce(outcome, '-') || ':' || n, ',' ORDER BY coalesce(outcome, '-') || ':' || n) AS outcomes FROM (SELECT run_id, outcome, count(*) AS n FROM decisions GROUP BY 1, 2) GROUP BY run_id) SELECT r.*, o.outcomes FROM r LEFT JOIN o USING (run_id)",
    "newest_runs": f"SELECT * FROM ({_ROLLUP}) ORDER BY started DESC, run_id, repo LIMIT 20",
    "root_cause_backlog": "SELECT repo, root_cause_tag, count(*) AS n FROM decisions WHERE outcome = 'fallback' AND root_cause_tag <> '' GROUP BY 1, 2",
    "run_positions": "SELECT id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY id) AS place, node FROM node_logs",
    "spend_guard": f"WITH s AS (SELECT id, run_id, {_USD} AS usd FROM node_logs), w AS (SELECT id, run_id, coalesce(sum(usd) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, usd - coalesce(lag(usd) OVER (PARTITION BY run_id ORDER BY id), 0) AS d FROM s) SELECT id, run_id, CAST(b AS DOUBLE) AS before, CAST(d AS DOUBLE) AS delta, b < 0.5 AS attempted FROM w",
    "latest_decision": "WITH p AS (SELECT DISTINCT repo, path, left(commit, 7) AS short FROM node_logs WHERE length(commit) >= 7) SELECT p.repo, p.path, p.short, max(d.id) AS id, arg_max(d.outcome, d.id) AS outcome FROM p JOIN decisions d ON d.repo = p.repo AND d.path = p.path AND starts_with(d.commit, p.short) GROUP BY 1, 2, 3",
    "pending_decision": "WITH p AS (SELECT DISTINCT repo, path, commit AS short FROM node_logs WHERE length(commit) >= 7) SELECT p.repo, p.path, p.short, max(d.id) AS id, arg_max(d.commit, d.id) AS commit FROM p JOIN decisions d ON d.repo = p.repo AND d.path = p.path AND left(d.commit, 7) = left(p.short, 7) AND starts_with(d.commit, p.short) WHERE d.outcome = 'pending_review' GROUP BY 1, 2, 3",
    "stage_status": "SELECT node, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY node), 9) AS share FROM node_logs GROUP BY 1, 2",
    "attempts": "WITH d AS (SELECT id, list_transform(CAST(attempts AS JSON[]), lambda x: CAST(json_extract(x, '$.precision') AS DOUBLE)) AS p FROM decisions WHERE json_valid(attempts)) SELECT id, len(p) AS n, list_max(p) AS best, p[1] AS first, len(p) >= 3 AND list_max(p) - p[1] < 0.05 AS stuck FROM d WHERE len(p) > 0",
}
