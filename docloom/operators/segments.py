"""Statistics per segment: shares with intervals, correlations, gaps, windows, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stats import pearson, wilson
from docloom.session import checkpointed, table


def counts(df: DataFrame, keys: list[str], hit) -> DataFrame:
    """(keys, n, k): rows and hits of each segment."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))


def segment_readiness(spark, sf_dir: str, least: int = 20, threshold: float = 0.3) -> DataFrame:
    """Share of approved claims per repository among the reviewed ones, its interval, progress to the least
    number, and whether both number and lower bound suffice."""
    seg = counts(table(spark, sf_dir, "claims").where("approved is not null"), ["repo"], F.col("approved") & F.col("supported"))
    low, high = wilson(F.col("k"), F.col("n"))
    return seg.select("repo", "n", "k", F.round(F.col("k") / F.col("n"), 9).alias("share"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(F.least(F.lit(1.0), F.col("n") / least), 9).alias("progress"), ((F.col("n") >= least) & (low >= threshold)).alias("ready"))


def score_correlation(spark, sf_dir: str) -> DataFrame:
    """Correlation per repository of a decision's similarity score with its number of attempts."""
    scored = table(spark, sf_dir, "decisions").select("repo", F.get_json_object("metrics", "$.minChunkSimilarity").try_cast("double").alias("score"), F.json_array_length("attempts").alias("attempts"))
    return pearson(scored, ["repo"], "score", "attempts").select("repo", "n", F.round("r", 6).alias("r"))


def review_gap(spark, sf_dir: str, least: int = 5, gap_points: float = 10.0) -> DataFrame:
    """Per repository: share of all claims that are supported, share of the reviewed ones that were confirmed,
    the gap in points, and whether it drifts (more than ``gap_points`` with at least ``least`` reviews)."""
    c = table(spark, sf_dir, "claims").groupBy("repo").agg(F.count("*").alias("n"), F.count_if("supported").alias("supported"), F.count("approved").alias("reviewed"), F.count_if(F.col("approved")).alias("confirmed"))
    raw, confirmed = F.col("supported") * 100 / F.col("n"), F.col("confirmed") * 100 / F.nullif(F.col("reviewed"), F.lit(0))
    return c.select("repo", "n", "reviewed", F.round(raw, 6).alias("raw"), F.round(confirmed, 6).alias("confirmed_share"), F.round(raw - confirmed, 6).alias("gap"), F.coalesce((F.col("reviewed") >= least) & (F.round(raw - confirmed, 6) > gap_points), F.lit(False)).alias("drifts"))


def first_failing_gate(spark, sf_dir: str) -> DataFrame:
    """Rows per repository and first failing check, in order of severity."""
    r = table(spark, sf_dir, "decisions").select("repo", F.from_json("attempts", "array<struct<precision double, recall double>>").alias("a"))
    last = r.select("repo", F.try_element_at("a", F.lit(-1)).alias("l"))
    gate = F.when(F.col("l").isNull(), "none").when(F.col("l.precision") < 0.9, "precision").when(F.col("l.recall") < 0.85, "recall").otherwise("passed")
    return last.groupBy("repo", gate.alias("gate")).agg(F.count("*").alias("n"))


def day_windows(spark, sf_dir: str) -> DataFrame:
    """Stages and errors per day, in UTC."""
    logs = table(spark, sf_dir, "node_logs")
    return logs.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))


def trailing_day(spark, sf_dir: str) -> DataFrame:
    """Events of the last 24 hours before the newest one, by type. The newest time is one value."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("t")).first()["t"]
    if newest is None:
        return events.groupBy("event_type").agg(F.count("*").alias("n"))
    return events.where(F.col("ts") >= F.lit(newest).cast(events.schema["ts"].dataType) - F.expr("interval 24 hours")).groupBy("event_type").agg(F.count("*").alias("n"))


def sliding_day(spark, sf_dir: str) -> DataFrame:
    """Events per type in windows of a day that start every six hours."""
    events = table(spark, sf_dir, "events")
    w = F.window("ts", "24 hours", "6 hours")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_at"), "event_type", "n")


def even_sample(spark, sf_dir: str, rows: int = 100) -> DataFrame:
    """``rows`` claims evenly spaced by id: positions floor(i * n / rows). Ids are range-partitioned and sorted;
    a row's position is its place in the partition plus the sizes of those before, so nothing is sorted in one
    task. The sample is the feature."""
    ids = table(spark, sf_dir, "claims").select("id")
    placed = checkpointed(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("m", F.monotonically_increasing_id()))
    part = placed.withColumn("p", F.shiftright("m", 33)).withColumn("o", F.col("m").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["p"], r["count"]) for r in part.groupBy("p").count().collect())  # one row per partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    if not total:
        return ids.select(F.lit(0).cast("long").alias("place"), "id").limit(0)
    starts = spark.createDataFrame(before, "p long, start long")
    wanted = spark.createDataFrame([(int(i * (total / rows)) if total > rows else i,) for i in range(min(rows, total))], "place long")
    spots = part.join(F.broadcast(starts), "p").select((F.col("o") + F.col("start")).alias("place"), "id")
    return spots.join(F.broadcast(wanted), "place")


def table_counts(spark, sf_dir: str) -> DataFrame:
    """Rows of each of the domain's tables."""
    names = ["change_units", "node_logs", "decisions", "claims", "repo_facts", "vector_points", "context_state", "documents"]
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context_pivot(spark, sf_dir: str) -> DataFrame:
    """Points per repository, one column per kind."""
    points = table(spark, sf_dir, "vector_points").groupBy("repo").pivot("kind", ["approved", "brief", "code", "site_doc", "source_doc"]).count()
    return points.na.fill(0)


def segment_trail(spark, sf_dir: str) -> DataFrame:
    """First and last decision per repository and outcome, with the distinct actions in order."""
    d = table(spark, sf_dir, "decisions")
    return d.groupBy("repo", "outcome").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("reviewer_action")), ",").alias("actions"))


QUERIES = {f.__name__: f for f in (segment_readiness, score_correlation, review_gap, first_failing_gate, day_windows, trailing_day, sliding_day, even_sample, table_counts, context_pivot, segment_trail)}
_W = "(k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)"
SQL = {
    "segment_readiness": f"WITH s AS (SELECT repo, count(*) AS n0, count(*) FILTER (WHERE approved AND supported) AS k0 FROM claims WHERE approved IS NOT NULL GROUP BY 1), d AS (SELECT repo, n0, k0, CAST(n0 AS DOUBLE) AS n, CAST(k0 AS DOUBLE) AS k FROM s), w AS (SELECT *, greatest(0, {_W.format('-')}) AS lo, least(1, {_W.format('+')}) AS hi FROM d) SELECT repo, n0 AS n, k0 AS k, round(k / n, 9) AS share, round(lo, 9) AS low, round(hi, 9) AS high, round(least(1, n / 20), 9) AS progress, n >= 20 AND lo >= 0.3 AS ready FROM w",
    "score_correlation": "WITH d AS (SELECT repo, CASE WHEN json_valid(metrics) THEN TRY_CAST(json_extract_string(metrics, '$.minChunkSimilarity') AS DOUBLE) END AS x, CASE WHEN json_valid(attempts) THEN CAST(json_array_length(attempts) AS DOUBLE) END AS y FROM decisions), p AS (SELECT * FROM d WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT *, avg(x) OVER (PARTITION BY repo) AS mx, avg(y) OVER (PARTITION BY repo) AS my FROM p), s AS (SELECT repo, count(*) AS n, sum((x - mx) * (y - my)) AS sxy, sum((x - mx) ** 2) AS sxx, sum((y - my) ** 2) AS syy FROM m GROUP BY 1) SELECT repo, n, CASE WHEN n >= 5 AND sxx > 1e-12 AND syy > 1e-12 THEN round(sxy / sqrt(sxx * syy), 6) END AS r FROM s",
    "review_gap": "WITH c AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE supported) AS s, count(approved) AS reviewed, count(*) FILTER (WHERE approved) AS k FROM claims GROUP BY 1), g AS (SELECT *, s * 100 / n AS raw, k * 100 / nullif(reviewed, 0) AS conf FROM c) SELECT repo, n, reviewed, round(raw, 6) AS raw, round(conf, 6) AS confirmed_share, round(raw - conf, 6) AS gap, coalesce(reviewed >= 5 AND round(raw - conf, 6) > 10, false) AS drifts FROM g",
    "first_failing_gate": "WITH d AS (SELECT repo, CASE WHEN json_valid(attempts) AND json_array_length(attempts) > 0 THEN CAST(attempts AS JSON[])[-1] END AS l FROM decisions), v AS (SELECT repo, l, CAST(json_extract(l, '$.precision') AS DOUBLE) AS p, CAST(json_extract(l, '$.recall') AS DOUBLE) AS r FROM d) SELECT repo, CASE WHEN l IS NULL THEN 'none' WHEN p < 0.9 THEN 'precision' WHEN r < 0.85 THEN 'recall' ELSE 'passed' END AS gate, count(*) AS n FROM v GROUP BY 1, 2",
    "day_windows": "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS errors FROM node_logs GROUP BY 1",
    "trailing_day": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1",
    "sliding_day": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(6 * CAST(k AS INTEGER)) AS start_at, event_type FROM events, range(4) AS r(k)) SELECT CAST(start_at AS TIMESTAMP) AS start_at, event_type, count(*) AS n FROM w GROUP BY 1, 2",
    "even_sample": "WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM claims), w AS (SELECT DISTINCT CAST(floor(i * (n / 100)) AS BIGINT) AS place FROM range(100) AS r(i), (SELECT count(*) AS n FROM claims)) SELECT place, id FROM p SEMI JOIN w USING (place)",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("change_units", "node_logs", "decisions", "claims", "repo_facts", "vector_points", "context_state", "documents")),
    "context_pivot": "SELECT repo, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ("approved", "brief", "code", "site_doc", "source_doc")) + " FROM vector_points GROUP BY 1",
    "segment_trail": "SELECT repo, outcome, min(created_at) AS first_at, max(created_at) AS last_at, coalesce(string_agg(DISTINCT reviewer_action, ',' ORDER BY reviewer_action), '') AS actions FROM decisions GROUP BY 1, 2",
}
