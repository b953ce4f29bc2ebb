"""What judges say of drafts: shares of supported claims, scores, verdicts, notes as spans, queues for audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import fold
from docloom.operators.pages import worst_attempt
from docloom.session import table


def clamp01(value: Column) -> Column:
    """Within 0 and 1; null and what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))))


def share(part: Column, whole: Column) -> Column:
    """1 where there is nothing to share."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def score(claims: Column, unsupported: Column) -> Column:
    """Share of claims that stand; more unsupported ones than claims count as all, none at all as 1."""
    return share(claims - F.least(F.greatest(unsupported, F.lit(0)), claims), claims)


def claim_shares(claims: Column, facts: Column) -> Column:
    """(precision, recall, core_recall) of lists of claims (supported) and facts (covered, core); 1 for empty lists."""
    size = lambda a, f: F.size(F.filter(a, lambda x: F.coalesce(f(x), F.lit(False))))
    core = F.filter(facts, lambda x: F.coalesce(x["core"], F.lit(False)))
    return F.struct(
        share(size(claims, lambda x: x["supported"]), F.size(claims)).alias("precision"), share(size(facts, lambda x: x["covered"]), F.size(facts)).alias("recall"), share(size(core, lambda x: x["covered"]), F.size(core)).alias("core_recall"),
    )


# Replies that are a label only, with their score.
LABELS = {"faithful": 1.0, "partial": 0.8, "unfaithful": 0.0, "hallucinated": 0.0, "factual": 1.0}


def verdict(reply: Column) -> Column:
    """(state, claims, unsupported, score, quotes, note) of a judge's reply: a bare label, JSON with or without a fence
    or words around, a count in place of the list of quotes; state ``rejected`` for all else."""
    bare = F.regexp_replace(F.lower(F.trim(reply)), "[^a-z]", "")
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    claims_text = F.get_json_object(inner, "$.claims")
    claims = F.when(claims_text.try_cast("int").isNotNull(), F.greatest(F.lit(0), claims_text.try_cast("int")))
    listed, quotes_text = F.from_json(F.get_json_object(inner, "$.unsupported"), "array<string>"), F.get_json_object(inner, "$.unsupported")
    quotes = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda q: F.left(F.trim(q), F.lit(200))), lambda q: q != "")
    counted = F.when(~F.coalesce(quotes_text.startswith("["), F.lit(False)), quotes_text.try_cast("int"))
    bad = F.least(F.greatest(F.coalesce(counted, F.size(quotes)), F.lit(0)), claims)
    label = labels[bare]
    as_label = F.struct(F.lit("label").alias("state"), F.lit(None).cast("int").alias("claims"), F.lit(None).cast("int").alias("unsupported"), label.alias("score"), F.array().cast("array<string>").alias("quotes"), F.lit("label only").alias("note"))
    note = F.when(claims == 0, "no claims").when(counted.isNotNull(), "count in place of quotes").otherwise("")
    as_json = F.struct(F.lit("json").alias("state"), claims.alias("claims"), bad.alias("unsupported"), F.round(score(claims, bad), 3).alias("score"), quotes.alias("quotes"), note.alias("note"))
    none = F.struct(F.lit("rejected").alias("state"), F.lit(None).cast("int").alias("claims"), F.lit(None).cast("int").alias("unsupported"), F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("quotes"), F.lit("").alias("note"))
    return F.when(label.isNotNull(), as_label).when(claims.isNotNull(), as_json).otherwise(none)


def documents_of(row: Column, columns: list[tuple[int, Column]]) -> Column:
    """The texts of retrieved documents, in order, from either shape: a JSON list (of texts, or of objects that hold
    the content themselves or in ``document``), else one column per document, taken by number."""
    objects = F.from_json(row, "array<struct<`document.content`:string,content:string,document:struct<content:string>>>")
    plain = F.from_json(row, "array<string>")
    held = F.transform(objects, lambda d: F.coalesce(d["document.content"], d["document"]["content"], d["content"]))
    from_json = F.when(F.exists(held, lambda x: x.isNotNull()), held).otherwise(plain)
    flat = F.array(*[c for _, c in sorted(columns, key=lambda x: x[0])]) if columns else F.array().cast("array<string>")
    return F.filter(F.coalesce(from_json, flat), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def reference_text(source: Column, changed: Column, documents: Column) -> Column:
    """What a judge may hold for true: the source, with the changed files named, then the numbered documents."""
    head = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("[SOURCE FILES"), F.when(F.size(changed) > 0, F.concat(F.lit(" (changed in this commit: "), F.array_join(changed, ", "), F.lit(")"))).otherwise(""), F.lit("]\n"), source))
    return F.array_join(F.concat(F.when(head.isNotNull(), F.array(head)).otherwise(F.array().cast("array<string>")), F.transform(documents, lambda d, i: F.concat(F.lit("[chunk "), (i + 1).cast("string"), F.lit("]\n"), d))), "\n\n")


def page_metrics(spark, sf_dir: str) -> DataFrame:
    """Per page with claims: their number, the share that is supported, and the score with the unsupported ones
    taken off; claims are counted where they lie, so a page with very many is no large list."""
    claims = table(spark, sf_dir, "claims").groupBy("repo", "path").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"))
    return claims.select("repo", "path", "claims", F.round(share(F.col("supported"), F.col("claims")), 9).alias("precision"), F.round(score(F.col("claims"), F.col("claims") - F.col("supported")), 3).alias("score"))


def fact_recall(spark, sf_dir: str) -> DataFrame:
    """Per repository: the share of its facts, and of its api facts, whose file a supported claim names as evidence."""
    facts = table(spark, sf_dir, "repo_facts").select("repo", "source_path", (F.col("category") == "api").alias("core"))
    named = table(spark, sf_dir, "claims").where("supported").select("repo", F.col("evidence").alias("source_path"), F.lit(1).alias("hit")).distinct()
    n = facts.join(named, ["repo", "source_path"], "left").groupBy("repo").agg(F.count("*").alias("facts"), F.count("hit").alias("covered"), F.count_if("core").alias("core"), F.count_if(F.col("core") & F.col("hit").isNotNull()).alias("core_covered"))
    return n.select("repo", "facts", F.round(share(F.col("covered"), F.col("facts")), 9).alias("recall"), F.round(share(F.col("core_covered"), F.col("core")), 9).alias("core_recall"))


def note_scores(spark, sf_dir: str) -> DataFrame:
    """Scores that stages note, within 0 and 1; what is no number counts as 0."""
    return table(spark, sf_dir, "node_logs").where("try_parse_json(note) is not null").select("id", clamp01(F.get_json_object("note", "$.precision")).alias("precision"))


def review_spans(spark, sf_dir: str) -> DataFrame:
    """Each decision as a span: an error where a page was rejected, and its attributes without the empty ones."""
    names = ["repo", "path", "commit", "outcome", "reviewer_action", "root_cause_tag"]
    attributes = F.array(*[F.when(F.col(n).isNotNull() & (F.col(n) != ""), F.concat(F.lit(f"{n}="), n)) for n in names])
    rejected = F.col("outcome").eqNullSafe("fallback")
    return table(spark, sf_dir, "decisions").select("id", F.when(rejected, "ERROR").otherwise("OK").alias("status"), F.array_join(F.filter(attributes, lambda a: a.isNotNull()), ";").alias("attributes"))


def score_annotations(spark, sf_dir: str, faithful: float = 0.9, partial: float = 0.7) -> DataFrame:
    """The worst attempt of each decision as an annotation: score, label, and which attempt it was."""
    label = F.when(F.col("precision") >= faithful, "faithful").when(F.col("precision") >= partial, "partial").otherwise("unfaithful")
    return worst_attempt(spark, sf_dir).select("id", "precision", label.alias("label"), F.concat(F.lit("attempt "), F.col("n").cast("string")).alias("explanation"))


def findings(spark, sf_dir: str, threshold: float = 0.7, most: int = 20) -> DataFrame:
    """Per repository: lines of the decisions below the threshold, worst first, at most ``most`` (a report), and how
    many there are."""
    low = worst_attempt(spark, sf_dir).where(F.col("precision") < threshold).join(table(spark, sf_dir, "decisions").select("id", "repo", "path"), "id")
    totals = low.groupBy("repo").agg(F.count("*").alias("flagged"))
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("precision", "id"))).where(F.col("r") <= most)
    line = F.concat(F.lpad(F.col("r").cast("string"), 3, " "), F.lit(". "), F.coalesce("path", F.lit("-")), F.lit(" ("), F.round(F.col("precision") * 1000).cast("long").cast("string"), F.lit(" of 1000)"))
    return ranked.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).join(totals, "repo")


AUDITED = "outcome = 'published'"


def sampled(spark, sf_dir: str, rate: float = 0.1) -> DataFrame:
    """Published decisions drawn for an audit, by a hash of their id, so the draw is the same each time."""
    draw = F.conv(F.left(F.md5(F.col("id").cast("string")), F.lit(8)), 16, 10).cast("long") / F.lit(2**32)
    return table(spark, sf_dir, "decisions").where(AUDITED).where(draw < rate)


def pending_audits(spark, sf_dir: str, most: int = 50) -> DataFrame:
    """The first drawn decisions without a verdict (a reason): only what identifies them, so the auditor is blind. A
    queue's head."""
    open_ = sampled(spark, sf_dir).where("coalesce(reason, '') = ''")
    return open_.orderBy("id").limit(most).select("id", "repo", F.concat("repo", F.lit("@"), "commit", F.lit(":"), "path").alias("change_unit"))


def audit_gap(spark, sf_dir: str) -> DataFrame:
    """Per repository: published decisions, those drawn, and those drawn that have a verdict."""
    drawn = sampled(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("sampled"), F.count_if(F.coalesce("reason", F.lit("")) != "").alias("audited"))
    every = table(spark, sf_dir, "decisions").where(AUDITED).groupBy("repo").agg(F.count("*").alias("published"))
    return every.join(drawn, "repo", "left").select("repo", "published", F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("audited", F.lit(0)).alias("audited"))


def routed_comments(spark, sf_dir: str, most: int = 30) -> DataFrame:
    """The first comments of each run: to the page of their path where the repository has one, else to all of its
    pages, whose number is given."""
    order = Window.partitionBy("run_id").orderBy("id")
    said = table(spark, sf_dir, "decisions").where("reason <> ''").select("id", "run_id", "repo", "path").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    pages = table(spark, sf_dir, "documents").where("repo is not null and path is not null").select("repo", "path").distinct()
    met = said.join(pages.withColumn("own", F.lit(True)), ["repo", "path"], "left").join(pages.groupBy("repo").agg(F.count("*").alias("all_pages")), "repo", "left")
    return met.select("id", F.coalesce("own", F.lit(False)).alias("own"), F.when(F.col("own"), 1).otherwise(F.coalesce("all_pages", F.lit(0))).cast("long").alias("pages"))


def fact_lines(spark, sf_dir: str) -> DataFrame:
    """Each fact as a line for a reader; a flagged one as a conflict with its detail."""
    detail = F.when(F.coalesce("flag_detail", F.lit("")) != "", F.concat(F.lit(" ("), "flag_detail", F.lit(")"))).otherwise("")
    line = F.when(F.col("flag").isNotNull(), F.concat(F.lit("CONFLICT: "), "fact", detail)).otherwise(F.concat(F.lit("- "), "fact", F.when(F.coalesce("source_path", F.lit("")) != "", F.concat(F.lit(" ["), "source_path", F.lit("]"))).otherwise("")))
    return table(spark, sf_dir, "repo_facts").select("id", line.alias("line"))


def required_documentation(spark, sf_dir: str) -> DataFrame:
    """Names of stages' evidence that a repository's claims state without approval: per repository and evidence file,
    claims in all and approved ones, where none is approved."""
    per = table(spark, sf_dir, "claims").where("evidence <> ''").groupBy("repo", "evidence").agg(F.count("*").alias("claims"), F.count_if("approved").alias("approved"))
    return per.where("approved = 0").select("repo", "evidence", "claims")


def repeated_reasons(spark, sf_dir: str) -> DataFrame:
    """Reasons that several decisions give, case and blanks aside, with the first decision and their number."""
    said = table(spark, sf_dir, "decisions").where("reason <> ''").select("id", fold(F.col("reason")).alias("reason"))
    return said.groupBy("reason").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def without_bodies(df: DataFrame, *bodies: str) -> DataFrame:
    """Results for a report: long texts go, their lengths stay."""
    return df.select(*[c for c in df.columns if c not in bodies], *[F.coalesce(F.length(b), F.lit(0)).cast("long").alias(f"{b}_chars") for b in bodies])


def run_results(spark, sf_dir: str) -> DataFrame:
    """Decisions without their reasons, metrics and attempts."""
    return without_bodies(table(spark, sf_dir, "decisions"), "reason", "metrics", "attempts").drop("created_at")


QUERIES = {f.__name__: f for f in (page_metrics, fact_recall, note_scores, review_spans, score_annotations, findings, pending_audits, audit_gap, routed_comments, fact_lines, required_documentation, repeated_reasons, run_results)}
_WORST = "SELECT id, CAST(arg_min(n, (p, n)) AS BIGINT) AS n, min(p) AS precision FROM (SELECT id, CAST(json_extract(x, '$.n') AS INT) AS n, CAST(json_extract(x, '$.precision') AS DOUBLE) AS p FROM (SELECT id, unnest(CAST(attempts AS JSON[])) AS x FROM decisions WHERE json_valid(attempts))) WHERE p IS NOT NULL GROUP BY id"
_DRAWN = "outcome = 'published' AND CAST('0x' || left(md5(CAST(id AS VARCHAR)), 8) AS UBIGINT) / 4294967296 < 0.1"
SQL = {
    "page_metrics": "WITH c AS (SELECT repo, path, count(*) AS claims, count(*) FILTER (WHERE supported) AS s FROM claims GROUP BY 1, 2) SELECT repo, path, claims, round(s / claims, 9) AS precision, round(s / claims, 3) AS score FROM c",
    "fact_recall": "WITH n AS (SELECT DISTINCT repo, evidence AS source_path FROM claims WHERE supported), f AS (SELECT f.repo, category = 'api' AS core, n.source_path IS NOT NULL AS hit FROM repo_facts f LEFT JOIN n USING (repo, source_path)), g AS (SELECT repo, count(*) AS facts, count(*) FILTER (WHERE hit) AS c, count(*) FILTER (WHERE core) AS k, count(*) FILTER (WHERE core AND hit) AS kc FROM f GROUP BY 1) SELECT repo, facts, round(c / facts, 9) AS recall, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE round(kc / k, 9) END AS core_recall FROM g",
    "note_scores": "SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(json_extract_string(note, '$.precision') AS DOUBLE), 0))) AS precision FROM (SELECT id, note FROM node_logs WHERE json_valid(note))",
    "review_spans": "SELECT id, CASE WHEN outcome = 'fallback' THEN 'ERROR' ELSE 'OK' END AS status, concat_ws(';', " + ", ".join(f"CASE WHEN {n} <> '' THEN '{n}=' || {n} END" for n in ("repo", "path", "commit", "outcome", "reviewer_action", "root_cause_tag")) + ") AS attributes FROM decisions",
    "score_annotations": f"SELECT id, precision, CASE WHEN precision >= 0.9 THEN 'faithful' WHEN precision >= 0.7 THEN 'partial' ELSE 'unfaithful' END AS label, 'attempt ' || n AS explanation FROM ({_WORST})",
    "findings": f"WITH l AS (SELECT w.id, w.precision, d.repo, d.path, row_number() OVER (PARTITION BY d.repo ORDER BY w.precision, w.id) AS r, count(*) OVER (PARTITION BY d.repo) AS flagged FROM ({_WORST}) w JOIN decisions d USING (id) WHERE w.precision < 0.7) SELECT repo, string_agg(lpad(CAST(r AS VARCHAR), 3, ' ') || '. ' || coalesce(path, '-') || ' (' || CAST(round(precision * 1000) AS BIGINT) || ' of 1000)', chr(10) ORDER BY r) AS lines, max(flagged) AS flagged FROM l WHERE r <= 20 AND repo IS NOT NULL GROUP BY repo",
    "pending_audits": f"SELECT id, repo, repo || '@' || commit || ':' || path AS change_unit FROM decisions WHERE {_DRAWN} AND coalesce(reason, '') = '' ORDER BY id LIMIT 50",
    "audit_gap": f"SELECT repo, count(*) AS published, count(*) FILTER (WHERE {_DRAWN}) AS sampled, count(*) FILTER (WHERE {_DRAWN} AND coalesce(reason, '') <> '') AS audited FROM decisions WHERE outcome = 'published' GROUP BY 1",
    "routed_comments": "WITH s AS (SELECT id, repo, path, row_number() OVER (PARTITION BY run_id ORDER BY id) AS r FROM decisions WHERE reason <> ''), p AS (SELECT DISTINCT repo, path FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL), a AS (SELECT repo, count(*) AS n FROM p GROUP BY 1) SELECT id, p.repo IS NOT NULL AS own, CASE WHEN p.repo IS NOT NULL THEN 1 ELSE coalesce(a.n, 0) END AS pages FROM s LEFT JOIN p ON p.repo = s.repo AND p.path = s.path LEFT JOIN a ON a.repo = s.repo WHERE r <= 30",
    "fact_lines": "SELECT id, CASE WHEN flag IS NOT NULL THEN 'CONFLICT: ' || fact || CASE WHEN coalesce(flag_detail, '') <> '' THEN ' (' || flag_detail || ')' ELSE '' END ELSE '- ' || fact || CASE WHEN coalesce(source_path, '') <> '' THEN ' [' || source_path || ']' ELSE '' END END AS line FROM repo_facts",
    "required_documentation": "SELECT repo, evidence, count(*) AS claims FROM claims WHERE evidence <> '' GROUP BY 1, 2 HAVING count(*) FILTER (WHERE approved) = 0",
    "run_results": "SELECT id, run_id, repo, path, commit, outcome, reviewer_action, root_cause_tag, CAST(coalesce(length(reason), 0) AS BIGINT) AS reason_chars, CAST(coalesce(length(metrics), 0) AS BIGINT) AS metrics_chars, CAST(coalesce(length(attempts), 0) AS BIGINT) AS attempts_chars FROM decisions",
    "repeated_reasons": "SELECT trim(regexp_replace(lower(reason), '[ \\t\\r\\n]+', ' ', 'g')) AS reason, min(id) AS first, count(*) AS n FROM decisions WHERE reason <> '' GROUP BY 1 HAVING count(*) > 1",
}
