"""Pages against files: which page belongs to a file, what it declares, covers, introduces or mentions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import matches_any, selected, tidy_path
from docloom.operators.changes import DECLARATION
from docloom.session import table

WORD = r"([A-Za-z_][A-Za-z0-9_]*)"
TOKEN = r"([A-Za-z0-9_]+)"
IDENTIFIER = r"^(?:[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*)$"
# Endings of files that hold secrets.
SECRET_PATH = r"[A-Za-z0-9_./-]*(?:\.env(?:\.[a-z]+)?|\.pem|\.key|\.p12|\.jks|id_rsa)\b"
FRONT = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---"
#: Limits of one delivery's list of changed files; ``None`` for no limit.
MAX_FILES, MAX_BYTES = 200, 16_384


def page_of_file(spark, sf_dir: str) -> DataFrame:
    """For each source file of the facts, the document of its repository whose path is it or ends in it: an
    exact match is preferred, several others are ambiguous (null). All endings of a document's path at folder
    boundaries are made rows (as many as the path has folders), so the match is an equality."""
    docs = table(spark, sf_dir, "documents").where("repo is not null and path is not null").select("repo", tidy_path(F.col("path")).alias("page")).distinct()
    parts = F.split("page", "/")
    tails = docs.select("repo", "page", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("file"))
    files = table(spark, sf_dir, "repo_facts").where("source_path <> '' and not startswith(source_path, '@')").select("repo", tidy_path(F.col("source_path")).alias("file")).distinct()
    met = files.join(tails, ["repo", "file"]).groupBy("repo", "file").agg(F.count("*").alias("pages"), F.max(F.col("page") == F.col("file")).alias("exact"), F.min("page").alias("only"))
    return met.select("repo", "file", "pages", F.when(F.col("exact"), F.col("file")).when(F.col("pages") == 1, F.col("only")).alias("page"))


def front_matter(spark, sf_dir: str) -> DataFrame:
    """Title and commit in each document's leading block; empty where there is none."""
    block = F.regexp_extract("text", FRONT, 1)
    field = lambda name: F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", field("title").alias("title"), field("repo_commit").alias("repo_commit"))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)))


def declared_coverage(spark, sf_dir: str) -> DataFrame:
    """Names that a file declares, how many of them the published page has as a word, and their share; null
    where nothing is declared."""
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after is not null")
    names = F.array_distinct(F.regexp_extract_all("after", F.lit(DECLARATION), F.lit(1)))
    n = units.select("change_id", names.alias("names"), words(F.coalesce("existing", F.lit(""))).alias("w"))
    covered = F.size(F.array_intersect("names", "w"))
    return n.select("change_id", F.size("names").cast("long").alias("declared"), covered.cast("long").alias("covered"), F.round(covered / F.nullif(F.size("names"), F.lit(0)), 9).alias("share"))


def new_identifiers(spark, sf_dir: str) -> DataFrame:
    """Identifiers that a page's new text has and the published one has not. Words are cut first and judged one by
    one: a pattern that searches for identifiers in the text is quadratic in long runs of letters."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and after is not null")
    tokens = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(1))), lambda w: w.rlike(IDENTIFIER))
    return units.select("change_id", F.explode(F.array_except(tokens(F.col("after")), tokens(F.col("existing")))).alias("identifier"))


def clean_files(spark, sf_dir: str, most: int | None = MAX_FILES, bytes_: int | None = MAX_BYTES) -> DataFrame:
    """Changed files of a delivery, trimmed, each once, without absolute paths and ``..``, up to the first that
    would exceed the number or the total length; the fold stops counting there."""
    trimmed = F.array_distinct(F.filter(F.transform("changedFiles", lambda f: F.trim(f)), lambda f: (f != "") & ~f.startswith("/") & ~f.rlike(r"(^|/)\.\.(/|$)")))
    most, bytes_ = most or 2**31 - 1, bytes_ or 2**31 - 1
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(True).alias("open"))
    fold = F.aggregate(trimmed, start, lambda a, f: F.when(a["open"] & (a["n"] < most) & (a["b"] + F.octet_length(f) <= bytes_), F.struct((a["n"] + 1).alias("n"), (a["b"] + F.octet_length(f)).alias("b"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["b"].alias("b"), F.lit(False).alias("open"))))
    return table(spark, sf_dir, "change_units").where("size(changedFiles) > 0").select("change_id", fold.alias("k")).select("change_id", F.col("k.n").cast("long").alias("files"), F.col("k.b").cast("long").alias("bytes"))


SCOPE, EXCLUDE = ["src/**", "api/**", "lib/**", "**/*.go"], ["**/*.min.js", "**/vendor/**", "**/generated/**"]


def scoped_changes(spark, sf_dir: str) -> DataFrame:
    """Changed files of each delivery that are in scope, and those left out by exclusion."""
    path = lambda f: tidy_path(f)
    units = table(spark, sf_dir, "change_units").where("size(changedFiles) > 0")
    return units.select("change_id", F.size(F.filter("changedFiles", lambda f: selected(path(f), SCOPE, EXCLUDE))).cast("long").alias("chosen"), F.size(F.filter("changedFiles", lambda f: matches_any(path(f), EXCLUDE))).cast("long").alias("excluded"))


def redacted_paths(spark, sf_dir: str) -> DataFrame:
    """Documents that name files holding secrets, with a digest of the text without these names."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    whole = r"(?<![A-Za-z0-9_./-])" + SECRET_PATH  # a run is tried from its start only, which keeps the search linear
    return docs.select("doc_id", F.regexp_count("text", F.lit(whole)).cast("long").alias("paths"), F.md5(F.regexp_replace("text", whole, "[path removed]")).alias("digest"))


def worst_attempt(spark, sf_dir: str) -> DataFrame:
    """Each decision's attempt of least precision, the first of equal ones."""
    parsed = table(spark, sf_dir, "decisions").select("id", F.from_json("attempts", "array<struct<n int, precision double, tier string>>").alias("a"))
    rows = parsed.select("id", F.explode("a").alias("x")).where("x.precision is not null")
    return rows.groupBy("id").agg(F.min(F.struct("x.precision", "x.n")).alias("w")).select("id", F.col("w.n").cast("long").alias("n"), F.col("w.precision").alias("precision"))


def low_scores(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Decisions whose worst attempt is below the threshold, with the newest claim of their page (0: none)."""
    low = worst_attempt(spark, sf_dir).where(F.col("precision") < threshold)
    pages = table(spark, sf_dir, "decisions").select("id", "repo", "path")
    claim = table(spark, sf_dir, "claims").groupBy("repo", "path").agg(F.max("id").alias("claim_id"))
    return low.join(pages, "id").join(claim, ["repo", "path"], "left").select("id", "precision", F.coalesce("claim_id", F.lit(0)).alias("claim_id"))


def audit_sample(spark, sf_dir: str, rate: float = 0.1) -> DataFrame:
    """A sample of published decisions that comes out the same however often it is drawn: the row's hash decides.
    The sample is the feature."""
    share = F.conv(F.left(F.md5(F.col("id").cast("string")), F.lit(8)), 16, 10).cast("long") / F.lit(2**32)
    return table(spark, sf_dir, "decisions").where("outcome = 'published'").where(share < rate).select("id", "repo")


CLOSES = re.compile(r"\s*(?:[,:}\]]|\Z)")


def mended(text: str) -> str:
    """The text from its first bracket to the one that closes it, or to the end with what is open closed. Within a
    string a quote closes it only before ``, : } ]`` or the end; any other is escaped. Commas before a closing
    bracket go."""
    start = re.search(r"[{\[]", text)
    if not start:
        return ""
    out: list[str] = []
    open_: list[str] = []
    inside = False
    for m in re.finditer(r'\\.|["{}\[\]]|[^"{}\[\]\\]+|\\', text[start.start() :], re.S):
        part = m[0]
        if part == '"':
            if inside and not CLOSES.match(m.string, m.end()):
                part = '\\"'
            else:
                inside = not inside
        elif not inside and part in "{[":
            open_.append("}" if part == "{" else "]")
        elif not inside and part in "}]" and open_:
            open_.pop()
            if not open_:
                out.append(part)
                break
        out.append(part)
    whole = "".join(out) + ('"' if inside else "")
    whole = re.sub(r":\s*$", ": null", whole.rstrip())
    whole = re.sub(r",\s*$", "", whole) + "".join(reversed(open_))
    return re.sub(r",(\s*[}\]])", r"\1", whole)


def repair(text: str | None) -> tuple[str, str | None]:
    """(state, JSON): valid, repaired (quotes inside of strings escaped, open strings and brackets closed, commas
    mended, fences and text around the outermost object left out, single quotes), or broken."""
    if not text or not text.strip():
        return "empty", None
    try:
        json.loads(text)
        return "valid", text
    except ValueError:
        pass
    for candidate in (mended(text), mended(text.replace("'", '"'))):
        try:
            return "repaired", json.dumps(json.loads(candidate))
        except ValueError:
            continue
    return "broken", None


def note_states(spark, sf_dir: str) -> DataFrame:
    """Notes by state. Valid and empty ones are told apart in the JVM; only the rest reach Python."""
    notes = table(spark, sf_dir, "node_logs").select("note")
    plain = notes.select(F.when(F.coalesce(F.trim("note"), F.lit("")) == "", "empty").when(F.try_parse_json("note").isNotNull(), "valid").alias("state"), "note")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"state": [repair(t)[0] for t in f["note"]]})

    fixed = plain.where("state is null").select("note").mapInPandas(run, "state string")
    return plain.where("state is not null").select("state").unionByName(fixed).groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_of_file, front_matter, declared_coverage, new_identifiers, clean_files, scoped_changes, redacted_paths, worst_attempt, low_scores, audit_sample, note_states)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_DECL = DECLARATION.replace("(?md)", "(?m)")
_WORST = "SELECT id, CAST(arg_min(n, (p, n)) AS BIGINT) AS n, min(p) AS precision FROM (SELECT id, CAST(json_extract(x, '$.n') AS INT) AS n, CAST(json_extract(x, '$.precision') AS DOUBLE) AS p FROM (SELECT id, unnest(CAST(attempts AS JSON[])) AS x FROM decisions WHERE json_valid(attempts))) WHERE p IS NOT NULL GROUP BY id"
SQL = {
    "page_of_file": f"WITH d AS (SELECT DISTINCT repo, {_PATH.format('path')} AS page FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL), f AS (SELECT DISTINCT repo, {_PATH.format('source_path')} AS file FROM repo_facts WHERE source_path <> '' AND NOT starts_with(source_path, '@')) SELECT f.repo, f.file, count(*) AS pages, CASE WHEN bool_or(page = file) THEN file WHEN count(*) = 1 THEN min(page) END AS page FROM f JOIN d ON d.repo = f.repo AND (page = file OR ends_with(page, '/' || file)) GROUP BY 1, 2",
    "front_matter": r"WITH b AS (SELECT doc_id, regexp_extract(text, '(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---', 1) AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, trim(regexp_extract(f, '(?m)^title:[ \t]*([^\r\n]*)', 1)) AS title, trim(regexp_extract(f, '(?m)^repo_commit:[ \t]*([^\r\n]*)', 1)) AS repo_commit FROM b",
    "declared_coverage": f"WITH n AS (SELECT change_id, list_distinct(regexp_extract_all(after, '{_DECL}', 1)) AS names, regexp_extract_all(coalesce(existing, ''), '{WORD}', 1) AS w FROM change_units WHERE kind = 'code' AND after IS NOT NULL) SELECT change_id, CAST(len(names) AS BIGINT) AS declared, CAST(len(list_intersect(names, w)) AS BIGINT) AS covered, round(len(list_intersect(names, w)) / nullif(len(names), 0), 9) AS share FROM n",
    "new_identifiers": f"WITH u AS (SELECT change_id, list_filter(list_distinct(regexp_extract_all(after, '{TOKEN}', 1)), lambda w: regexp_matches(w, '{IDENTIFIER}')) AS a, regexp_extract_all(coalesce(existing, ''), '{TOKEN}', 1) AS e FROM change_units WHERE kind = 'docs' AND after IS NOT NULL) SELECT change_id, unnest(list_filter(a, lambda x: NOT list_contains(e, x))) AS identifier FROM u",
    "clean_files": r"WITH f AS (SELECT change_id, trim(f) AS f, i FROM (SELECT change_id, unnest(changedFiles) AS f, generate_subscripts(changedFiles, 1) AS i FROM change_units WHERE len(changedFiles) > 0)), g AS (SELECT change_id, f, min(i) AS i FROM f WHERE f <> '' AND NOT starts_with(f, '/') AND NOT regexp_matches(f, '(^|/)\.\.(/|$)') GROUP BY 1, 2), r AS (SELECT change_id, row_number() OVER w AS n, sum(strlen(f)) OVER w AS b FROM g WINDOW w AS (PARTITION BY change_id ORDER BY i ROWS UNBOUNDED PRECEDING)), k AS (SELECT change_id, max(n) AS n, max(b) AS b FROM r WHERE n <= 200 AND b <= 16384 GROUP BY 1) SELECT u.change_id, CAST(coalesce(k.n, 0) AS BIGINT) AS files, CAST(coalesce(k.b, 0) AS BIGINT) AS bytes FROM (SELECT change_id FROM change_units WHERE len(changedFiles) > 0) u LEFT JOIN k USING (change_id)",
    "scoped_changes": rf"""WITH f AS (SELECT change_id, {_PATH.format('f')} AS p FROM (SELECT change_id, unnest(changedFiles) AS f FROM change_units WHERE len(changedFiles) > 0)),
        m AS (SELECT change_id, regexp_matches(p, '^src/.*$|^api/.*$|^lib/.*$|^(?:.*/)?[^/]*\.go$') AS s, regexp_matches(p, '^(?:.*/)?[^/]*\.min\.js$|^(?:.*/)?vendor/.*$|^(?:.*/)?generated/.*$') AS x FROM f)
        SELECT change_id, count(*) FILTER (WHERE s AND NOT x) AS chosen, count(*) FILTER (WHERE x) AS excluded FROM m GROUP BY 1""",
    "redacted_paths": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{SECRET_PATH}')) AS BIGINT) AS paths, md5(regexp_replace(text, '{SECRET_PATH}', '[path removed]', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "worst_attempt": _WORST,
    "low_scores": f"WITH w AS ({_WORST}) SELECT w.id, w.precision, coalesce(c.claim_id, 0) AS claim_id FROM w JOIN decisions d USING (id) LEFT JOIN (SELECT repo, path, max(id) AS claim_id FROM claims GROUP BY 1, 2) c ON c.repo = d.repo AND c.path = d.path WHERE w.precision < 0.7",
    "audit_sample": "SELECT id, repo FROM decisions WHERE outcome = 'published' AND CAST('0x' || left(md5(CAST(id AS VARCHAR)), 8) AS UBIGINT) / 4294967296 < 0.1",
}
