"""What changed between two texts of a change unit: lines, declarations, quoted literals, shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import header_path, language, scrub, strip_header, strip_line
from docloom.session import table

DECLARATION = r"(?md)^[ \t]*(?:export +|public +|private +|async +|static +|final +|default +)*(?:function|func|def|class|const|var|type|interface) +([A-Za-z_][A-Za-z0-9_]*)[^\n]*"
LITERAL = r'"([^"]{4,})"'


def line_counts(df: DataFrame, key: str, old: Column, new: Column, strip: bool) -> DataFrame:
    """(key, line, a, b): how often each non-blank line stands in the old and the new text. Counted with
    partial sums on the map side; the key of the exchange is (key, line), so one huge text spreads out."""
    lines = lambda text: F.transform(F.split(text, "\n", -1), strip_line) if strip else F.split(text, "\n", -1)
    sides = df.select(key, F.explode(F.array(F.struct(lines(old).alias("l"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(lines(new).alias("l"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s"))
    each = sides.select(key, "s.a", "s.b", F.explode("s.l").alias("line")).where(strip_line(F.col("line")) != "")
    return each.groupBy(key, "line").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def line_diff(spark, sf_dir: str) -> DataFrame:
    """Added and removed lines of each change with a text before, order aside, blanks around lines ignored."""
    units = table(spark, sf_dir, "change_units").where("before is not null and after is not null")
    counted = line_counts(units, "change_id", strip_header(F.col("before")), strip_header(F.col("after")), True)
    return counted.groupBy("change_id").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))


def retained_share(spark, sf_dir: str) -> DataFrame:
    """Share of the published page's lines that the new text keeps, in per cent."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and existing <> '' and after is not null")
    counted = line_counts(units, "change_id", F.col("existing"), F.col("after"), False)
    return counted.groupBy("change_id").agg(F.sum(F.least("a", "b")).alias("kept"), F.sum("a").alias("old")).where("old > 0").select("change_id", "kept", "old", F.round(F.col("kept") * 100 / F.col("old"), 6).alias("percent"))


def declarations(text: Column) -> Column:
    """(name, signature) of each declaration; the signature is its line, blanks joined."""
    names, lines = F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(1)), F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(0))
    return F.zip_with(names, lines, lambda n, l: F.struct(n.alias("name"), F.trim(F.regexp_replace(l, r"[ \t\r]+", " ")).alias("sig")))


def symbol_diff(spark, sf_dir: str) -> DataFrame:
    """Declared names that a change adds, removes or redefines."""
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and before is not null and after is not null")
    side = lambda c, s: units.select("change_id", F.explode(declarations(F.col(c))).alias("d")).groupBy("change_id", F.col("d.name").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("d.sig")), "|").alias(s))
    both = side("before", "old").join(side("after", "new"), ["change_id", "name"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("change_id", "name", change.alias("change")).where("change is not null")


def quoted_in_page(spark, sf_dir: str) -> DataFrame:
    """Literals on lines that a change removes and that the published page repeats, case aside."""
    units = table(spark, sf_dir, "change_units").where("before is not null and after is not null and existing <> ''")
    gone = F.array_except(F.split("before", "\n", -1), F.split("after", "\n", -1))
    literals = F.array_distinct(F.flatten(F.transform(gone, lambda l: F.regexp_extract_all(l, F.lit(LITERAL), F.lit(1)))))
    return units.select("change_id", F.explode(F.filter(literals, lambda x: F.contains(F.lower("existing"), F.lower(x)))).alias("literal"))


def text_shape(spark, sf_dir: str) -> DataFrame:
    """Headings, fences, table rows and list items of each document."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", count(r"(?md)^#{1,6} ").alias("headings"), count(r"(?md)^(?:```|~~~)").alias("fences"),
        count(r"(?md)^[ \t]*\|").alias("table_rows"), count(r"(?md)^[ \t]*(?:[-*]|[0-9]+\.) ").alias("items"),
    )


def shape_change(spark, sf_dir: str) -> DataFrame:
    """Whether the shape of a page differs from the published one, with the first part that does."""
    parts = {"headings": r"(?md)^#{1,6} ", "fences": r"(?md)^(?:```|~~~)", "table_rows": r"(?md)^[ \t]*\|", "items": r"(?md)^[ \t]*(?:[-*]|[0-9]+\.) "}
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and existing <> '' and after is not null")
    differs = [F.when(F.regexp_count("existing", F.lit(p)) != F.regexp_count("after", F.lit(p)), F.lit(name)) for name, p in parts.items()]
    return units.select("change_id", F.coalesce(*differs, F.lit("none")).alias("first_change"))


def snapshot_headers(spark, sf_dir: str) -> DataFrame:
    """The path in each text's header line, and the length of what follows."""
    return table(spark, sf_dir, "change_units").where("after is not null").select("change_id", header_path(F.col("after")).alias("header_path"), F.length(strip_header(F.col("after"))).cast("long").alias("body"))


def scrubbed(spark, sf_dir: str) -> DataFrame:
    """Digest of each text after lines that assign a secret were replaced."""
    return table(spark, sf_dir, "change_units").where("after is not null").select("change_id", F.md5(scrub(F.col("after"))).alias("digest"), (scrub(F.col("after")) != F.col("after")).alias("scrubbed"))


def language_mix(spark, sf_dir: str) -> DataFrame:
    """Files and bytes per repository and language, with the share of bytes, the four largest of each."""
    files = table(spark, sf_dir, "change_units").where("kind = 'code' and after is not null").select("repo", language(F.col("filePath")).alias("language"), F.octet_length("after").cast("long").alias("bytes"))
    sums = files.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    # one row per repository and language: the windows are as small as the list of languages
    per = Window.partitionBy("repo")
    return sums.withColumn("share", F.round(F.col("bytes") / F.nullif(F.sum("bytes").over(per), F.lit(0)), 9)).withColumn("place", F.row_number().over(per.orderBy(F.desc("bytes"), "language")).cast("long")).where("place <= 4")


QUERIES = {f.__name__: f for f in (line_diff, retained_share, symbol_diff, quoted_in_page, text_shape, shape_change, snapshot_headers, scrubbed, language_mix)}
_STRIP = r"regexp_replace({}, '^[ \t\r]+|[ \t\r]+$', '', 'g')"
_HEAD = r"regexp_replace({}, '\A### FILE: ([^\r\n]*)\r?\n?', '')"


def _lines(key_where: str, old: str, new: str, strip: bool) -> str:
    line = _STRIP.format("l") if strip else "l"
    side = lambda text, a, b: f"SELECT change_id, {line} AS line, {a} AS a, {b} AS b FROM (SELECT change_id, unnest(string_split({text}, chr(10))) AS l FROM change_units WHERE {key_where})"
    return f"SELECT change_id, line, sum(a) AS a, sum(b) AS b FROM ({side(old, 1, 0)} UNION ALL {side(new, 0, 1)}) WHERE {_STRIP.format('line')} <> '' GROUP BY 1, 2"


_DECL = DECLARATION.replace("(?md)", "(?m)")
_SIDE = f"SELECT change_id, name, string_agg(sig, '|' ORDER BY sig) AS {{0}} FROM (SELECT change_id, unnest(regexp_extract_all({{1}}, '{_DECL}', 1)) AS name, trim(regexp_replace(unnest(regexp_extract_all({{1}}, '{_DECL}', 0)), '[ \\t\\r]+', ' ', 'g')) AS sig FROM change_units WHERE kind = 'code' AND before IS NOT NULL AND after IS NOT NULL) GROUP BY 1, 2"
_COUNT = "CAST(len(regexp_extract_all({0}, '{1}')) AS BIGINT)"
_SHAPES = {"headings": "(?m)^#{1,6} ", "fences": "(?m)^(?:```|~~~)", "table_rows": r"(?m)^[ \t]*\|", "items": r"(?m)^[ \t]*(?:[-*]|[0-9]+\.) "}
_SECRET = r"(?i)(password|passwd|secret|token|api[_-]?key)[A-Za-z_]*[''\"]?[ \t]*[:=][ \t]*[''\"]?[^ \t''\"]"
_SCRUB = f"array_to_string(list_transform(string_split(after, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{_SECRET}') THEN '[line removed]' ELSE l END), chr(10))"
SQL = {
    "line_diff": f"SELECT change_id, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed FROM ({_lines('before IS NOT NULL AND after IS NOT NULL', _HEAD.format('before'), _HEAD.format('after'), True)}) GROUP BY 1",
    "retained_share": f"WITH c AS ({_lines('kind = ' + chr(39) + 'docs' + chr(39) + ' AND existing <> ' + chr(39) * 2 + ' AND after IS NOT NULL', 'existing', 'after', False)}) SELECT change_id, CAST(sum(least(a, b)) AS BIGINT) AS kept, CAST(sum(a) AS BIGINT) AS old, round(sum(least(a, b)) * 100 / sum(a), 6) AS percent FROM c GROUP BY 1 HAVING sum(a) > 0",
    "symbol_diff": f"WITH o AS ({_SIDE.format('old', 'before')}), n AS ({_SIDE.format('new', 'after')}) SELECT * FROM (SELECT change_id, name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' END AS change FROM o FULL JOIN n USING (change_id, name)) WHERE change IS NOT NULL",
    "quoted_in_page": """WITH u AS (SELECT change_id, existing, list_filter(string_split(before, chr(10)), lambda l: NOT list_contains(string_split(after, chr(10)), l)) AS gone FROM change_units WHERE before IS NOT NULL AND after IS NOT NULL AND existing <> ''),
        l AS (SELECT DISTINCT change_id, existing, unnest(flatten(list_transform(gone, lambda l: regexp_extract_all(l, '"([^"]{4,})"', 1)))) AS literal FROM u)
        SELECT change_id, literal FROM l WHERE contains(lower(existing), lower(literal))""",
    "text_shape": "SELECT doc_id, " + ", ".join(f"{_COUNT.format('text', p)} AS {n}" for n, p in _SHAPES.items()) + " FROM documents WHERE text IS NOT NULL",
    "shape_change": "SELECT change_id, CASE " + " ".join(f"WHEN {_COUNT.format('existing', p)} <> {_COUNT.format('after', p)} THEN '{n}'" for n, p in _SHAPES.items()) + " ELSE 'none' END AS first_change FROM change_units WHERE kind = 'docs' AND existing <> '' AND after IS NOT NULL",
    "snapshot_headers": rf"SELECT change_id, trim(regexp_extract(after, '\A### FILE: ([^\r\n]*)\r?\n?', 1)) AS header_path, CAST(length({_HEAD.format('after')}) AS BIGINT) AS body FROM change_units WHERE after IS NOT NULL",
    "scrubbed": f"SELECT change_id, md5({_SCRUB}) AS digest, {_SCRUB} <> after AS scrubbed FROM change_units WHERE after IS NOT NULL",
    "language_mix": r"""WITH e AS (SELECT repo, lower(regexp_extract(regexp_replace(regexp_replace(trim(filePath), '\\', '/', 'g'), '^(\./)+', ''), '\.([A-Za-z0-9]+)$', 1)) AS x, strlen(after) AS bytes FROM change_units WHERE kind = 'code' AND after IS NOT NULL),
        l AS (SELECT repo, CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'sh' THEN 'shell' WHEN 'tf' THEN 'terraform' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown'
              ELSE CASE WHEN x IN ('go', 'java', 'sql', 'yaml', 'json', 'toml', 'xml', 'properties', 'css') THEN x ELSE 'text' END END AS language, bytes FROM e),
        s AS (SELECT repo, language, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM l GROUP BY 1, 2),
        w AS (SELECT *, round(bytes / nullif(sum(bytes) OVER (PARTITION BY repo), 0), 9) AS share, row_number() OVER (PARTITION BY repo ORDER BY bytes DESC, language) AS place FROM s)
        SELECT * FROM w WHERE place <= 4""",
}
