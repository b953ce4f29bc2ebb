"""What code offers to others, by kind and name: symbols, routes, models, settings; what a change does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.identity import signature_hash
from docloom.functions.text import ending, route, tidy_path
from docloom.operators.checks import CALL
from docloom.session import table

JS, ANY = ["js", "jsx", "mjs", "cjs", "ts", "tsx"], None
# Kind, file endings, and the pattern whose first group is the name (verb and path of a route).
KINDS = [
    ("export", JS, r"(?md)^[ \t]*export[ \t]+(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*(?:\([^)\n]*\))?"),
    ("export", JS, r"(?md)^[ \t]*export[ \t]+(?:declare[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:const|let|var|class|interface|type|enum)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)[^\n=]*"),
    ("export", JS, r"\bexports\.([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*="),
    ("route", JS, r"\b(?:app|router|server|api)\.((?:get|post|put|patch|delete|all)\([ \t]*['\"`]/[^'\"`\n]*)['\"`]"),
    ("rpc", JS, r"(?md)^[ \t]*([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*:[ \t]*(?:[A-Za-z_$][A-Za-z0-9_$]*\.)*(?:publicProcedure|protectedProcedure|privateProcedure|authedProcedure|procedure|adminProcedure)\b"),
    ("export", ["go"], r"(?md)^func[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Z][A-Za-z0-9_]*)[ \t]*(?:\([^)\n]*\))?"),
    ("export", ["go"], r"(?md)^type[ \t]+([A-Z][A-Za-z0-9_]*)[ \t]+(?:struct|interface)"),
    ("route", ["go"], r"\.Handle(?:Func)?\([ \t]*\"((?:GET|POST|PUT|PATCH|DELETE)[ \t]+/[^\"\n]*)\""),
    ("export", ["py"], r"(?md)^(?:async[ \t]+)?def[ \t]+([A-Za-z][A-Za-z0-9_]*)[ \t]*(?:\([^)\n]*\))?"),
    ("export", ["py"], r"(?md)^class[ \t]+([A-Za-z][A-Za-z0-9_]*)"),
    ("route", ["py"], r"@(?:app|router|bp|blueprint)\.(?:route|get|post|put|patch|delete)\([ \t]*['\"](/[^'\"\n]*)['\"]"),
    ("export", ["java"], r"(?md)^[ \t]*public[ \t]+(?:static[ \t]+|final[ \t]+|abstract[ \t]+)*(?:class|interface|enum|record)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"),
    ("export", ["java"], r"(?md)^[ \t]*public[ \t]+(?:static[ \t]+|final[ \t]+)*[A-Za-z0-9_<>, \[\]]+[ \t]([A-Za-z_][A-Za-z0-9_]*)\([^)\n]*\)"),
    ("route", ["java"], r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\([ \t]*(?:value[ \t]*=[ \t]*)?\"(/[^\"\n]*)\""),
    ("model", ANY, r"(?md)^(?:model|enum)[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\{"),
    ("model", ANY, r"(?i)\bcreate[ \t]+table[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?[\"`]?([A-Za-z_][A-Za-z0-9_]*)"),
    ("model", ["proto"], r"(?md)^[ \t]*(?:message|service|rpc)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"),
    ("config", ANY, r"\b(?:process\.env|import\.meta\.env)\.([A-Z][A-Z0-9_]{2,})"),
    ("config", ANY, r"\b(?:os\.environ(?:\.get)?[ \t]*[\[(][ \t]*|os\.getenv\([ \t]*|getenv\([ \t]*|os\.Getenv\([ \t]*)[\"']([A-Z][A-Z0-9_]{2,})[\"']"),
]
OPENAPI = r"(?md)^  (/[A-Za-z0-9_/{}.-]+):"


def interface(text: Column, path: Column) -> Column:
    """(key, sig) of all that a file offers: ``kind:name`` and the declaration's text, blanks joined."""

    def found(kind: str, pattern: str) -> Column:
        names, whole = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 0))
        named = (lambda n: F.trim(F.concat(F.upper(F.regexp_extract(n, "^([A-Za-z]*)", 1)), F.lit(" "), F.regexp_extract(n, "(/.*)$", 1)))) if kind == "route" else (lambda n: n)
        return F.zip_with(names, whole, lambda n, w: F.struct(F.concat(F.lit(kind + ":"), named(n)).alias("key"), F.trim(F.regexp_replace(w, r"[ \t\r\n]+", " ")).alias("sig")))

    x = ending(path)
    parts = [found(kind, p) if endings is None else F.when(x.isin(endings), found(kind, p)) for kind, endings, p in KINDS]
    parts.append(F.when(F.lower(path).rlike("openapi|swagger"), found("route", OPENAPI)))
    return F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))


def offered(units: DataFrame, column: str) -> DataFrame:
    """(change_id, key, sig): what one side of each change offers; several declarations of a key are one signature."""
    rows = units.select("change_id", F.explode(interface(F.col(column), F.col("filePath"))).alias("s"))
    return rows.groupBy("change_id", F.col("s.key").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("s.sig")), " ").alias("sig"))


def code(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "change_units").where("kind = 'code'")


def interface_symbols(spark, sf_dir: str) -> DataFrame:
    """What each new text offers, with a hash of its signature."""
    return offered(code(spark, sf_dir).where("after is not null"), "after").select("change_id", "key", signature_hash(F.col("sig")).alias("sig_hash"))


def interface_diff(spark, sf_dir: str) -> DataFrame:
    """Keys that a change adds, removes or alters in what its file offers."""
    units = code(spark, sf_dir).where("before is not null and after is not null")
    old, new = offered(units, "before").withColumnRenamed("sig", "old"), offered(units, "after").withColumnRenamed("sig", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, ["change_id", "key"], "full_outer").select("change_id", "key", change.alias("change")).where("change is not null")


def touched_routes(spark, sf_dir: str) -> DataFrame:
    """Routes that a change adds or alters; none where either side is empty."""
    return interface_diff(spark, sf_dir).where("startswith(key, 'route:') and change <> 'removed'").select("change_id", F.substring("key", 7, 100_000).alias("route"))


def file_churn(spark, sf_dir: str) -> DataFrame:
    """Files that entered or left a commit, and whether that is dropped: where they offer nothing. A commit
    without any earlier text documents its files for the first time, so none is dropped."""
    units = code(spark, sf_dir).where("repo is not null and commit is not null").select("repo", "commit", tidy_path(F.col("filePath")).alias("path"), "filePath", "before", "after")
    later = units.groupBy("repo", "commit").agg(F.max(F.coalesce(F.trim("before") != "", F.lit(False))).alias("later"))
    sides = units.groupBy("repo", "commit", "path").agg(
        F.max(F.col("before").isNotNull()).alias("b"), F.max(F.col("after").isNotNull()).alias("a"), F.max(F.size(interface(F.coalesce("before", F.lit("")), F.col("filePath"))) + F.size(interface(F.coalesce("after", F.lit("")), F.col("filePath")))).alias("offers"),
    )
    one = sides.where("a <> b").join(later, ["repo", "commit"])
    return one.select("repo", "commit", "path", F.when(F.col("a"), "entered").otherwise("left").alias("side"), (F.col("later") & (F.col("offers") == 0)).alias("dropped"))


def snapshot_blocks(spark, sf_dir: str) -> DataFrame:
    """The files of each text that is a snapshot of several, with their lengths; a text without a file line is
    one block without a path."""
    units = table(spark, sf_dir, "change_units").where("after <> ''").select("change_id", F.split(F.concat(F.lit("\n"), "after"), "\n### FILE: ", -1).alias("b"))
    pieces = units.select("change_id", F.posexplode("b").alias("place", "t"), F.size("b").alias("n")).where("place > 0 or n = 1")
    first = F.instr("t", "\n")
    path = F.when(F.col("place") == 0, "").when(first > 0, F.left("t", first - 1)).otherwise(F.col("t"))
    rest = F.when(F.col("place") == 0, F.length("t") - 1).when(first > 0, F.length("t") - first + 1).otherwise(0)
    return pieces.select("change_id", F.col("place").cast("long").alias("place"), F.trim(F.regexp_replace(path, "\r$", "")).alias("path"), rest.cast("long").alias("chars"))


def provided_routes(spark, sf_dir: str) -> DataFrame:
    """(repo, route) that code serves, in one spelling."""
    units = code(spark, sf_dir).where("after is not null and repo is not null")
    keys = units.select("repo", F.explode(F.transform(interface(F.col("after"), F.col("filePath")), lambda s: s["key"])).alias("key")).where("startswith(key, 'route:')")
    return keys.select("repo", route(F.substring("key", 7, 100_000)).alias("route")).where("route not in ('', '/')").distinct()


ROUTE_TEXT = r"(/v[0-9]+/[A-Za-z0-9_{}/:-]*[A-Za-z0-9_}])"


def contract_gap(spark, sf_dir: str) -> DataFrame:
    """Routes with the repositories other than the provider that call them, in code or in a document, and how many
    of these have no approved claim that names the route. Routes are normalised, so all matches are equalities."""
    provided = provided_routes(spark, sf_dir)
    called = table(spark, sf_dir, "change_units").where("after is not null and repo is not null").select("repo", F.explode(F.regexp_extract_all("after", F.lit(CALL), F.lit(1))).alias("p"))
    named = table(spark, sf_dir, "documents").where("repo is not null").select("repo", F.explode(F.regexp_extract_all("text", F.lit(ROUTE_TEXT), F.lit(1))).alias("p"))
    consumers = called.unionByName(named).select(F.col("repo").alias("consumer"), route(F.col("p")).alias("route")).distinct()
    known = table(spark, sf_dir, "claims").where("approved").select(F.col("repo").alias("consumer"), F.explode(F.regexp_extract_all("claim", F.lit(ROUTE_TEXT), F.lit(1))).alias("p")).select("consumer", route(F.col("p")).alias("route"), F.lit(1).alias("known")).distinct()
    met = provided.join(consumers, "route").where("consumer <> repo").join(known, ["consumer", "route"], "left")
    return met.groupBy("repo", "route").agg(F.count("*").alias("consumers"), F.count_if(F.col("known").isNull()).alias("missing"))


# What a reader of a page can depend on, by sort.
TOKENS = {
    "code": r"`([^`\n]{2,80})`", "route": r"(/v[0-9]+/[A-Za-z0-9_{}/:-]*[A-Za-z0-9_}])", "config": r"(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)", "file": r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z]{1,5})",
    "version": r"(?:^|[^A-Za-z0-9_.])(v?[0-9]+\.[0-9]+(?:\.[0-9]+)*)", "quantity": r"(?:^|[^A-Za-z0-9_.])([0-9]+ (?:ms|s|h|MB|GB|%))",
}


def signature_changes(spark, sf_dir: str) -> DataFrame:
    """What a page states exactly, by sort (code, routes, settings, files, versions, quantities): how many of these the
    new text adds and drops against the published one."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and after is not null")
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)))
    sorts = F.array(*[F.struct(F.lit(n).alias("sort"), found(F.col("existing"), p).alias("old"), found(F.col("after"), p).alias("new")) for n, p in TOKENS.items()])
    rows = units.select("change_id", F.explode(sorts).alias("s"))
    return rows.select("change_id", "s.sort", F.size(F.array_except("s.new", "s.old")).cast("long").alias("added"), F.size(F.array_except("s.old", "s.new")).cast("long").alias("dropped")).where("added + dropped > 0")


def interface_coverage(spark, sf_dir: str) -> DataFrame:
    """Per change and kind: how much of what the code offers the published page names, case aside; a route by its
    path."""
    units = code(spark, sf_dir).where("after is not null")
    rows = units.select("change_id", F.lower(F.coalesce("existing", F.lit(""))).alias("page"), F.explode(F.array_distinct(F.transform(interface(F.col("after"), F.col("filePath")), lambda s: s["key"]))).alias("key"))
    name = F.lower(F.regexp_replace("key", "^[a-z]+:(?:[A-Z]+ )?", ""))
    return rows.groupBy("change_id", F.regexp_extract("key", "^([a-z]+):", 1).alias("kind")).agg(F.count("*").alias("offered"), F.count_if(F.contains("page", name)).alias("named"))


QUERIES = {f.__name__: f for f in (interface_symbols, interface_diff, touched_routes, file_churn, snapshot_blocks, provided_routes, contract_gap, signature_changes, interface_coverage)}
_PATH = r"regexp_replace(regexp_replace(trim({}), '\\', '/', 'g'), '^(\./)+', '')"
_END = rf"lower(regexp_extract({_PATH.format('filePath')}, '\.([A-Za-z0-9]+)$', 1))"


def _found(kind: str, endings: list[str] | None, pattern: str, text: str, where: str) -> str:
    p = pattern.replace("(?md)", "(?m)").replace("'", "''")
    name = "trim(upper(regexp_extract(n, '^([A-Za-z]*)', 1)) || ' ' || regexp_extract(n, '(/.*)$', 1))" if kind == "route" else "n"
    only = f" AND {_END} IN ({', '.join(repr(e) for e in endings)})" if endings else ""
    return f"SELECT change_id, repo, '{kind}:' || {name} AS key, trim(regexp_replace(w, '[ \\t\\r\\n]+', ' ', 'g')) AS sig FROM (SELECT change_id, repo, unnest(regexp_extract_all({text}, '{p}', 1)) AS n, unnest(regexp_extract_all({text}, '{p}', 0)) AS w FROM change_units WHERE kind = 'code' AND {where}{only})"


def _offers(text: str, where: str) -> str:
    every = [_found(k, e, p, text, where) for k, e, p in KINDS] + [_found("route", None, OPENAPI, text, where + " AND regexp_matches(lower(filePath), 'openapi|swagger')")]
    return " UNION ALL ".join(every)


def _side(text: str, where: str, name: str) -> str:
    return f"SELECT change_id, key, string_agg(sig, ' ' ORDER BY sig) AS {name} FROM ({_offers(text, where)}) GROUP BY 1, 2"


_BOTH = "before IS NOT NULL AND after IS NOT NULL"
_DIFF = f"SELECT * FROM (SELECT change_id, key, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' END AS change FROM ({_side('before', _BOTH, 'old')}) FULL JOIN ({_side('after', _BOTH, 'new')}) USING (change_id, key)) WHERE change IS NOT NULL"


def _route(p: str) -> str:
    """The normal spelling of a route that begins with a slash or a verb."""
    bare = f"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({p}, '(?i)^\\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\\s+/', '/')), '(?s)[?#].*$', ''), '\\$?\\{{[^}}]*\\}}|<[^>]*>', '{{}}', 'g'), '/{{2,}}', '/', 'g')"
    segments = f"lower(array_to_string(list_transform(string_split({bare}, '/'), lambda g: CASE WHEN regexp_full_match(g, ':[A-Za-z_][A-Za-z0-9_]*') THEN '{{}}' ELSE g END), '/'))"
    return f"regexp_replace({segments}, '(.)/+$', '\\1')"


_PROVIDED = f"SELECT DISTINCT repo, {_route('substr(key, 7)')} AS route FROM ({_offers('after', 'after IS NOT NULL AND repo IS NOT NULL')}) WHERE starts_with(key, 'route:')"
_CALLS = CALL.replace("'", "''")
SQL = {
    "interface_symbols": f"SELECT change_id, key, left(sha1(sig), 12) AS sig_hash FROM ({_side('after', 'after IS NOT NULL', 'sig')})",
    "interface_diff": _DIFF,
    "touched_routes": f"SELECT change_id, substr(key, 7) AS route FROM ({_DIFF}) WHERE starts_with(key, 'route:') AND change <> 'removed'",
    "file_churn": f"""WITH u AS (SELECT change_id, repo, commit, {_PATH.format('filePath')} AS path, before, after FROM change_units WHERE kind = 'code' AND repo IS NOT NULL AND commit IS NOT NULL),
        o AS (SELECT DISTINCT change_id FROM ({_offers('before', 'before IS NOT NULL')}) UNION SELECT DISTINCT change_id FROM ({_offers('after', 'after IS NOT NULL')})),
        l AS (SELECT repo, commit, bool_or(coalesce(trim(before) <> '', false)) AS later FROM u GROUP BY 1, 2),
        s AS (SELECT repo, commit, path, bool_or(before IS NOT NULL) AS b, bool_or(after IS NOT NULL) AS a, bool_or(change_id IN (SELECT change_id FROM o)) AS offers FROM u GROUP BY 1, 2, 3)
        SELECT repo, commit, path, CASE WHEN a THEN 'entered' ELSE 'left' END AS side, later AND NOT offers AS dropped FROM s JOIN l USING (repo, commit) WHERE a <> b""",
    "snapshot_blocks": r"""WITH b AS (SELECT change_id, string_split(chr(10) || after, chr(10) || '### FILE: ') AS b FROM change_units WHERE after <> ''), p AS (SELECT change_id, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS place, len(b) AS n FROM b)
        SELECT change_id, CAST(place AS BIGINT) AS place, trim(regexp_replace(CASE WHEN place = 0 THEN '' WHEN instr(t, chr(10)) > 0 THEN left(t, instr(t, chr(10)) - 1) ELSE t END, '\r$', '')) AS path, CAST(CASE WHEN place = 0 THEN length(t) - 1 WHEN instr(t, chr(10)) > 0 THEN length(t) - instr(t, chr(10)) + 1 ELSE 0 END AS BIGINT) AS chars FROM p WHERE place > 0 OR n = 1""",
    "provided_routes": f"SELECT * FROM ({_PROVIDED}) WHERE route NOT IN ('', '/')",
    "contract_gap": f"""WITH p AS (SELECT * FROM ({_PROVIDED}) WHERE route NOT IN ('', '/')),
        c AS (SELECT DISTINCT repo AS consumer, {_route('p')} AS route FROM (SELECT repo, unnest(regexp_extract_all(after, '{_CALLS}', 1)) AS p FROM change_units WHERE after IS NOT NULL AND repo IS NOT NULL UNION ALL SELECT repo, unnest(regexp_extract_all(text, '{ROUTE_TEXT}', 1)) FROM documents WHERE repo IS NOT NULL)),
        k AS (SELECT DISTINCT repo AS consumer, {_route('p')} AS route, 1 AS known FROM (SELECT repo, unnest(regexp_extract_all(claim, '{ROUTE_TEXT}', 1)) AS p FROM claims WHERE approved))
        SELECT repo, route, count(*) AS consumers, count(*) FILTER (WHERE known IS NULL) AS missing FROM p JOIN c USING (route) LEFT JOIN k USING (consumer, route) WHERE consumer <> repo GROUP BY 1, 2""",
    "signature_changes": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT change_id, '{n}' AS sort, CAST(len(list_filter(list_distinct(regexp_extract_all(after, '{p}', 1)), lambda x: NOT list_contains(regexp_extract_all(coalesce(existing, ''), '{p}', 1), x))) AS BIGINT) AS added, CAST(len(list_filter(list_distinct(regexp_extract_all(coalesce(existing, ''), '{p}', 1)), lambda x: NOT list_contains(regexp_extract_all(after, '{p}', 1), x))) AS BIGINT) AS dropped FROM change_units WHERE kind = 'docs' AND after IS NOT NULL" for n, p in TOKENS.items()) + ") WHERE added + dropped > 0",
    "interface_coverage": f"SELECT o.change_id, regexp_extract(key, '^([a-z]+):', 1) AS kind, count(*) AS offered, count(*) FILTER (WHERE contains(lower(coalesce(u.existing, '')), lower(regexp_replace(key, '^[a-z]+:(?:[A-Z]+ )?', '')))) AS named FROM (SELECT DISTINCT change_id, key FROM ({_offers('after', 'after IS NOT NULL')})) o JOIN change_units u USING (change_id) GROUP BY 1, 2",
}
