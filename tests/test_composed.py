"""Column functions and small tables of the judged, composed, indexing and interface operators."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import composed as C
from docloom.operators import indexing, interface
from docloom.operators import judged as J


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("Faithful.", ("label", None, None, 1.0, [], "label only")), ('```json\n{"claims": 4, "unsupported": ["a", " b "], "explanation": "x"}\n```', ("json", 4, 2, 0.5, ["a", "b"], "")), ('Here: {"claims": 2, "unsupported": 5} ok', ("json", 2, 2, 0.0, [], "count in place of quotes")),
        ('{"claims": 0, "unsupported": []}', ("json", 0, 0, 1.0, [], "no claims")), ('{"claims": 3}', ("json", 3, 0, 1.0, [], "")), ('{"claims": "many"}', ("rejected", None, None, None, [], "")), ("no idea", ("rejected", None, None, None, [], "")), (None, ("rejected", None, None, None, [], "")),
        ('{"claims": -2, "unsupported": ["a"]}', ("json", 0, 0, 1.0, [], "no claims")),
    ],
)
def test_verdict(spark, reply, want):
    row = spark.createDataFrame([(reply,)], "r string").select(J.verdict(F.col("r")).alias("v")).first().v
    got = (row.state, row.claims, row.unsupported, row.score, row.quotes, row.note)
    assert got[:4] == want[:4] and got[5] == want[5] and (got[4] == want[4] or want[3] == 1.0)


def test_claim_shares(spark):
    rows = [([(True,), (False,), (None,)], [(True, True), (False, True), (True, False)]), ([], [])]
    df = spark.createDataFrame(rows, "c array<struct<supported boolean>>, f array<struct<covered boolean, core boolean>>")
    got = [tuple(r.s) for r in df.select(J.claim_shares(F.col("c"), F.col("f")).alias("s")).collect()]
    assert got == [(pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5), (1.0, 1.0, 1.0)]


def test_clamp_and_score(spark):
    got = [r[0] for r in spark.createDataFrame([("0.5",), ("7",), ("-1",), ("x",), (None,), ("NaN",)], "v string").select(J.clamp01(F.col("v"))).collect()]
    assert got == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]
    row = spark.range(1).select(J.score(F.lit(4), F.lit(9)).alias("a"), J.score(F.lit(0), F.lit(1)).alias("b"), J.score(F.lit(4), F.lit(1)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, 1.0, 0.75)


def test_documents_of_three_shapes(spark):
    rows = [(json.dumps(["a", "", "b"]), None, None), (json.dumps([{"document.content": "a"}, {"document": {"content": "b"}}, {"content": "c"}]), None, None), (None, "second", "first"), ("broken", "x", None), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, d1 string, d0 string")
    got = [r.x for r in df.select(J.documents_of(F.col("d"), [(1, F.col("d1")), (0, F.col("d0"))]).alias("x")).collect()]
    assert got == [["a", "b"], ["a", "b", "c"], ["first", "second"], ["x"], []]


def test_reference_text(spark):
    row = spark.range(1).select(
        J.reference_text(F.lit("code"), F.array(F.lit("a.py")), F.array(F.lit("x"), F.lit("y"))).alias("a"), J.reference_text(F.lit(None).cast("string"), F.array().cast("array<string>"), F.array(F.lit("x"))).alias("b"),
    ).first()
    assert row.a == "[SOURCE FILES (changed in this commit: a.py)]\ncode\n\n[chunk 1]\nx\n\n[chunk 2]\ny" and row.b == "[chunk 1]\nx"


def test_texts(spark):
    row = spark.range(1).select(
        C.fill(F.lit("{{A}}-{{B}}-{{C}}"), {"A": F.lit(1), "B": F.lit(None).cast("string")}).alias("f"), C.join_path(F.lit("/a/"), F.lit(None).cast("string"), F.lit("b/c")).alias("j"), C.join_path(F.lit("")).alias("e"), C.clean(F.lit("a\x00b\tc\x7f\n")).alias("c"),
        C.unit_parts(F.lit("o/r@abc1234:docs/x.md")).alias("u"), C.unit_parts(F.lit("nothing")).alias("n"), C.folder_spec(F.lit("Write well.\nFolder: `guides/api`\n")).alias("s"),
        C.body_parts(F.lit("Source: org/repo at 0123abc\n\n- docs/a.md\n* `b/c.mdx`\n- docs/a.md\n")).alias("b"), C.target_path(F.lit("./src/a b/C.py"), "docs", F.lit("")).alias("t"),
        C.with_front_matter(F.lit("---\nold: 1\n---\n# T\n"), F.lit("T"), F.lit(None).cast("string"), F.lit("abc")).alias("m"),
    ).first()
    assert row.f == "1--{{C}}" and row.j == "/a/b/c" and row.e == "/" and row.c == "ab\tc\n" and tuple(row.u) == ("o/r", "abc1234", "docs/x.md") and tuple(row.n) == (None, None, None)
    assert row.s == "guides/api" and (row.b.repo, row.b.sha, row.b.pages) == ("org/repo", "0123abc", ["docs/a.md", "b/c.mdx"]) and row.t == "docs/src-a-b-C.md" and row.m == "---\ntitle: T\nrepo_commit: abc\n---\n# T\n"
    assert C.policy_version({"b": 1, "a": [2]}) == C.policy_version({"a": [2], "b": 1}) != C.policy_version({"a": [2]}) and len(C.policy_version({})) == 11


def test_links(spark):
    rows = [("a/a", "b/b", 0), ("a/a", "bad", 1), ("a/a", "a/a", 2), ("c/c", "a/a", 0), ("b/b", "a/a", 0)] + [("d/d", f"x/{i}", i) for i in range(12)]
    links = spark.createDataFrame(rows, "repo string, other string, at int")
    got = {(r.repo, r.other) for r in C.closure(links).collect()}
    assert {("a/a", "b/b"), ("a/a", "c/c"), ("b/b", "a/a"), ("c/c", "a/a"), ("x/3", "d/d")} <= got and ("a/a", "a/a") not in got and ("d/d", "x/11") not in got and len([g for g in got if g[0] == "d/d"]) == 10
    roles = spark.createDataFrame([("a/a", "provider"), ("b/b", "consumer"), ("c/c", "provider")], "repo string, role string")
    calls = {(r.repo, r.other) for r in C.consumers(links, roles).collect()}
    assert ("a/a", "b/b") in calls and ("a/a", "c/c") not in calls and ("b/b", "a/a") not in calls and ("d/d", "x/1") in calls


def test_link_warnings(spark):
    rows = [
        ("a/a", ["b/b", "a/a", "bad", "z/z"], True, True, "provider", "block"), ("b/b", ["a/a"], True, True, "judge", "maybe"), ("c/c", None, False, False, None, None), ("d/d", [f"a/a{i}" for i in range(11)], True, True, None, "off"),
    ]
    config = spark.createDataFrame(rows, "repo string, links array<string>, links_is_list boolean, contract_is_object boolean, role string, gate string")
    got = {(r.repo, r.warning, r.detail) for r in C.link_warnings(config).collect()}
    want = {("a/a", "links itself", "a/a"), ("a/a", "no owner/repo", "bad"), ("a/a", "unknown repository", "z/z"), ("a/a", "declared on both sides", "b/b"), ("b/b", "unknown role", "judge"), ("b/b", "unknown gate", "maybe"), ("c/c", "links are no list", None), ("c/c", "contract is no object", None), ("d/d", "too many links", "11")}
    assert want <= got and {w for _, w, _ in got} == {w for _, w, _ in want}


def test_contract_gap(spark, tmp_path):
    units = [(1, "code", "p/p", "a.py", '@app.get("/v1/items/{id}")\ndef f(a):\n    pass\n'), (2, "code", "c/c", "b.py", 'requests.get("https://h.invalid/v1/items/{x}")'), (3, "code", "d/d", "b.py", 'requests.get("/v1/items/{x}")'), (4, "code", "p/p", "c.py", 'requests.get("/v1/items/{x}")')]
    spark.createDataFrame(units, "change_id long, kind string, repo string, filePath string, after string").write.parquet(f"{tmp_path}/change_units.parquet")
    spark.createDataFrame([("e/e", "It calls /v1/items/{key} often"), ("p/p", "own /v1/items/{id}")], "repo string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("d/d", "We use /V1/Items/{id}.", False), ("c/c", "Calls /v1/items/{id} daily", True)], "repo string, claim string, approved boolean").write.parquet(f"{tmp_path}/claims.parquet")
    assert [tuple(r) for r in interface.contract_gap(spark, str(tmp_path)).collect()] == [("p/p", "/v1/items/{}", 3, 2)]


def test_interface_of_texts(spark):
    texts = {
        "a.ts": "export async function go(a, b) {}\nexport const X = 1\nrouter.post('/v1/x', h)\nsave: t.publicProcedure.input()\nprocess.env.API_HOST\n", "b.go": 'func (s *S) Run(a int) {}\ntype Box struct {\nmux.HandleFunc("GET /api/health", h)\n', "c.py": '@app.get("/v2/y")\ndef y(q):\nclass K:\nos.environ["LOG_LEVEL"]\n',
        "d.proto": "message M {\nservice S {\n", "e.sql": "CREATE TABLE IF NOT EXISTS t (a int)", "openapi.yaml": "paths:\n  /v3/z:\n    get: x\n", "f.txt": "model User {\n", "g.md": "",
    }
    df = spark.createDataFrame(list(texts.items()), "p string, t string").select("p", F.transform(interface.interface(F.col("t"), F.col("p")), lambda s: s["key"]).alias("k"))
    got = {r.p: set(r.k) for r in df.collect()}
    assert got == {
        "a.ts": {"export:go", "export:X", "route:POST /v1/x", "rpc:save", "config:API_HOST"}, "b.go": {"export:Run", "export:Box", "route:GET /api/health"}, "c.py": {"route:/v2/y", "export:y", "export:K", "config:LOG_LEVEL"},
        "d.proto": {"model:M", "model:S"}, "e.sql": {"model:t"}, "openapi.yaml": {"route:/v3/z"}, "f.txt": {"model:User"}, "g.md": set(),
    }


def test_synced_points(spark):
    points = spark.createDataFrame([(1, "a", "x"), (2, "a", "gone"), (3, "a", "same"), (4, "b", "x"), (5, "c", "x")], "point_id long, repo string, path string")
    files = spark.createDataFrame([("a", "x", 1, "new"), ("a", "gone", 2, None), ("b", "x", 3, "t")], "repo string, path string, change_id long, after string")
    modes = spark.createDataFrame([("a", "incremental"), ("b", "full")], "repo string, mode string")
    got = {r.point_id: r.fate for r in indexing.synced_points(points, files, modes).collect()}
    assert got == {1: "replaced", 2: "removed", 3: "kept", 4: "rebuilt", 5: "kept"}
    assert indexing.synced_points(points.limit(0), files, modes).count() == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (None, -1)], "id long, v int")
    got = {(r.check, r.n) for r in indexing.checks(df, "t", "id", {"null_v": F.col("v").isNull(), "negative": F.col("v") < 0}).collect()}
    assert got == {("null_v", 1), ("negative", 1), ("repeated_key", 1)}


def test_patched(spark):
    from docloom.operators.sections import patched

    pages = spark.createDataFrame([(1, "# A\nx\n\n# B\ny\n"), (2, "# A\nx\n"), (3, None)], "id long, t string")
    operations = spark.createDataFrame([(1, 1, "delete", "B", None), (1, 0, "replace", "A", "# A\nnew"), (1, 2, "delete", "nowhere", None), (9, 0, "delete", "A", None)], "id long, place int, op string, section string, body string")
    got = {r.id: (r.patched, r.touched, r.untouched, r.sections) for r in patched(pages, operations, "id", "t").collect()}
    assert got == {1: ("# A\nnew\n\n", 13, 0, "A|B"), 2: ("# A\nx\n", 0, 6, ""), 3: (None, 0, 0, "")}


def test_quotes_in_blocks(spark):
    from docloom.operators.checks import grounded

    quotes = spark.createDataFrame([("r", "config"), ("r", "Two  words"), ("s", "config"), ("r", "none such")], "g string, q string")
    texts = spark.createDataFrame([("r", 1, "the configuration"), ("r", 2, "CONFIG and two\nwords"), ("s", 3, "nothing"), ("r", 4, None)], "g string, k long, t string")
    for block_chars in (1000, 6):
        assert {tuple(r) for r in grounded(quotes, texts, "g", "q", "k", "t", block_chars).collect()} == {("r", "config", 1, 2), ("r", "Two  words", 2, 1)}
