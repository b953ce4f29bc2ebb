"""Budgets, records and manifests on small fixtures: nulls, empty texts, empty tables, columns of the same names."""

from docloom.functions import text
from docloom.operators import checks, evidence, pages, runs

UNIT = "change_id long, kind string, repo string, filePath string, before string, after string, changedFiles array<string>, page string, place string"


def unit(change_id, path, after, before=None, changed=None, repo="r", kind="code"):
    return (change_id, kind, repo, path, before, after, changed, "other", "column")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_page_files(spark):
    units = [
        unit(1, "src/a.py", "x" * 40, "x" * 40), unit(2, "./src/b.py", "y" * 70, "y"), unit(3, "src/c.py", None, "z"), unit(4, "src/d.py", "q" * 50),
        unit(5, "src/d.py", "q" * 20, "p"), unit(6, "src/.env", "secret", "s"), unit(7, "lib/same.py", "k", "k"), unit(8, "top.py", "t", ""),
        unit(None, "src/n.py", "n"), unit(9, None, "n"), unit(10, " ", "n"), unit(11, "src/e.py", "n", repo=None), unit(12, "src/page.md", "n", kind="docs"),
    ]
    df = spark.createDataFrame(units, UNIT)
    assert rows(evidence.page_files(df, 100), "page", "path", "state", "place", "chars", "kept") == [
        ("overview.md", "top.py", "changed", 1, 1, 1),
        ("src.md", "src/a.py", "same", 4, 40, 10),
        ("src.md", "src/b.py", "changed", 1, 70, 70),
        ("src.md", "src/c.py", "removed", 2, 0, 0),
        ("src.md", "src/d.py", "changed", 3, 20, 20),
    ]
    assert sum(r["kept"] for r in evidence.page_files(df, None).collect()) == 131
    assert rows(evidence.page_files(df.limit(0)), "path") == []


def test_recorded(spark):
    text = "### FILE: a.py\n" + "a" * 50 + "\n### FILE: b.py\r\n" + "b" * 30 + "\n### FILE: c.py\n"
    units = [unit(1, "p", text, changed=[" b.py", None]), unit(2, "p", "plain", changed=None), unit(3, "p", ""), unit(4, "p", None), unit(5, "p", text, changed=[])]
    got = rows(evidence.recorded(spark.createDataFrame(units, UNIT), 60), "change_id", "files", "changed", "first", "chars", "recorded", "dropped")
    whole = 65 + 46 + 15
    assert got == [(1, 3, 1, "b.py", whole, 60, whole - 60), (2, 1, 0, "(source)", 24, 24, 0), (5, 3, 0, "a.py", whole, 60, whole - 60)]
    assert rows(evidence.recorded(spark.createDataFrame(units, UNIT), None), "dropped") == [(0,), (0,), (0,)]
    assert rows(evidence.recorded(spark.createDataFrame([], UNIT)), "change_id") == []


def test_manifests(spark):
    units = [
        unit(1, "go.mod", "module old.invalid/x\n\ngo 1.20\n"), unit(2, "go.mod", "module new.invalid/x\r\n\r\ngo 1.24.2\r\n"),
        unit(3, "web/package.json", '{"engines": {"node": ">=20"}}'), unit(4, "pom.xml", "<java.version>21</java.version>"),
        unit(5, "app/build.gradle.kts", "languageVersion.set(JavaLanguageVersion.of(17))"), unit(6, "pyproject.toml", '[project]\nrequires-python = ">=3.11"\n'),
        unit(7, "poetry.lock", '[[package]]\nname = "a"\n\n[[package]]\nname = "b"\n'), unit(8, "Makefile", "all: build\nNAME := x\nbuild :\n\tgo build\n"),
        unit(9, ".github/workflows/ci.yml", "name: Checks \non: push\n"), unit(10, "svc/Dockerfile", "FROM base:1\nENV MODE=x\nARG MODE\nEXPOSE 8080\n"),
        unit(11, "svc2/Dockerfile", "FROM base:1\n"), unit(12, "docs/go.mod.md", "go 9.9"), unit(13, "sub/go.sum", "m.invalid/a v1.0.0 h1:x=\nm.invalid/a v1.0.0/go.mod h1:y=\n"),
        unit(14, "gone/go.mod", "go 1.1"), unit(15, "gone/go.mod", None), unit(16, "package-lock.json", '{"packages": {"": {}, "node_modules/left": {}}}'), unit(17, "x/Makefile", ""),
    ]
    df = spark.createDataFrame(units, UNIT)
    assert rows(evidence.stated(df), "sort", "value", "files") == sorted([
        ("go_module", "new.invalid/x", 1), ("go_version", "1.24.2", 1), ("node_version", ">=20", 1), ("java_version", "21", 1), ("java_version", "17", 1),
        ("python_version", ">=3.11", 1), ("python_package", "a", 1), ("python_package", "b", 1), ("make_target", "all", 1), ("make_target", "build", 1),
        ("workflow", "Checks", 1), ("base_image", "base:1", 2), ("container_setting", "MODE", 1), ("container_port", "8080", 1), ("go_package", "m.invalid/a", 1),
        ("node_package", "left", 1),
    ])
    assert rows(evidence.stated(df.limit(0)), "sort") == []


def test_listed_files_are_trimmed(spark, tmp_path):
    """Digits at the ends of a path stay, blanks around it go, whatever its place in the list."""
    units = [unit(1, "p", "t", changed=["0a0", " 1b1 ", "2c", None, "0a0", "/abs", "x/../y", " "]), unit(2, "p", "t", changed=[]), unit(3, "p", "t")]
    spark.createDataFrame(units, UNIT).write.parquet(str(tmp_path / "change_units.parquet"))
    assert rows(pages.clean_files(spark, str(tmp_path)), "change_id", "files", "bytes") == [(1, 3, 8)]
    assert rows(pages.clean_files(spark, str(tmp_path), 2, None), "change_id", "files", "bytes") == [(1, 2, 6)]


def test_client_paths(spark):
    js = """
const r = await fetch("/api/v1/orders?x=1");
axios.get(`${BASE}/billing/invoices/`);
app.get("/api/served/route", h);
const url = "/api/v2/piece" + id;
const url2 = base + "/api/v2/tail";
load("/images/x/logo.png"); open("/etc/app/conf"); log("/plain/path"); const root = "/api/v1"; fetch("/one");
"""
    java = '@GetMapping(value = "/api/mapped/x")\nrest.getForObject("/users/all/{id}", T.class);\nString S = "//host/api/x";\n'
    py = '@app.get("/api/decorated/y")\nrequests.post(f"{base}/api/items/new")\nx = \'/v1/a/b\'\n'
    units = [unit(1, "a.ts", js), unit(2, "A.java", java), unit(3, "c.py", py), unit(4, "d.py", py), unit(5, "e.md", js), unit(6, "f.js", ""), unit(7, "g.js", None), unit(8, "h.js", js, kind="docs")]
    df = spark.createDataFrame(units, UNIT)
    assert rows(checks.client_paths(df), "path", "units") == [
        ("/api/items/new", 2), ("/api/v1/orders", 1), ("/billing/invoices", 1), ("/users/all/{id}", 1), ("/v1/a/b", 2),
    ]
    assert rows(checks.client_paths(df.limit(0)), "path") == []
    long = spark.createDataFrame([unit(1, "a.js", "a" * 2_000_000), unit(2, "b.js", "@a(" * 200_000), unit(3, "c.js", '"/' * 200_000)], UNIT)
    assert rows(checks.client_paths(long), "path") == []


def test_pending(spark):
    asked = spark.createDataFrame([("r", "p", "abcdef0"), ("r", "p", "abcdef01"), ("r", "p", "abc"), ("r", "p", None), ("r", None, "abcdef0"), ("r", "p", "abcdef0")], "repo string, path string, short string")
    held = [
        (1, "r", "p", "abcdef0199", "pending_review"), (2, "r", "p", "abcdef0299", "pending_review"), (3, "r", "p", "abcdef0399", "published"),
        (4, "r", "p", "abcdef", "pending_review"), (5, "r", "p", None, "pending_review"), (6, "r", None, "abcdef0199", "pending_review"),
    ]
    decisions = spark.createDataFrame(held, "id long, repo string, path string, commit string, outcome string")
    assert rows(runs.pending(asked, decisions), "short", "id", "commit") == [("abcdef0", 2, "abcdef0299"), ("abcdef01", 1, "abcdef0199")]
    assert rows(runs.pending(asked, decisions.limit(0)), "id") == []


def test_joint_scope_and_present(spark):
    assert text.joint_scope([["a/**"], ["b/**", "a/**"]]) == ["a/**", "b/**"]
    assert text.joint_scope([["a/**"], []]) == text.joint_scope([["a/**"], None]) == text.joint_scope([]) == []
    df = spark.createDataFrame([("x", 1.0), ("", float("nan")), (None, None)], "s string, d double")
    got = df.select(text.present(df.s).alias("s"), text.present(df.d, True).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]


def test_sensitive(spark):
    files = [
        (".env", None, "path"), ("a/.env.local", "", "path"), ("k/server.pem", None, "path"), ("secrets/a.txt", None, "path"), ("x/credentials.json", None, "path"),
        ("features/credentials/data.ts", "do not distribute", None), ("notes.md", "Classification: team RESTRICTED\n", "content"), ("notes.md", "classification:\nrestricted", None),
        ("a.csv", "For internal use only.", "content"), ("a.txt", None, None), (None, "do not distribute", None), ("", "", None),
    ]
    df = spark.createDataFrame([(p, c) for p, c, _ in files], "path string, content string")
    assert [r[0] for r in df.select(text.sensitive(df.path, df.content)).collect()] == [w for *_, w in files]
    marked = [unit(1, "src/plan.json", "{}", '{"x": "strictly confidential"}'), unit(2, "src/a.py", "strictly confidential", "b")]
    assert rows(evidence.page_files(spark.createDataFrame(marked, UNIT)), "path") == [("src/a.py",)]
