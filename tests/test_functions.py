import math

import pytest
from pyspark.sql import functions as F

from docloom.functions.identity import point_id, signature_hash
from docloom.functions.stats import pearson, wilson
from docloom.functions.text import glob_regex, matches_any, route, scrub, selected, strip_header, tidy_path
from docloom.operators.facts import inserted, keep_first, latest, replace_slice
from docloom.operators.retrieval import search
from docloom.operators.sections import chunks, hunks, replace_sections, sections, windows


@pytest.mark.parametrize(("k", "n", "low", "high"), [(90, 100, 0.8256, 0.9448), (30, 30, 0.8864, 1.0), (9, 10, 0.5958, 0.9821), (0, 20, 0.0, 0.1611), (0, 0, 0.0, 0.0)])
def test_wilson(spark, k, n, low, high):
    a, b = wilson(F.lit(k), F.lit(n))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert math.isclose(row.a, low, abs_tol=1e-3) and math.isclose(row.b, high, abs_tol=1e-3)


def test_pearson(spark):
    rows = [("a", float(x), float(y)) for x, y in zip(range(1, 6), (0, 0, 1, 1, 1), strict=True)] + [("b", 1.0, 2.0)] * 6 + [("c", 1.0, 2.0)] * 2 + [("c", None, 1.0)]
    r = {x["k"]: x["r"] for x in pearson(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert math.isclose(r["a"], 0.8660254038, abs_tol=1e-9) and r["b"] is None and r["c"] is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [("GET /v1/Users/{id}/", "/v1/users/{}"), ("https://host.invalid/v1//a?x=1#y", "/v1/a"), ("/v2/:id/b", "/v2/{}/b"), ("/v2/<int:x>/b", "/v2/{}/b"), ("/v2/[slug]", "/v2/[slug]"), ("get /A", "/a"), ("a/b/", "/a/b"), ("", ""), ("/v2/${name}/c", "/v2/{}/c"), ("/", "/"), ("", "")],
)
def test_route(spark, raw, want):
    assert spark.range(1).select(route(F.lit(raw)).alias("r")).first().r == want


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src/a/b.py", True), ("**/*.py", "a.py", True), ("**/*.py", "x/a.py", True), ("*.py", "x/a.py", False), ("a?.go", "ab.go", True), ("a?.go", "a/.go", False), ("a+b/*", "a+b/c", True), ("a.b", "axb", False)])
def test_glob(spark, glob, path, hit):
    assert spark.range(1).select(matches_any(F.lit(path), [glob]).alias("m")).first().m is hit


def test_glob_without_patterns(spark):
    row = spark.range(1).select(matches_any(F.lit("a"), []).alias("m"), selected(F.lit("a"), [], []).alias("s")).first()
    assert row.m is False and row.s is True and glob_regex("a") == "^a$"


def test_text_columns(spark):
    row = spark.range(1).select(strip_header(F.lit("### FILE: a b\r\nrest\n### FILE: c")).alias("h"), tidy_path(F.lit(" .\\a\\b ")).alias("p"), scrub(F.lit("a\npassword = 'x1'\nb")).alias("s"), signature_hash(F.lit("x")).alias("g"), point_id(F.lit("r"), F.lit("p"), F.lit(1)).alias("i")).first()
    assert row.h == "rest\n### FILE: c" and row.p == "a/b" and row.s == "a\n[line removed]\nb" and len(row.g) == 12 and [len(x) for x in row.i.split("-")] == [8, 4, 4, 4, 12]


PAGE = "intro\n\n# A\nx\n```\n# not one\n```\n## B\ny\n# A\nz\n##### five\n"


def test_sections_cover_the_page():
    found = sections(PAGE)
    assert "".join(t for _, _, t in found) == PAGE
    assert [p for p, _, _ in found] == ["(preamble)", "A", "A > B", "A #2"]
    assert sections("") == []


def test_replaced_sections():
    assert replace_sections(PAGE, []) == PAGE
    assert replace_sections(PAGE, [("delete", "nowhere", "")]) == PAGE
    assert "## B" not in replace_sections(PAGE, [("delete", "A > B", "")])
    assert replace_sections("# A\nx\n\n# B\n", [("replace", "A", "# A\nnew")]) == "# A\nnew\n\n# B\n"
    assert "# N\n\n# A\nz" in replace_sections(PAGE, [("insert_after", "A > B", "# N")])


def test_chunks():
    text = "---\ntitle: x\n---\n# One\n\n" + "\n\n".join(f"p{i} " + "a" * 500 for i in range(5)) + "\n\n# Two\n\n" + "b" * 3000
    got = chunks(text)
    assert [h for h, _ in got][-1] == "Two" and all(len(c) <= 1300 for h, c in got if h == "One") and "title" not in got[0][1]
    assert "".join(c for _, c in got).count("a" * 500) == 5 and chunks("") == [] and any(len(c) >= 3000 for _, c in got)


def test_windows():
    lines = [f"l{i}" if i % 7 else "" for i in range(300)]
    got = windows("\n".join(lines))
    assert got[0][0] == 1 and got[-1][1] == 300
    assert all(a[1] - b[0] + 1 == 10 for a, b in zip(got, got[1:], strict=False)) and all(b - a < 80 for a, b, _, _ in got)
    assert windows("") == [] and windows("\n\n") == []
    assert windows("a\nb", "x/y.py") == [(1, 2, 0, "FILE x/y.py lines 1-2\na\nb")]


def test_long_windows_lose_nothing():
    text = "\n".join("x" * 99 + str(i % 10) for i in range(60)) + "\n" + "y" * 9000
    got = windows(text)
    assert "".join(t for *_, t in got) == text and max(len(t) for *_, t in got) <= 3200
    assert [t for *_, t in windows(text, limit=None)] == [text]


def test_hunks():
    assert hunks("a\nb\nc", "a\nx\nc\nd") == [(1, 1, 1, 2, " a\n-b\n+x\n c\n+d")] and hunks("a", "a") == []
    old = [f"line {i}" for i in range(4000)]
    new = old[:100] + ["new"] + old[101:3000] + old[3050:]
    assert [(h[0], h[2], h[3]) for h in hunks("\n".join(old), "\n".join(new))] == [(98, 1, 1), (2998, 50, 0)]


@pytest.mark.parametrize("seed", range(30))
def test_hunks_rebuild_the_new_text(seed):
    import random

    from docloom.operators.sections import anchored

    r = random.Random(seed)
    old = [r.choice("abcdefgh") + str(r.randrange(6)) for _ in range(r.randrange(0, 60))]
    new = [x for x in old if r.random() > 0.2]
    for _ in range(r.randrange(6)):
        new.insert(r.randrange(len(new) + 1), "n" + str(r.randrange(3)))
    built, at = [], 0
    for i, j, k, l in anchored(old, new):
        built += old[at:i] + new[k:l]
        at = j
    assert built + old[at:] == new


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": "say "hi", ok"}', None), ('{"text": "the field "status" is set"}', {"text": 'the field "status" is set'}), ('{"a": "x "y" z", "b": [1, 2,]}', {"a": 'x "y" z', "b": [1, 2]}), ('{"a": "open', {"a": "open"}), ('{"a": "b\\"c"}', {"a": 'b"c'}), ("so {'a': 'b'} it is", {"a": "b"}),
    ],
)
def test_quotes_within_strings(text, value):
    import json

    from docloom.operators.pages import repair

    state, got = repair(text)
    assert state != "broken" if value is None and got else value is None or json.loads(got) == value


def test_streams_of_several_files(spark, tmp_path):
    from docloom.streaming import events as E

    rows = [(i, f"2024-01-{1 + i % 5:02d} 0{i % 7}:00:00", i % 4, "click" if i % 3 else "view") for i in range(60)]
    order = [range(40, 60), range(0, 20), range(20, 40)]  # the smallest ids come in the second file
    for n, part in enumerate(order):
        df = spark.createDataFrame([rows[i] for i in part], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("day", F.date_trunc("day", "ts"))
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet")
    want = {tuple(r) for r in whole.groupBy("user_id", "event_type", "day").agg(F.min("event_id")).collect()}
    assert {tuple(r) for r in E.first_of_day(source).collect()} == want
    assert {tuple(r) for r in E.windowed(source).collect()} == {tuple(r) for r in whole.groupBy("day", "event_type").count().collect()}
    assert {tuple(r) for r in E.latest_of(source).collect()} == {tuple(r) for r in whole.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*").collect()}


def test_a_replayed_batch_adds_nothing(spark, tmp_path, monkeypatch):
    from docloom.streaming import events as E

    spark.createDataFrame([(1, 1)], "event_id long, user_id long").write.parquet(f"{tmp_path}/e")
    source = spark.readStream.schema("event_id long, user_id long").parquet(f"{tmp_path}/e")
    monkeypatch.setattr(E, "new_folder", lambda s: f"{tmp_path}/out")
    for state in ("a", "b"):  # a second stream begins at batch 0 again, into the same sink
        monkeypatch.setattr(E, "new_folder", lambda s: f"{tmp_path}/out")
        assert E.by_batches(source, lambda b: b.groupBy("user_id").count()).count() == 1
        (tmp_path / "out" / "state").rename(tmp_path / f"state-{state}")


def test_no_local_folder_on_a_cluster():
    from docloom.session import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_keyed_tables(spark):
    log = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (4, None, 8)], "id long, k string, v int")
    assert {(r.k, r.v) for r in keep_first(log, ["k"], "id").collect()} == {("a", 5), ("b", 7), (None, 8)}
    assert {(r.k, r.v) for r in latest(log, ["k"], "id").collect()} == {("a", 6), ("b", 7), (None, 8)}
    new = spark.createDataFrame([(9, "a", 1), (10, "c", 2), (11, "c", 3)], "id long, k string, v int")
    assert {(r.k, r.v) for r in inserted(log, new, ["k"], "id").collect()} == {("c", 2)}
    slices = new.select("k").distinct()
    assert {r.id for r in replace_slice(log, new, ["k"], slices).collect()} == {3, 4, 9, 10, 11}
    assert replace_slice(log, new.limit(0), ["k"], slices.limit(0)).count() == 4


def test_search_leaves_out_unusable_vectors(spark):
    v = [[1.0] + [0.0] * 63, [1.0, 1.0] + [0.0] * 62, [0.0] * 64, [1.0] * 8, None, [1.0] + [0.0] * 63]
    points = spark.createDataFrame([(i, "r" if i != 5 else None, x) for i, x in enumerate(v)], "vec_id long, repo string, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in search(points, points, 5, ["repo"]).collect()}
    assert got == {(0, 1), (1, 0)}
    assert search(points.limit(0), points.limit(0), 5, ["repo"]).count() == 0


@pytest.mark.parametrize(
    ("text", "state"),
    [(None, "empty"), (" ", "empty"), ('{"a": 1}', "valid"), ('{"usage":', "repaired"), ('{"a": [1, 2', "repaired"), ('```json\n{"a": 1,}\n```', "repaired"), ('text {"a": "b"} more', "repaired"), ("{'a': 1}", "repaired"), ("nothing", "broken"), ('{"a": "x', "repaired")],
)
def test_repaired_json(text, state):
    from docloom.operators.pages import repair

    assert repair(text)[0] == state


def test_snapshots(spark, tmp_path):
    from docloom.sources.files import append, changed_between, overwrite_slices, results, snapshot

    for rev, files in {"a": {"x/y.py": "one", "z.md": "same", "gone.md": "g"}, "b": {"x/y.py": "two", "z.md": "same", "new.md": "n", "bin.dat": "a\0b", "big.txt": "x" * 200_001}}.items():
        for name, content in files.items():
            (tmp_path / rev / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rev / name).write_text(content)
    old, new = snapshot(spark, str(tmp_path / "a")), snapshot(spark, str(tmp_path / "b"))
    assert {(r.path, r.change) for r in changed_between(old, new).collect()} == {("x/y.py", "changed"), ("gone.md", "removed"), ("new.md", "added")}
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in results(spark, str(tmp_path / "r.json"), "a int").collect()] == [1, 2]
    append(spark.createDataFrame([(1, "p"), (2, "q")], "v int, k string"), str(tmp_path / "t"), "k")
    overwrite_slices(spark.createDataFrame([(3, "p")], "v int, k string"), str(tmp_path / "t"), "k")
    assert {(r.v, r.k) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(3, "p"), (2, "q")}


def test_running_values_cross_stretches(spark):
    import random

    from docloom.functions.running import running

    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 5])) for i in range(400)]
    got = {x.id: (x.place, x.before, x.previous) for x in running(spark.createDataFrame(rows, "id long, k string, v long"), ["k"], "id", "v", 37).collect()}
    want, seen = {}, {}
    for i, k, v in rows:
        place, before, previous = seen.get(k, (0, 0, None))
        want[i] = (place + 1, before, previous)
        seen[k] = (place + 1, before + (v or 0), v or 0)
    assert got == want


def test_small_texts(spark):
    from docloom.functions.text import clip, escape_html, human_list, slug

    row = spark.range(1).select(
        slug(F.lit("  Ab c/D_1! ")).alias("s"), clip(F.lit("abcdef"), 4).alias("c"), clip(F.lit("abc"), 4).alias("d"), escape_html(F.lit("<a b='c'>&\"")).alias("e"),
        *[human_list(F.array(*[F.lit(x) for x in "abc"[:n]]).cast("array<string>")).alias(f"h{n}") for n in range(4)],
    ).first()
    assert row.s == "ab-c-d-1" and row.c == "abc…" and row.d == "abc" and row.e == "&lt;a b=&#39;c&#39;&gt;&amp;&quot;"
    assert [row.h0, row.h1, row.h2, row.h3] == ["", "a", "a and b", "a, b and c"]


def test_yaml_keys():
    from docloom.operators.checks import yaml_keys

    text = "# c\na:\n  b: 1\n  c:\n    - x: 1\n    d: |\n      not: this\n\n      nor: this\n  e: >-\n    text: no\nf: {g: 1}\n'q': 2\n"
    assert [k for (k,) in yaml_keys(text)] == ["a", "a.b", "a.c", "a.c.d", "a.e", "f"]
    assert yaml_keys("") == []


def test_page_similarity_asks_all_chunks(spark, tmp_path):
    from docloom.operators.retrieval import page_similarity

    def v(x, y):
        return [float(x), float(y)] + [0.0] * 62

    rows = [(1, "r", "approved", "a", v(1, 0)), (20, "r", "code", "p", v(2, 0)), (21, "r", "code", "p", v(0, 3)), (22, "r", "code", "q", v(3, 4)), (23, "s", "code", "p", v(1, 0)), (24, "r", "code", "p", [0.0] * 64)]
    rows += [(100 + i, "r", "code", "many", v(1, i / 2000)) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, repo string, kind string, path string, embedding array<float>").write.parquet(f"{tmp_path}/vector_points.parquet")
    got = {(r.repo, r.path): r.similarity for r in page_similarity(spark, str(tmp_path)).collect()}
    assert got == {("r", "p"): 0.0, ("r", "q"): 0.6, ("s", "p"): 0.0, ("r", "many"): round(1 / (1 + 0.5995**2) ** 0.5, 6)}


def test_grounded(spark):
    from docloom.operators.checks import grounded

    quotes = spark.createDataFrame([("r", "Big  Word here"), ("r", "absent"), ("s", "big word here"), ("r", None), ("r", "!!")], "g string, q string")
    texts = spark.createDataFrame([("r", 2, "x BIG word\nHere y"), ("r", 1, "big word, here"), ("r", 3, "a big word here"), ("s", 4, None)], "g string, k long, t string")
    assert [tuple(r) for r in grounded(quotes, texts, "g", "q", "k", "t").collect()] == [("r", "Big  Word here", 2, 2)]
