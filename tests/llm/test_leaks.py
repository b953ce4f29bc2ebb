import random
import time

import pytest

from docloom.llm import leaks as L

SCHEMA = "doc_id long, text string, item_id string"
ITEM = " ".join(f"Word{i}" for i in range(20))


def windows(text, width):
    words = L.WORD.findall(text.lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_runs_and_spans():
    known = L.patterns([(1, ITEM), (2, "too short"), (3, None)])
    text = f"Intro, ({' -- '.join(ITEM.upper().split()[2:16])})! end"
    assert L.hits(text, known) == {1}
    ((item, a, b),) = L.spans(text, known)
    assert item == 1 and text[a:b].startswith("WORD2 --") and text[a:b].endswith("WORD15")
    assert L.hits(" ".join(ITEM.split()[:11]), known) == set() and L.hits(None, known) == set() and L.hits("", L.patterns([])) == set()


@pytest.mark.parametrize("first", range(9))
def test_twelve_words_from_any_place(first):
    known = L.patterns([(1, ITEM)])
    words = ITEM.split()[first : first + 12]
    assert L.hits("x " + " ".join(words) + " y", known) == {1}
    assert L.hits("x " + " ".join(words[:11]) + " y " + " ".join(words[11:]), known) == set()


def test_repeated_words_are_linear():
    known = L.patterns([(1, "a " * 2000), (2, ITEM)])
    began = time.perf_counter()
    assert L.hits("a " * 2000 + ITEM, known) == {1, 2}
    assert time.perf_counter() - began < 10


def test_ten_thousand_items_make_one_scan(spark):
    items = spark.range(10_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i * (id + 7)))) as text")
    docs = spark.createDataFrame([(1, " ".join(f"w{i * (77 + 7)}" for i in range(20, 40)))], "doc_id long, text string")
    found = L.scan(docs, "doc_id", "text", items, "item_id", "text", False)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 77)] and found._jdf.queryExecution().toString().count("MapInArrow") <= 8


def test_offsets_where_lower_case_is_longer():
    known = L.patterns([(1, ITEM)])
    text = "İİİ " + ITEM
    ((_, a, b),) = L.spans(text, known)
    assert text[a:b] == ITEM


def test_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(3, 9)))) for i in range(40)]
    docs = [(i, ", ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(60)]
    want = {(d, i) for d, t in docs for i, s in items if windows(s, 4) & windows(t, 4)}
    for block_words in (10_000_000, 60):
        found = L.scan(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", False, 4, block_words)
        got = [(x.doc_id, x.item_id) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, ITEM, "x"), (3, ITEM, None), (None, ITEM, "x"), (4, "pad " * 50_000 + ITEM, "x")], SCHEMA)
    items = spark.createDataFrame([(7, ITEM, "x"), (7, ITEM, "x"), (8, None, "x"), (9, "", "x"), (10, "short", None)], "item_id long, text string, doc_id string")
    assert sorted(str((r.doc_id, r.item_id)) for r in L.scan(docs, "doc_id", "text", items, "item_id", "text", False).collect()) == ["(3, 7)", "(3, 7)", "(4, 7)", "(None, 7)"]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        assert L.scan(d, "doc_id", "text", i, "item_id", "text", True).count() == 0
