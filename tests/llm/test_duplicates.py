import random
import re

import pytest

from docloom.llm import duplicates as D


def brute(rows, min_words=6, share=0.7):
    sets = [(i, set(re.findall(r"[^\W_]+", t.lower()))) for i, t in rows if i is not None and t]
    sets = [(i, s) for i, s in sets if len(s) >= min_words]
    return {(min(a, b), max(a, b)) for n, (a, s) in enumerate(sets) for b, t in sets[n + 1 :] if len(s & t) >= share * len(s | t) - 1e-12}


def sample(seed, n=250):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = ["the", "of", "is", "and", "in"]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            base = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                base[r.randrange(len(base))] = r.choice(words)
            r.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(r.sample(words, r.randrange(3, 20)) + r.sample(common, 3))
        rows.append((i + 1, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    for split in (D.SPLIT, 3):  # long lists whole, and in parts
        got = [(r.id_a, r.id_b) for r in D.pairs(spark.createDataFrame(rows, "id long, claim string"), "id", "claim", 6, split=split).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_small_sets(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, "A_B-c, d e f!"), (5, "a b c"), (6, "a b c d e f h i")]
    got = {(r.id_a, r.id_b) for r in D.pairs(spark.createDataFrame(rows, "id long, claim string"), "id", "claim", 6).collect()}
    assert got == brute(rows) and (1, 4) in got


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "--- !!", None), (None, "a b c d e f", "x"), (4, "a b c d e f", "x"), (5, "x " * 50_000, "x"), (6, "a b c d e f", "x")]
    df = spark.createDataFrame(rows, "id long, claim string, words string")
    assert [(r.id_a, r.id_b) for r in D.pairs(df, "id", "claim", 6).collect()] == [(4, 6)]
    assert D.pairs(df.limit(0), "id", "claim", 6).count() == 0 and D.groups(df.limit(0), "id", "claim", 6).count() == 0


def test_groups(spark):
    base = [f"w{i}" for i in range(12)]
    chain = [(i + 1, " ".join(base[i // 2 :] + [f"x{j}" for j in range(i // 2)])) for i in range(8)] + [(20, "one two three four five six seven")]
    got = {r.id: (r.class_id, r.links, r.group_id) for r in D.groups(spark.createDataFrame(chain, "id long, claim string"), "id", "claim", 6).collect()}
    assert {g for i, (_, _, g) in got.items() if i < 20} == {1} and got[20] == (20, 0, 20)
    assert got[2][0] == 1
