import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pieces as P


def joined(text, found):
    out, at = "", 0
    for a, b in found:
        out += text[at:b]
        at = b
    return out


def text_of(seed, n=400):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma.", "delta,", "epsilon;", "zeta!\n", "eta.\n\n", "theta\n# Head\n", "日本語。"]
    return " ".join(r.choice(words) for _ in range(n * 8))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#é日\r😀", max_size=900), st.integers(40, 120))
def test_pieces_cover_and_overlap(text, limit):
    found = P.pieces(text, limit, 10, limit // 3)
    if len(text) <= limit:
        assert found == []
        return
    assert joined(text, found) == text
    assert all(b - a <= limit for a, b in found)
    assert all(y[0] == x[1] - 10 for x, y in zip(found, found[1:], strict=False))


def test_no_boundary_in_reach():
    found = P.pieces("x" * 300_000)
    assert joined("x" * 300_000, found) == "x" * 300_000 and max(b - a for a, b in found) <= P.LIMIT


def test_cuts_at_boundaries():
    text = text_of(1)
    ends = [b for _, b in P.pieces(text)][:-1]
    assert ends and all(text[e - 1].isspace() or text[e - 1] in "。.;,!" for e in ends)


def test_an_edit_changes_neighbours_only():
    text = text_of(2, 4000)
    at = len(text) // 2
    changed = text[:at] + "one more sentence. " + text[at:]
    a, b = ({text[x:y] for x, y in P.pieces(text)}, {changed[x:y] for x, y in P.pieces(changed)})
    assert len(a - b) <= 4 and len(b - a) <= 4 and len(a) > 40


def test_split_on_tables(spark):
    schema = "change_id long, field_name string, text string, piece string, piece_no int"
    rows = [(1, "after", None, None, None), (2, "after", "", "x", 1), (3, "after", "a" * 3200, "x", 1), (4, "after", "word " * 1000, "x", 1), (4, "after", "word " * 1000, None, 2), (None, None, "word " * 1000, "", 3)]
    got = P.split(spark.createDataFrame(rows, schema), "change_id", "field_name", "text").collect()
    assert {r.change_id for r in got} == {4, None}
    assert len([r for r in got if r.change_id == 4]) == 2 * len(P.pieces("word " * 1000))
    assert P.split(spark.createDataFrame([], schema), "change_id", "field_name", "text").count() == 0
