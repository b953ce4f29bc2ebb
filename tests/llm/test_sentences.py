import time

import pytest

from docloom.llm import sentences as S

KNOWN = S.Abbreviations({})


def cut(text, known=KNOWN):
    return [text[a:b] for a, b in S.units(text, known)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("Use e.g. Drafts here. Next.", ["Use e.g. Drafts here.", "Next."]), ("It starts at 6 a.m. The rest waits.", ["It starts at 6 a.m.", "The rest waits."]), ("At 6 a.m. on Monday. End", ["At 6 a.m. on Monday.", "End"]),
        ("See Fig. 3 and sec. 4.5 of v1.2.3. Done.", ["See Fig. 3 and sec. 4.5 of v1.2.3.", "Done."]), ("It waits ... and then retries. Ok", ["It waits ... and then retries.", "Ok"]), ("Turns it off… This is next.", ["Turns it off…", "This is next."]),
        ('He wrote: "Wrong limit. Use 3!" An empty one.', ['He wrote: "Wrong limit. Use 3!"', "An empty one."]), ('It prints "Stale. Rebuilding." before it goes on. X', ['It prints "Stale. Rebuilding." before it goes on.', "X"]), ('"Is it live?" asks the judge. Yes.', ['"Is it live?" asks the judge.', "Yes."]),
        ("(The tier ignores this.) Next one.", ["(The tier ignores this.)", "Next one."]), ("A part (see sec. 2. for it) is one. B", ["A part (see sec. 2. for it) is one.", "B"]), ("What happened?! Well.", ["What happened?!", "Well."]), ("After 833 h. The end; not here: nor here.", ["After 833 h.", "The end; not here: nor here."]),
        ("Nach dem 3. Versuch endet es. Am 4. Mai, d. h. Neue Läufe, z. B. Entwürfe.", ["Nach dem 3. Versuch endet es.", "Am 4. Mai, d. h. Neue Läufe, z. B. Entwürfe."]), ("The limit is 4. The next one.", ["The limit is 4.", "The next one."]), ("Die Meldung „Alt. Neu läuft.“ erscheint. Ende", ["Die Meldung „Alt. Neu läuft.“ erscheint.", "Ende"]),
        ("is it open? the next one. and more", ["is it open?", "the next one.", "and more"]), ("At 6 a.m. Version 2 runs. Ab Version 3.", ["At 6 a.m.", "Version 2 runs.", "Ab Version 3."]),
        ("费用下降了3.5%，有关……请先设置；然后启动。评审者写道：“错了。改！”上限为4条。", ["费用下降了3.5%，有关……", "请先设置；然后启动。", "评审者写道：“错了。改！”", "上限为4条。"]), ("ログには「古い。再構築中。」という行が出ます。次です。", ["ログには「古い。再構築中。」という行が出ます。", "次です。"]), ("일찍 \"오래됨. 만드는 중.\" 이라는 줄. 다음.", ["일찍 \"오래됨. 만드는 중.\" 이라는 줄.", "다음."]),
        ("Γιατί μένει κενό; Η υπηρεσία διαβάζει.", ["Γιατί μένει κενό;", "Η υπηρεσία διαβάζει."]), ("सेवा पढ़ती है। लागत घट गई।", ["सेवा पढ़ती है।", "लागत घट गई।"]), ("لماذا تبقى؟ انخفضت الكلفة؛ والسبب.", ["لماذا تبقى؟", "انخفضت الكلفة؛ والسبب."]), ("ገጹ ይመረመራል። ፋይሉ ተዛውሯል።", ["ገጹ ይመረመራል።", "ፋይሉ ተዛውሯል።"]),
        ("ระบบอ่านค่า `x` ครั้งเดียว ห้ามแก้ไข", ["ระบบอ่านค่า `x` ครั้งเดียว", "ห้ามแก้ไข"]), ("Pourquoi ? Ne modifiez jamais ! Le module.", ["Pourquoi ?", "Ne modifiez jamais !", "Le module."]), ("¿Por qué queda? ¡No edites nunca!", ["¿Por qué queda?", "¡No edites nunca!"]), ("Размер, время и т. д. записаны. Предел т. е. Черновики.", ["Размер, время и т. д. записаны.", "Предел т. е. Черновики."]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We cite J. K. Rowling here. X", ["We cite J. K. Rowling here.", "X"]), ("Dr. J. Smith came. X", ["Dr. J. Smith came.", "X"]), ("Siehe z. B. Kap. 3 dort. X", ["Siehe z. B. Kap. 3 dort.", "X"]),
        ("Take plan B. The rest waits. X", ["Take plan B.", "The rest waits.", "X"]), ("It is vitamin C. We knew.", ["It is vitamin C.", "We knew."]),
    ],
)
def test_initials(text, want):
    assert cut(text) == want


@pytest.mark.parametrize("text", ["(" * 300_000, "([{«" * 50_000, '"' * 300_000, "We met etc. Karl and etc. Peter went. " * 8000, "a. " * 100_000, ". " * 200_000, "x" * 1_000_000, "ก " * 200_000], ids=range(8))
def test_linear_time(text):
    began = time.perf_counter()
    cut(text)
    assert time.perf_counter() - began < 15


def test_blocks():
    text = "\ufeff---\ntitle: A. B\n---\n# Head `x`?\n\nOne\nline. Two\r\n\r\n- item one. More\n  goes on\n  * nested\n1. first\n2. second\n> quoted. Text\n\n| a. | b. |\n|---|---|\n```py\nx. Y\n```\n~~~\nunclosed. Fence"
    assert cut(text) == ["Head `x`?", "One\nline.", "Two", "item one.", "More\n  goes on", "nested", "first", "second", "quoted.", "Text"]
    assert cut("---\nnot closed. Here") == ["not closed.", "Here"]


def test_learnt_abbreviations():
    learnt = S.classify({"xyz": {"lower": 40, "digit": 0, "upper": 0, "end": 0}, "stop": {"lower": 1, "upper": 90, "end": 9}, "etc": {"lower": 50, "upper": 40, "end": 3}})
    assert learnt == {"xyz": "inner", "etc": "closing", "stop": "word"}
    assert cut("The xyz. Thing is. Now", S.Abbreviations(learnt)) == ["The xyz. Thing is.", "Now"]
    assert cut("Own qrs. here and qrs. there, qrs. Then. No") == ["Own qrs. here and qrs. there, qrs. Then.", "No"]


def test_own_evidence_before_the_corpus():
    own = "Own qrs. here and qrs. there, qrs. Then. No"
    assert cut(own, S.Abbreviations({"qrs": "word"})) == cut(own)
    assert cut("A longish. here, longish. there and longish. then, longish. Then. No", S.Abbreviations({"longish": "word"})) == ["A longish. here, longish. there and longish. then, longish. Then.", "No"]
    ends = "It is a xyz. The rest.\n\nOne xyz.\n\nTwo xyz.\n\nA"
    assert cut(ends, S.Abbreviations({"xyz": "inner"})) == ["It is a xyz.", "The rest.", "One xyz.", "Two xyz.", "A"]
    assert cut("one ends it. two ends it. three ends it. four", S.Abbreviations({"it": "word"})) == ["one ends it.", "two ends it.", "three ends it.", "four"]


def test_classes_of_rare_keys(spark):
    rows = [(i, "We stop. Then stop. On stop. " * 2000) for i in range(200)] + [(1000 + i, f"See klm. part{i % 2} and klm. more.") for i in range(25)] + [(2000, "The klm. Part is. Now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.k: r.sense for r in S.corpus_classes(df, "text").collect()} == {"klm": "inner"}
    for shared in (S.SHARED, 0):  # given to every task, and joined
        assert [(r.start_at, r.end_at) for r in S.split(df, "doc_id", "text", shared).where("doc_id = 2000").orderBy("start_at").collect()] == [(0, 17), (18, 21)]


def test_all_keys_are_looked_up():
    assert {"qrs", "abc"} <= S.lookups("First.» qrs. two 中文。abc.” End") and "z.b" in S.lookups("so z. b. da")


def test_positions_and_long_texts():
    text = "😀 One. " * 20_000
    found = S.units(text, KNOWN)
    assert len(found) == 20_000 and text[slice(*found[-1])] == "😀 One." and S.units("x" * 300_000, KNOWN) == [(0, 300_000)]


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (4, "A b. C d.", "x"), (4, "A b. C d.", "x"), (None, "Z.", "x")], "doc_id long, text string, start_at string")
    assert sorted(str((r.doc_id, r.start_at, r.end_at)) for r in S.split(df, "doc_id", "text").collect()) == ["(4, 0, 4)", "(4, 0, 4)", "(4, 5, 9)", "(4, 5, 9)", "(None, 0, 2)"]
    assert S.split(df.limit(0), "doc_id", "text").count() == 0
