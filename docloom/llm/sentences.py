"""Sentence units of documents in many languages and scripts, with their positions.

A document is first cut into blocks (heading, list item, quoted line, paragraph); front matter, fenced
code and table rows hold none. Within a block an end mark ends a unit unless it stands inside a quotation
or parenthesis, or its period belongs to an abbreviation, an ordinal or a number.

What is an abbreviation is learnt, not only listed: a period followed by a small letter is unambiguous
evidence for one, a period at a block's end against one that never closes a sentence. A document's own
evidence decides where it is unambiguous; else the counts over the whole corpus do. They are summed and
judged in Spark in a first pass. Up to ``SHARED`` classes are given to every task; more come back to each
document by a join with the tokens that stand before its periods. The units are the same either way.
A capitalised word after an abbreviation that may close a sentence begins a new one unless the document
shows it to be a proper name.

An abbreviation has at most eight characters. All searches are linear in a text's length.

Defined cases: null, empty and blank texts give no unit; an unclosed fence or front matter runs to the
end of the text as code (a lone ``---`` line that nothing closes is ignored); repeated rows give repeated
units under their own ids; positions are code points of the text as stored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, map_batches
from docloom.session import checkpointed, spread, table

# Abbreviations that stand before what they belong to, and those that may close a sentence.
INNER = {
    "e.g", "i.e", "cf", "vs", "no", "nos", "fig", "figs", "sec", "ch", "chap", "vol", "ed", "eds", "eq", "pp", "approx", "resp", "dr", "mr", "mrs", "ms.", "prof", "st", "jr", "viz",
    "z.b", "d.h", "u.a", "ca", "abb", "kap", "nr", "bzw", "vgl", "bspw", "evtl", "ggf", "inkl", "zzgl", "s.o", "s.u",
    "p.ex", "c.-à-d", "env", "réf", "art", "m", "mme",
    "p.ej", "aprox", "núm", "pág", "cap", "sr", "sra", "ex",
    "т.е", "рис", "гл", "ок", "см", "стр", "ул", "г", "напр", "табл",
    "π.χ", "περ", "δηλ", "βλ", "σελ",
}
CLOSING = {"etc", "a.m", "p.m", "u.s", "usw", "u.s.w", "т.д", "т.п", "и др", "др", "inc", "ltd", "co", "corp", "κ.λπ", "κλπ"}
#: Words before a number that its period makes an ordinal: "nach dem 3. Versuch".
ORDINAL_BEFORE = {"der", "die", "das", "dem", "den", "des", "am", "im", "vom", "zum", "zur", "beim", "ab", "bis", "seit", "jeder", "jede", "jedem", "jeden", "ein", "eine", "einem", "einer", "und"}

STRONG = "。！？｡।॥؟۔።፧"
CLOSERS = "\"'”’»›)]}」』）】〉》“‘"
MARK = regex.compile(rf"[.!?…]+(?=[\s{re.escape(CLOSERS)}{STRONG}]|$)|[!?…]+(?=[぀-ヿ㐀-鿿가-힯])|[{STRONG}][{STRONG}!?…]*|(?<=[Ͱ-Ͽἀ-῿]|[Ͱ-Ͽ].?[)`»\"])[;\u037e](?=[\s{re.escape(CLOSERS)}]|$)|\u037e")
CJK_END = re.compile(rf"[{STRONG}…]")
CJK = re.compile("[぀-ヿ㐀-鿿]")
THAI = re.compile("[ก-๎]")
THAI_GAP = re.compile("(?<=[ก-ฺเ-๎])\\s+(?=[ก-ฺเ-๎])")
LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|$)")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]*#{1,6}(?:[ \t]+|$)")
BULLET = re.compile(r"[ \t]*[-*+•][ \t]+")
NUMBERED = re.compile(r"[ \t]*(\d{1,9})[.)][ \t]+")
QUOTED = re.compile(r"[ \t]*>[ \t]?")
RULE = re.compile(r"[ \t]*([-*_=])(?:[ \t]*\1){2,}[ \t]*$")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "«": "»", "‹": "›", "„": "“", "“": "”"}
BRACKETS = re.compile("[" + re.escape("".join(PAIRS) + "".join(set(PAIRS.values())) + '"') + "]")
ROUND = set("([{（【")
DOTTED = re.compile(r"\.(\s+)(\S*)")
TRIM_LEFT = "([{\"'“„«`¿¡—–-*_（「"
WORDS = regex.compile(r"[\p{L}\p{M}]+")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each block's content, without its leading markers."""
    out: list[tuple[int, int]] = []
    fence, open_block, last_number = "", None, None
    at, size = 0, len(text)
    if text.startswith("﻿"):
        at = 1
    head = re.compile(r"---[ \t]*(?:\r\n|\r|\n)").match(text, at)
    if head:
        close = re.compile(r"(?:^|(?<=[\r\n]))---[ \t]*(?=\r|\n|$)").search(text, head.end())
        if close:
            at = close.end()

    def end_block() -> None:
        nonlocal open_block
        if open_block:
            out.append((open_block[0], open_block[1]))
            open_block = None

    while at < size:
        m = LINE.match(text, at)
        start, stop, nxt = m.start(1), m.end(1), m.end()
        at = nxt if nxt > at else size
        line = text[start:stop]
        bare = line.strip()
        if fence:
            if bare and bare[0] == fence[0] and bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            continue
        if not bare:
            end_block()
            last_number = last_number if out else None
            continue
        first = bare[0]
        if first in "`~":
            f = FENCE.match(line)
            if f:
                end_block()
                fence = f[1]
                continue
        if first == "|":
            end_block()
            continue
        if first in "-*_=" and RULE.match(line):
            end_block()
            continue
        offset, kind = 0, None
        while True:
            if first == ">" or line[offset:].lstrip()[:1] == ">":
                q = QUOTED.match(line, offset)
                if q:
                    offset, kind, first = q.end(), "quote", ""
                    continue
            if (q := HEADING.match(line, offset)) and kind != "item":
                offset, kind = q.end(), "heading"
                break
            if q := BULLET.match(line, offset):
                offset, kind, first = q.end(), "item", ""
                continue
            if q := NUMBERED.match(line, offset):
                number = int(q[1])
                # inside a paragraph only a list that begins, or goes on, can break in; else it is a wrapped number
                if open_block is None or number == 1 or last_number == number - 1:
                    offset, kind, last_number, first = q.end(), "item", number, ""
                    continue
            break
        if kind:
            end_block()
            open_block = [start + offset, stop]
            if kind != "item":
                end_block()
                last_number = None
        elif open_block:
            open_block[1] = stop
        else:
            open_block = [start, stop]
    end_block()
    return out


def intervals(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and parentheses; unmatched marks are ignored."""
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # how many of each closing mark the stack waits for
    found: list[tuple[int, int]] = []
    for m in BRACKETS.finditer(text, start, end):
        c, p = m[0], m.start()
        if waiting[c]:
            while True:
                mark, opened = stack.pop()
                waiting[mark] -= 1
                if mark == c:
                    break
            found.append((opened, p))
        elif c == '"':
            if p == start or not text[p - 1].isalnum():
                stack.append((c, p))
                waiting[c] += 1
        elif c in PAIRS:
            stack.append((PAIRS[c], p))
            waiting[PAIRS[c]] += 1
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def key_before(text: str, start: int, dot: int) -> tuple[str, str]:
    """The token that a period ends, with a short dotted part before it, and the word before that."""
    words = text[max(start, dot - 40) : dot].split()
    if not words:
        return "", ""
    last = words[-1].lstrip(TRIM_LEFT).lower()
    before = words[-2].lstrip(TRIM_LEFT).lower() if len(words) > 1 else ""
    if before.endswith(".") and len(before) <= 3 and before[:-1].isalpha() and 0 < len(last) <= 3 and last.isalpha():
        joined = before + last
        if len(last) == 1 or joined in INNER or joined in CLOSING:  # "z. B."; but "b." and "Kap." in "z. B. Kap. 3" are two
            return joined, ""
    return last, before


def word_before(text: str, start: int, at: int) -> str:
    """The word that ends before ``at``, as written."""
    words = text[max(start, at - 40) : at].split()
    return words[-1] if words else ""


def sort_of(word: str) -> str:
    """What follows: a plain small word, a name with inner marks, a number, a capital, or another script."""
    if not word:
        return "end"
    c = word.lstrip(TRIM_LEFT + "`")[:1]
    if word[0] == "`" or not c:
        return "name"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "name" if any(x.isupper() or x in "_./" or x.isdigit() for x in word.rstrip(".,;:!?)\"'…")) else "lower"
    if c.isupper():
        return "upper"
    return "other"


def evidence(text: str) -> Counter:
    """(key, sort) counts of all periods followed by a blank."""
    seen: Counter = Counter()
    for m in DOTTED.finditer(text):
        key, before = key_before(text, 0, m.start())
        if 0 < len(key) <= 8 and key[0].isalpha() and not (len(key) == 1 and before[:1].isdigit()):
            gap = m[1]
            breaks = gap.count("\n") or gap.count("\r")
            seen[key, "end" if breaks > 1 or not m[2] else sort_of(m[2])] += 1
    return seen


class Abbreviations:
    """Classes by key: ``inner`` never closes a sentence, ``closing`` may, ``word`` is none."""

    def __init__(self, corpus: dict[str, str]):
        self.corpus = corpus

    def of(self, key: str, before: str, own: dict[str, Counter]) -> str | None:
        if not key or len(key) > 8:
            return None
        if len(key) == 1 and (before[:1].isdigit() or not key.isalpha()):
            return None  # a unit after a number: "after 833 h."
        listed = "closing" if key in CLOSING else "inner" if key in INNER else None
        sense = self.corpus.get(key, listed)
        seen = own.get(key)  # a capital after it tells nothing; small letters do, and a block's end against it
        enough = 2 if len(key) <= 4 or "." in key else 3  # long tokens are rarely abbreviations
        if seen and seen["lower"] >= enough and seen["name"] + seen["other"] + seen["end"] == 0 and capitalises(own):
            return sense if sense in ("inner", "closing") else "inner"  # of which sort it is the document doesn't tell
        if seen and seen["end"] >= 2 and seen["lower"] + seen["digit"] == 0 and sense != "closing":
            return None
        return None if sense == "word" else sense


def capitalises(own: dict[str, Counter]) -> bool:
    """Sentences begin with capitals: more different tokens stand before them than before small letters.
    Else, in a text in small letters, a small letter after a period tells nothing."""
    return sum(c["upper"] > 0 for c in own.values()) >= sum(c["lower"] > 0 for c in own.values())


def classify(counts: dict[str, dict[str, int]]) -> dict[str, str]:
    """Corpus classes from the summed evidence."""
    out: dict[str, str] = {}
    for key, c in counts.items():
        total = sum(c.values())
        small, number, final = c.get("lower", 0), c.get("digit", 0), c.get("end", 0)
        known = key in INNER or key in CLOSING
        dotted = "." in key.strip(".")
        learnt = total >= 20 and (small >= 0.3 * total or (number >= 0.9 * total and final == 0))
        if not (known or learnt or (dotted and len(key) <= 5 and total >= 5)):
            if total >= 20:
                out[key] = "word"
            continue
        out[key] = "closing" if final >= 0.005 * total and total >= 20 else "closing" if key in CLOSING and total < 20 else "inner"
    return out


class Names:
    """How the document writes its words: which stand in small letters, and how often each capitalised one
    stands amid a sentence and at a sentence's or line's start. Read once, when first asked."""

    def __init__(self, text: str):
        self.text, self.read = text, False

    def _read(self) -> None:
        self.read, text = True, self.text
        self.small: set[str] = set()
        self.amid: Counter = Counter()
        self.first: Counter = Counter()
        last = 0
        for m in WORDS.finditer(text):
            a, b = m.span()
            gap, last = text[last:a], b
            if gap and (gap[-1].isdigit() or gap[-1] == "_") or b < len(text) and (text[b].isdigit() or text[b] == "_"):
                continue
            word = m[0]
            if not word[0].isupper():
                self.small.add(word)
                continue
            bare = gap.rstrip()
            if a == 0 or "\n" in gap[len(bare) :] or len(bare) < len(gap) and bare[-1:] in (".", "!", "?", "…", ":"):
                self.first[word] += 1
            elif gap == " " and text[a - 2].islower():
                self.amid[word] += 1

    def is_name(self, word: str) -> bool:
        """The document shows the word capitalised amid sentences, and neither small nor at another start."""
        found = WORDS.match(word)
        if not found:
            return False
        if not self.read:
            self._read()
        name = found[0]
        return name.lower() not in self.small and self.first[name] <= 1 and self.amid[name] > 1

    def is_initial(self, before: str, word: str) -> bool:
        """A single capital between ``before`` and ``word`` is an initial: a name or an initial goes before it,
        or another initial or a name follows, and what follows is no word that begins sentences."""
        found = WORDS.match(word)
        if not found or not found[0][0].isupper():
            return False
        if len(found[0]) == 1 and word[1:2] == ".":
            return True
        if not self.read:
            self._read()
        if found[0].lower() in self.small or found[0].lower() in STARTERS:
            return False
        return before[:1].isupper() and before.endswith(".") or self.is_name(word)


# Words that begin sentences and no names.
STARTERS = {
    "the", "a", "an", "this", "that", "these", "those", "it", "we", "he", "she", "they", "you", "i", "in", "on", "at", "for", "to", "if", "when", "then", "but", "and", "so", "there", "as", "not", "no", "use", "see",
    "der", "die", "das", "ein", "eine", "es", "wir", "sie", "er", "wenn", "dann", "aber", "und", "im", "am", "le", "la", "les", "un", "une", "il", "elle", "nous", "ce", "si", "el", "los", "las", "una", "en", "se", "no",
}


def cut(text: str, start: int, end: int, known: Abbreviations, own: dict[str, Counter], names: Names, thai: bool = False) -> list[tuple[int, int]]:
    """Sentence units of one block."""
    units: list[tuple[int, int]] = []
    spans = intervals(text, start, end) if BRACKETS.search(text, start, end) else []
    at, k = start, 0
    while at < end and text[at].isspace():
        at += 1
    ends = [(m.start(), m.end(), "mark") for m in MARK.finditer(text, start, end)]
    if thai:
        ends = sorted(ends + [(m.start(), m.end(), "thai") for m in THAI_GAP.finditer(text, start, end)])
    for a, b, kind in ends:
        if a < at:
            continue
        while k < len(spans) and spans[k][1] < a:
            k += 1
        inside = spans[k] if k < len(spans) and spans[k][0] < a <= spans[k][1] else None
        if kind == "thai":
            if not inside:
                units.append((at, a))
                at = b
            continue
        stop = b
        closed = None
        if inside:
            while stop < end and text[stop] in CLOSERS and stop < inside[1]:
                stop += 1
            if stop != inside[1]:
                continue
            closed, stop = inside, stop + 1
        while stop < end and text[stop] in CLOSERS and not (text[stop] in '"“‘' and stop + 1 < end and not text[stop + 1].isspace() and not closed):
            stop += 1
        after = stop
        while after < end and text[after].isspace():
            after += 1
        if after >= end:
            break
        tail = text[after : after + 40]
        following = tail.split(None, 1)[0] if tail else ""
        sort = sort_of(following)
        gap = after > stop
        mark = text[a:b]
        if not gap and not (CJK_END.search(mark) or CJK.match(text[after]) or "가" <= text[after] <= "힯"):
            continue
        if closed:
            opened = text[closed[0]]
            if opened in ROUND:
                if closed[0] != at:
                    continue
            else:
                said = text[max(at, closed[0] - 2) : closed[0]].rstrip()[-1:] in (":", "：")
                if text[after] in STRONG + ".!?…,;:，、；：":
                    continue
                if not said and sort in ("lower", "other", "digit"):
                    continue
        elif mark == ".":
            key, before = key_before(text, at, a)
            if key.isdigit() and len(key) <= 4 and sort in ("upper", "lower") and before in ORDINAL_BEFORE:
                continue
            if len(key) == 1 and key != key.upper() and not before[-1:].isdigit() and re.match(r"[^\W\d_]{1,3}\.(?:\s|$)", tail) and gap:
                continue  # the first part of "z. B."
            sense = known.of(key, before, own)
            if sense == "inner" or sense == "closing" and (sort == "lower" or sort == "upper" and names.is_name(following)):
                continue
            if sort == "upper" and text[a - 1 : a].isupper() and not text[max(at, a - 2) : a - 1].strip("([{\"'“„«. \t\r\n\u00a0") and names.is_initial(word_before(text, at, a - 1), following):
                continue
        elif set(mark) <= {".", "…"}:
            if sort == "lower" or sort == "other" and not CJK_END.search(mark):
                continue
        units.append((at, stop))
        at = after
    last = end
    while last > at and text[last - 1].isspace():
        last -= 1
    if last > at:
        units.append((at, last))
    return units


def units(text: str | None, known: Abbreviations) -> list[tuple[int, int]]:
    if not text:
        return []
    own: dict[str, Counter] = defaultdict(Counter)
    for (key, sort), n in evidence(text).items():
        own[key][sort] += n
    thai = THAI.search(text) is not None
    names = Names(text)
    out: list[tuple[int, int]] = []
    for start, end in blocks(text):
        out += cut(text, start, end, known, own, names, thai)
    return [(a, b) for a, b in out if b > a]


SORTS = ("lower", "digit", "upper", "name", "other", "end")


def corpus_classes(docs: DataFrame, text: str) -> DataFrame:
    """(k, sense): the abbreviation classes over all documents. ``word`` is left out: no listed key gets it, and
    for others it says what a missing class says."""
    schema = pa.schema([("k", pa.string()), ("sort", pa.string()), ("n", pa.int64())])
    classes = pa.schema([("k", pa.string()), ("sense", pa.string())])

    def count(rows: pa.RecordBatch):
        seen: Counter = Counter()
        for t in rows.column(0).to_pylist():
            if t:
                seen.update(evidence(t))
        yield batch(schema, [k for k, _ in seen], [s for _, s in seen], list(seen.values()))

    def judge(rows: pa.RecordBatch):
        found = classify({r["k"]: {s: r[s] for s in SORTS} for r in rows.to_pylist()})
        kept = [(k, sense) for k, sense in found.items() if sense != "word"]
        yield batch(classes, [k for k, _ in kept], [sense for _, sense in kept])

    counted = map_batches(spread(docs.select(F.col(text).cast("string"))), count, "k string, sort string, n long").groupBy("k").pivot("sort", list(SORTS)).agg(F.sum("n")).na.fill(0)
    return map_batches(counted, judge, "k string, sense string")


LOOKED_UP = re.compile(rf"\.(?=[\s{re.escape(CLOSERS)}{STRONG}]|$)")
PARTS = re.compile(f"[{re.escape(CLOSERS)}{STRONG}!?…]")


def lookups(text: str) -> set[str]:
    """All keys that ``cut`` may look up, wherever in the text its units begin."""
    keys: set[str] = set()
    for m in LOOKED_UP.finditer(text):
        key, _ = key_before(text, 0, m.start())
        last = text[max(0, m.start() - 40) : m.start()].split()[-1:]
        tail = last[0].lower() if last else ""
        keys |= {key, tail.lstrip(TRIM_LEFT), PARTS.split(tail)[-1].lstrip(TRIM_LEFT)}
    return {k for k in keys if 0 < len(k) <= 8 and k[0].isalpha()}


#: So many classes, each of at most eight characters, are broadcast: below 10 MB.
SHARED = 100_000


def split(docs: DataFrame, key: str, text: str, shared: int = SHARED) -> DataFrame:
    """(key, start_at, end_at) of every unit of every document."""
    schema = pa.schema([(key, pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64())])
    pairs = pa.schema([("id", pa.int64()), ("k", pa.string())])

    def ask(rows: pa.RecordBatch):
        asked = [(i, k) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) if t for k in lookups(t)]
        yield batch(pairs, [i for i, _ in asked], [k for _, k in asked])

    def cut_all(ids, texts, known) -> pa.RecordBatch:
        keys, starts, ends = [], [], []
        for n, (k, t) in enumerate(zip(ids.to_pylist(), texts.to_pylist(), strict=True)):
            for a, b in units(t, known(n)):
                keys.append(k)
                starts.append(a)
                ends.append(b)
        return batch(schema, keys, starts, ends)

    def run(rows: pa.RecordBatch):
        senses = rows.column(2).to_pylist()
        yield cut_all(rows.column(0), rows.column(1), lambda n: Abbreviations(dict(senses[n] or ())))

    texts = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")))
    classes = checkpointed(corpus_classes(docs, text))
    ddl = f"`{key}` long, start_at long, end_at long"
    if classes.count() <= shared:
        given = docs.sparkSession.sparkContext.broadcast({r["k"]: r["sense"] for r in classes.collect()})

        def run_shared(rows: pa.RecordBatch):
            yield cut_all(rows.column(0), rows.column(1), lambda _: Abbreviations(given.value))

        return map_batches(texts, run_shared, ddl)
    known = map_batches(texts, ask, "id long, k string").join(classes, "k").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("k", "sense"))).alias("senses"))
    met = texts.join(known.withColumnRenamed("id", "id_"), F.col("id").eqNullSafe(F.col("id_")), "left").select("id", "t", "senses")
    return map_batches(met, run, ddl)


def p9_found(spark, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_per_document(spark, sf_dir: str) -> DataFrame:
    """Units and their mean length by language tag as stored."""
    docs = table(spark, sf_dir, "documents")
    per = split(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.expr("end_at - start_at")).alias("chars"))
    return docs.select("doc_id", "lang").join(per, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


QUERIES = {"p9_found": p9_found, "p9_per_document": p9_per_document}
SQL: dict[str, str] = {}
