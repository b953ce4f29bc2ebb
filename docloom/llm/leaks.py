"""Evaluation passages in training text: every document that holds twelve consecutive words of an item.

Both sides are normalised to words. Any twelve consecutive words of an item hold one of its anchors, the
six words at every seventh place, whole. The anchors are the patterns of one Aho-Corasick automaton over
words; each document is scanned once, and an anchor met is followed word by word to both sides for as long
as document and item agree. Runs of twelve words and more are passages, with offsets in the original text.

An item's words are kept once, and its anchors take less than one node of the automaton per word, so one
automaton holds very many items. Only beyond ``block_words`` words are items taken in blocks, each with an
automaton and a scan of its own, so that no task ever holds more.

Defined cases: null and empty texts and items, and items shorter than the window, match nothing; an item
occurring several times in a document makes one row of ``found`` and one row per passage of ``passages``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, map_batches
from docloom.session import spread, table

WINDOW = 12
#: Words of the items of one automaton: about 100 bytes each in a task.
BLOCK_WORDS = 5_000_000
WORD = re.compile(r"[^\W_]+")


@dataclass
class Patterns:
    """The items' words as numbers, and the automaton of their anchors."""

    width: int
    keys: list[int] = field(default_factory=list)
    words: list[tuple[int, ...]] = field(default_factory=list)
    number: dict[str, int] = field(default_factory=dict)
    automaton: ahocorasick.Automaton | None = None
    anchor: int = 0


def patterns(items: list[tuple[int, str | None]], width: int = WINDOW) -> Patterns:
    """Anchors of ``anchor`` words at every ``step``-th place: a window of ``width`` words holds one whole, as
    ``step + anchor - 1 <= width``. The value of each is where it stands: (item, place)."""
    made = Patterns(width, anchor=max(1, width // 2))
    step = width + 1 - made.anchor
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for key, text in items:
        words = tuple(made.number.setdefault(w, len(made.number) + 1) for w in WORD.findall(text.lower())) if text else ()
        if len(words) < width:
            continue
        for at in range(0, len(words) - made.anchor + 1, step):
            places.setdefault(words[at : at + made.anchor], []).append((len(made.keys), at))
        made.keys.append(key)
        made.words.append(words)
    if places:
        made.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for anchor, held in places.items():
            made.automaton.add_word(anchor, held)
        made.automaton.make_automaton()
    return made


_built: dict[tuple, Patterns] = {}


def cached(items: list[tuple[int, str]], width: int) -> Patterns:
    key = (width, len(items), zlib.crc32(repr(items).encode()))
    if key not in _built:
        _built.clear()
        _built[key] = patterns(items, width)
    return _built[key]


def runs(words: list[str], known: Patterns) -> dict[int, list[list[int]]]:
    """(item) -> runs (first, last word) of the document that the item holds, at least ``width`` words long."""
    out: dict[int, list[list[int]]] = {}
    if known.automaton is None or len(words) < known.width:
        return out
    number = known.number
    document = tuple([number.get(w, 0) for w in words])
    reached: dict[tuple[int, int], int] = {}  # how far document and item have been compared, by item and shift
    for end, held in known.automaton.iter(document):
        first = end + 1 - known.anchor
        for item, at in held:
            shift = first - at
            if reached.get((item, shift), -1) > end:
                continue
            theirs = known.words[item]
            a, b = first, end + 1
            while a > 0 and a > shift and document[a - 1] == theirs[a - 1 - shift]:
                a -= 1
            while b < len(document) and b - shift < len(theirs) and document[b] == theirs[b - shift]:
                b += 1
            reached[item, shift] = b
            if b - a >= known.width:
                out.setdefault(item, []).append([a, b - 1])
    return out


def hits(text: str | None, known: Patterns) -> set[int]:
    return {known.keys[item] for item in runs(WORD.findall(text.lower()), known)} if text else set()


def spans(text: str | None, known: Patterns) -> list[tuple[int, int, int]]:
    """(item, start, end) in the original text; overlapping runs of one item are joined to one passage."""
    if not text:
        return []
    lower = text.lower()
    found = list(WORD.finditer(lower))
    passages: dict[int, list[list[int]]] = {}
    for item, each in runs([m[0] for m in found], known).items():
        joined = passages.setdefault(known.keys[item], [])
        joined += each
    at = None
    out = []
    for key, each in passages.items():
        each.sort()
        joined: list[list[int]] = []
        for a, b in each:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        if at is None:
            at = range(len(lower) + 1)
            if len(lower) != len(text):  # some characters have a longer lower case
                at = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        out += [(key, at[found[a].start()], at[found[b].end() - 1] + 1) for a, b in joined]
    return out


def blocks(items: DataFrame, key: str, text: str, width: int, block_words: int):
    """Items in blocks of about ``block_words`` words, collected one block at a time."""
    usable = items.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") >= 2 * width - 1)
    size = usable.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // block_words))
    for b in range(count if size else 0):
        yield [(r["key"], r["text"]) for r in usable.where(F.pmod(F.xxhash64("key"), F.lit(count)) == b).distinct().collect()]


def scan(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, with_spans: bool, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    texts = spread(docs.select(F.col(doc_key).cast("long"), F.col(doc_text).cast("string")).where(F.length(doc_text) >= 2 * width - 1))
    names = [(doc_key, pa.int64()), (item_key, pa.int64())] + ([("start_at", pa.int64()), ("end_at", pa.int64())] if with_spans else [])
    schema = pa.schema(names)
    ddl = ", ".join(f"`{n}` long" for n, _ in names)
    spark, out = docs.sparkSession, None
    for block in blocks(items, item_key, item_text, width, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(rows: pa.RecordBatch, shared=shared):
            known = cached(shared.value, width)
            keys, found = [], []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                for hit in spans(text, known) if with_spans else hits(text, known):
                    keys.append(doc)
                    found.append(hit if with_spans else (hit,))
            yield batch(schema, keys, *(list(c) for c in zip(*found, strict=True))) if found else batch(schema, *[[] for _ in names])

        part = map_batches(texts, run, ddl)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ddl) if out is None else out


def p8_found(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", False)


def p8_passages(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", True)


QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages}
SQL: dict[str, str] = {
    # word arrays of both sides, windows of twelve joined by equality
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
     i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
     dw AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12),
     iw AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id
FROM (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM dw) JOIN (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM iw) USING (s)"""
}
