"""Pages and files as rows: sections with heading paths, chunks, hunks of differences, replaced sections.

These follow a state from line to line (fence, heading levels, size of the open chunk), which no set
operation expresses; each is a short function over one text, run on Arrow batches.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import tidy_path
from docloom.session import spread, table

CHUNK_CHARS = 1200
WINDOW_LINES, OVERLAP_LINES, LOOK_BACK, PART_CHARS = 80, 10, 15, 3200
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,4})[ \t]+(.*?)[ \t#]*$")
_FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n.*?^---[ \t]*\r?$\n?", re.S | re.M)


def sections(text: str) -> list[tuple[str, int, str]]:
    """(heading path, level, text) in order; their texts join to the page. Headings in fences don't count, text
    before the first heading is ``(preamble)``, a repeated path gets a number."""
    out: list[tuple[str, int, list[str]]] = []
    trail: list[tuple[int, str]] = []
    fence = ""
    for line in text.splitlines(keepends=True):
        if m := _FENCE.match(line):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif not fence and (h := _HEADING.match(line.rstrip("\r\n"))):
            trail = [t for t in trail if t[0] < len(h[1])] + [(len(h[1]), h[2].strip())]
            out.append((" > ".join(t for _, t in trail), len(h[1]), []))
        if not out:
            out.append(("(preamble)", 0, []))
        out[-1][2].append(line)
    seen: dict[str, int] = {}
    named = []
    for path, level, lines in out:
        seen[path] = seen.get(path, 0) + 1
        named.append((path if seen[path] == 1 else f"{path} #{seen[path]}", level, "".join(lines)))
    return named


def chunks(text: str, limit: int = CHUNK_CHARS) -> list[tuple[str, str]]:
    """(heading, chunk): the page's parts between headings, each packed from whole paragraphs up to the limit;
    one longer paragraph stays whole. Front matter is left out."""
    out: list[tuple[str, str]] = []
    for part in re.split(r"(?m)^(?=#{1,4}[ \t])", _FRONT.sub("", text, count=1)):
        head = _HEADING.match(part.split("\n", 1)[0].rstrip("\r"))
        held: list[str] = []
        for paragraph in (p.strip() for p in re.split(r"\n\s*\n", part)):
            if not paragraph:
                continue
            if held and sum(map(len, held)) + len(paragraph) > limit:
                out.append((head[2] if head else "", "\n\n".join(held)))
                held = []
            held.append(paragraph)
        if held:
            out.append((head[2] if head else "", "\n\n".join(held)))
    return out


def last_line(lines: list[str], first: int, size: int = WINDOW_LINES, back: int = LOOK_BACK) -> int:
    """Where a window that begins at ``first`` ends: after the last blank line among its last ones, else full."""
    full = first + size
    if full >= len(lines):
        return len(lines)
    blank = [e for e in range(max(first + 2, full - back + 1), full + 1) if not lines[e - 1].strip()]
    return blank[-1] if blank else full


def parts(body: str, limit: int | None) -> list[str]:
    """A window's text in consecutive parts of at most ``limit`` characters, cut after line ends where there are any."""
    out = []
    while limit and len(body) > limit:
        cut = body.rfind("\n", limit // 2, limit) + 1 or limit
        out.append(body[:cut])
        body = body[cut:]
    return [*out, body]


def windows(text: str, path: str = "", limit: int | None = PART_CHARS) -> list[tuple[int, int, int, str]]:
    """(first line, last line, part, text) of overlapping windows over a file. Blank windows are dropped; one that
    is too long comes in several parts, so nothing is lost. With a path each text says where it is from."""
    lines = text.split("\n")
    out, first, end = [], 0, -1
    while end < len(lines):
        end = last_line(lines, first)
        body = "\n".join(lines[first:end])
        if body.strip():
            where = f"FILE {path} lines {first + 1}-{end}\n" if path else ""
            out += [(first + 1, end, n, where + p) for n, p in enumerate(parts(body, limit))]
        first = max(first + 1, end - OVERLAP_LINES)
    return out


def anchored(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Stretches (i, j, k, l) in which old[i:j] was replaced by new[k:l]. Lines that stand once on either side and
    rise on both are kept in place; only what lies between such anchors is compared line by line."""
    once = lambda lines: {x for x, n in Counter(lines).items() if n == 1}
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        i, j, k, l = todo.pop()
        while i < j and k < l and old[i] == new[k]:
            i, k = i + 1, k + 1
        while i < j and k < l and old[j - 1] == new[l - 1]:
            j, l = j - 1, l - 1
        if i == j or k == l:
            if i < j or k < l:
                out.append((i, j, k, l))
            continue
        unique = once(old[i:j]) & once(new[k:l])
        place = {x: n for n, x in enumerate(new[k:l], k) if x in unique}
        tops: list[int] = []  # least last place of a rising run of each length
        backs: list[tuple[int, int, int]] = []  # (old, new, entry before)
        ends: list[int] = []
        for n, x in enumerate(old[i:j], i):
            if x in unique:
                at = bisect_left(tops, place[x])
                backs.append((n, place[x], ends[at - 1] if at else -1))
                tops[at : at + 1] = [place[x]]
                ends[at : at + 1] = [len(backs) - 1]
        if not ends:
            matcher = difflib.SequenceMatcher(None, old[i:j], new[k:l], autojunk=(j - i) * (l - k) > 4_000_000)
            out += [(i + a, i + b, k + c, k + d) for tag, a, b, c, d in matcher.get_opcodes() if tag != "equal"]
            continue
        at, after = ends[-1], (j, l)
        while at >= 0:
            n, m, at_before = backs[at]
            todo.append((n + 1, after[0], m + 1, after[1]))
            after, at = (n, m), at_before
        todo.append((i, after[0], k, after[1]))
    return sorted(out)


def hunks(old: str, new: str, context: int = 3) -> list[tuple[int, int, int, int, str]]:
    """(old line, new line, removed, added, text) of each group of differences with the lines around it."""
    a, b = old.splitlines(), new.splitlines()
    groups: list[list[tuple[int, int, int, int]]] = []
    for s in anchored(a, b):
        if groups and s[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(s)
        else:
            groups.append([s])
    out = []
    for g in groups:
        at, end = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        lines, here = [], at
        for i, j, k, l in g:
            lines += [f" {x}" for x in a[here:i]] + [f"-{x}" for x in a[i:j]] + [f"+{x}" for x in b[k:l]]
            here = j
        lines += [f" {x}" for x in a[here:end]]
        out.append((at + 1, g[0][2] - (g[0][0] - at) + 1, sum(j - i for i, j, _, _ in g), sum(l - k for _, _, k, l in g), "\n".join(lines)))
    return out


def replace_sections(text: str, operations: list[tuple[str, str, str]]) -> str:
    """Apply (operation, section, text): ``replace``, ``delete``, ``insert_after``. Operations on sections that
    are not there are left out; without any, the text is unchanged."""
    kept = []
    todo = {}
    for op, section, body in operations:
        todo.setdefault(section, []).append((op, body))
    for path, _, body in sections(text):
        after = ""
        for op, new in todo.get(path, []):
            if op == "delete":
                body = ""
            elif op == "replace":
                blank = re.search(r"(?:\r?\n)*\Z", body)
                body = new.rstrip("\n") + (blank[0] if blank else "")
            elif op == "insert_after":
                after += new.rstrip("\n") + "\n\n"
        kept += [body, after]
    return "".join(kept)


def rows_of(df: DataFrame, columns: list[str], function: Callable, ddl: str, schema: pa.Schema) -> DataFrame:
    """Rows that ``function`` makes of each row's values: a first column is the key, repeated on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(key, i, *row) for i, row in enumerate(function(*values))]
            columns_ = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns_, schema, strict=True)], schema=schema)

    return spread(df.select(*columns)).mapInArrow(run, ddl)


def scope(text: str, operations: list[tuple[str, str, str]]) -> tuple[int, int, list[str]]:
    """(characters of sections that operations touch, of all others, the touched sections)."""
    touched = {section for _, section, _ in operations}
    each = sections(text)
    return sum(len(x) for p, _, x in each if p in touched), sum(len(x) for p, _, x in each if p not in touched), [p for p, _, _ in each if p in touched]


def patched(pages: DataFrame, operations: DataFrame, key: str, text: str) -> DataFrame:
    """(key, patched, touched, untouched, sections): pages (key, text) after the operations (key, place, op, section,
    body) on their sections, in order of place, and how much of each page these touch. Pages without operations
    stay as they are; operations on sections or pages that are not there are left out."""
    listed = operations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "op", "section", F.coalesce("body", F.lit("")).alias("body")))).alias("ops"))
    met = pages.select(key, text).join(listed, key, "left")
    schema = pa.schema([(key, pa.int64()), ("place", pa.int64()), ("patched", pa.string()), ("touched", pa.int64()), ("untouched", pa.int64()), ("sections", pa.string())])

    def run(page: str | None, ops: list[dict] | None) -> list[tuple]:
        todo = [(o["op"], o["section"], o["body"]) for o in ops or []]
        touched, untouched, names = scope(page or "", todo)
        return [(page if page is None else replace_sections(page, todo), touched, untouched, "|".join(names))]

    return rows_of(met, [key, text, "ops"], run, f"`{key}` long, place long, patched string, touched long, untouched long, sections string", schema).drop("place")


def patched_pages(spark, sf_dir: str) -> DataFrame:
    """Published pages with the sections that the new text words otherwise put in, one by one, in their place: what
    of the page that touches, and the digest of the result."""
    units = table(spark, sf_dir, "change_units").where("kind = 'docs' and existing <> '' and after <> ''")
    schema = pa.schema([("change_id", pa.int64()), ("place", pa.int64()), ("op", pa.string()), ("section", pa.string()), ("body", pa.string())])

    def differing(old: str, new: str) -> list[tuple]:
        before = {p: x for p, _, x in sections(old)}
        return [("replace", p, x) for p, _, x in sections(new) if p in before and before[p] != x]

    operations = rows_of(units, ["change_id", "existing", "after"], differing, "change_id long, place long, op string, section string, body string", schema)
    done = patched(units, operations, "change_id", "existing")
    return done.select("change_id", "touched", "untouched", F.md5("patched").alias("digest"))


def document_sections(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("section", pa.string()), ("level", pa.int32()), ("chars", pa.int64())])
    return rows_of(docs, ["doc_id", "text"], lambda t: [(p, l, len(x)) for p, l, x in sections(t)], "doc_id long, place long, section string, level int, chars long", schema)


def document_chunks(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("heading", pa.string()), ("chunk", pa.string())])
    return rows_of(docs, ["doc_id", "text"], chunks, "doc_id long, place long, heading string, chunk string", schema)


def code_chunks(spark, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after <> ''").withColumn("file", F.coalesce(tidy_path(F.col("filePath")), F.lit("")))
    schema = pa.schema([("change_id", pa.int64()), ("place", pa.int64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("part", pa.int64()), ("chunk", pa.string())])
    return rows_of(units, ["change_id", "after", "file"], windows, "change_id long, place long, first_line long, last_line long, part long, chunk string", schema)


def page_differences(spark, sf_dir: str) -> DataFrame:
    """One row per hunk between the published and the new page."""
    units = table(spark, sf_dir, "change_units").where("existing <> '' and after <> '' and kind = 'docs'")
    schema = pa.schema([("change_id", pa.int64()), ("place", pa.int64()), ("old_line", pa.int64()), ("new_line", pa.int64()), ("removed", pa.int64()), ("added", pa.int64()), ("hunk", pa.string())])
    return rows_of(units, ["change_id", "existing", "after"], hunks, "change_id long, place long, old_line long, new_line long, removed long, added long, hunk string", schema)


def chunk_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of each file, and how many of them its chunks reach: all, but for blank windows."""
    found = code_chunks(spark, sf_dir).select("change_id", "first_line", "last_line").distinct()
    reach = found.groupBy("change_id").agg(F.max("last_line").alias("reached"), F.count("*").alias("windows"))
    units = table(spark, sf_dir, "change_units").where("kind = 'code' and after <> ''")
    return units.select("change_id", F.size(F.split("after", "\n", -1)).cast("long").alias("lines")).join(reach, "change_id").where("lines <= 80").select("change_id", "lines", "windows")


def section_lengths(spark, sf_dir: str) -> DataFrame:
    """Sections and their characters per document: they cover the text."""
    return document_sections(spark, sf_dir).groupBy("doc_id").agg(F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (document_sections, document_chunks, code_chunks, page_differences, patched_pages, chunk_lines, section_lengths)}
SQL = {
    "chunk_lines": "SELECT change_id, CAST(len(string_split(after, chr(10))) AS BIGINT) AS lines, CAST(1 AS BIGINT) AS windows FROM change_units WHERE kind = 'code' AND after <> '' AND len(string_split(after, chr(10))) <= 80 AND regexp_matches(after, '[^ \\t\\r\\n\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}]')",
    "section_lengths": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''",
}
