"""Cutting oversized texts into overlapping pieces at natural boundaries.

A rolling hash over the last ``WINDOW`` characters marks landmarks about every ``1 / 2**BITS`` characters.
Each landmark snaps to the nearest natural boundary, the stronger kinds drawing it from further away. A
piece ends at the first snapped landmark past the minimum size, or, where there is none, at the strongest
boundary before the maximum, or, in a run without any, at the maximum. Because both the hash and the
boundaries depend on nearby characters only, an edit changes the pieces around it and later cuts fall
into step again. Each piece but the first repeats the last ``OVERLAP`` characters before its cut.

Sizes are in code points. Defined cases: null, empty and short texts (up to the limit) give no piece, as
nothing has to be split; repeated rows are split alike; the pieces less their overlap join to the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import batch, map_batches
from docloom.session import spread, table

LIMIT = 3200
OVERLAP = 200
MINIMUM = 1200
WINDOW = 32
BITS = 8
#: Kinds of boundary, strongest first: the pattern's end is the cut; reach is how far a landmark may move.
BOUNDARIES = [
    (re.compile(r"\n(?=#{1,6} |### FILE: )"), 600),
    (re.compile(r"\n[ \t\r]*\n+(?=\S)"), 400),
    (re.compile(r"\n(?=\S)"), 250),
    (re.compile(r"\n"), 200),
    (re.compile(r"[.!?。！？।።؟…]+[\"'”’»」』)\]]*(?:\s+|(?<=[。！？]))"), 120),
    (re.compile(r"(?<=[;,}>])\s?|\s+"), 60),
]


def mix(codes: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit value per code point."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Shift-and-add hash of the ``window`` characters that end at each position, by doubling."""
    h, width = mix(codes), 1
    while width < window:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width]
        h = h + (moved << np.uint64(width))
        width *= 2
    return h


def boundaries(text: str) -> list[np.ndarray]:
    """Positions of each kind of boundary, strongest first; sentence ends and blanks are found when needed."""
    return [np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64) for pattern, _ in BOUNDARIES]


def snapped(marks: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Each landmark's nearest boundary of the strongest kind in reach; landmarks without any are dropped."""
    out = np.full(len(marks), -1, dtype=np.int64)
    for at, (_, reach) in zip(places, BOUNDARIES, strict=True):
        todo = np.flatnonzero(out < 0)
        if not len(todo) or not len(at):
            continue
        m = marks[todo]
        right = np.searchsorted(at, m)
        before, after = at[np.maximum(right - 1, 0)], at[np.minimum(right, len(at) - 1)]
        best = np.where(np.abs(m - before) <= np.abs(after - m), before, after)
        near = np.abs(best - m) <= reach
        out[todo[near]] = best[near]
    return np.unique(out[out > 0])


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[int]:
    """End positions of the pieces, the text's length last."""
    size = len(text)
    if size <= limit:
        return [size]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mask = np.uint64((1 << BITS) - 1) << np.uint64(24)
    marks = np.flatnonzero((rolling(codes) & mask) == mask) + 1
    places = boundaries(text)
    landmarks = snapped(marks, places)
    core, ends, start = limit - overlap, [], 0
    while size - start > (limit if not ends else core):
        low, high = start + minimum, start + core
        i = int(np.searchsorted(landmarks, low))
        if i < len(landmarks) and landmarks[i] <= high:
            cut = int(landmarks[i])
        else:
            cut = high
            for at in places:
                j = int(np.searchsorted(at, high, side="right")) - 1
                if j >= 0 and at[j] >= low:
                    cut = int(at[j])
                    break
        ends.append(cut)
        start = cut
    return [*ends, size]


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[tuple[int, int]]:
    """(start, end) of each piece; none where nothing has to be split."""
    if not text or len(text) <= limit:
        return []
    ends = cuts(text, limit, overlap, minimum)
    return [(0 if i == 0 else max(0, ends[i - 1] - overlap), e) for i, e in enumerate(ends)]


def split(df: DataFrame, key: str, field: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM, with_text: bool = True) -> DataFrame:
    """Rows (key, field, piece_no, start_at, end_at[, piece]) of every value longer than ``limit``."""
    columns = [(key, pa.int64()), (field, pa.string()), ("piece_no", pa.int32()), ("start_at", pa.int64()), ("end_at", pa.int64())] + ([("piece", pa.string())] if with_text else [])
    schema = pa.schema(columns)

    def run(rows: pa.RecordBatch):
        out: list[tuple] = []
        for k, f, t in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            out += [(k, f, i, a, b, *([t[a:b]] if with_text else [])) for i, (a, b) in enumerate(pieces(t, limit, overlap, minimum))]
        yield batch(schema, *([list(c) for c in zip(*out, strict=True)] or [[] for _ in columns]))

    ddl = f"`{key}` long, `{field}` string, piece_no int, start_at long, end_at long" + (", piece string" if with_text else "")
    return map_batches(df.select(F.col(key).cast("long"), F.col(field), F.col(text)).where(F.length(text) > limit), run, ddl)


def long_values(spark, sf_dir: str) -> DataFrame:
    """One row per value of ``after`` and ``existing``."""
    units = spread(table(spark, sf_dir, "change_units").select("change_id", "after", "existing").where((F.length("after") > LIMIT) | (F.length("existing") > LIMIT)))
    return units.select("change_id", F.expr("stack(2, 'after', after, 'existing', existing) as (field_name, text)"))


def p1_pieces(spark, sf_dir: str) -> DataFrame:
    return split(long_values(spark, sf_dir), "change_id", "field_name", "text")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Values that had to be split: those with a piece beyond the first."""
    return split(long_values(spark, sf_dir), "change_id", "field_name", "text", with_text=False).where("piece_no = 1").select("change_id", "field_name")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL: dict[str, str] = {
    "p1_found": """
SELECT change_id, 'after' AS field_name FROM change_units WHERE length(after) > 3200
UNION ALL SELECT change_id, 'existing' FROM change_units WHERE length(existing) > 3200""",
}
