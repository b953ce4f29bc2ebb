"""A deterministic bag-of-words embedding: each word adds one to the dimension that its hash names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 64


def word_slot(word: Column, dimension: int = DIMENSION) -> Column:
    """``h = h * 31 + code`` over the characters, modulo the dimension."""
    return F.aggregate(F.split(word, ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % dimension)


def slots(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, slot, n): the non-zero parts of each text's vector. Null and blank texts have none."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9_]+)"))).alias("word"))
    # counted on the map side: at most one row per part of the vector and text is exchanged, no words
    return words.groupBy(key, word_slot(F.col("word"), dimension).alias("slot")).agg(F.count("*").alias("n"))
