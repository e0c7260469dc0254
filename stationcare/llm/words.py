"""Words of texts as column expressions, and their places as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands before the words of a text as its place 0; no word holds a blank.
HEAD = "a text"


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else; plain ASCII takes the cheap way. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, CAPITALS, CAPITALS.lower()))


def words(text: Column) -> Column:
    """Array of the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the lowered text."""
    return F.array_remove(F.split(lowered(text), NOT_WORD), "")


def placed_words(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, words, place, word``: one row per word, with place 0 for the text itself (HEAD).

    ``words`` holds HEAD and then the words, so a word's place is its index.
    """
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                         F.concat(F.array(F.lit(HEAD)), words(F.col("text"))).alias("words"))
    return listed.select("doc_id", "text_hash", "words", F.posexplode("words").alias("place", "word"))
