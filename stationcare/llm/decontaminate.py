"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is 10 consecutive words of a benchmark item (a shorter item is one window). Windows are sets of placed
shingles (3 words, fewer where a window has fewer). The places of all item shingles in the documents are found in
one pass; their counts order the shingles by rarity. A document that holds a window holds its rarest shingle, so
windows join the documents on that prefix only. Length and positional bounds drop starts where the window would
not fit, and a window counts where every one of its shingles stands at its place, which is exact containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.llm.words import placed_words, words
from stationcare.session import staged

WINDOW_WORDS = 10
SHINGLE = 3
BROADCAST_SHINGLES = 200_000


def item_windows(benchmark: DataFrame, size: int = WINDOW_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """``item, window, width, grams, shingles``: distinct windows of each item, as text, and their shingles."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(size)))
    cut = items.select("item", "width", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("w"))
    grams = F.least(F.col("width"), F.lit(shingle))
    return cut.distinct().select(
        "item", F.concat_ws(" ", "w").alias("window"), "width", grams.alias("grams"),
        F.transform(F.sequence(F.lit(1), F.col("width") - grams + 1),
                    lambda i: F.concat_ws(" ", F.slice("w", i, grams))).alias("shingles"))


def shingle_places(docs: DataFrame, shingles: DataFrame, grams: int, small: bool) -> DataFrame:
    """``doc_id, text_hash, n_words, place, shingle`` for every place of these shingles of ``grams`` words."""
    parts = F.split("shingle", " ")
    keys = shingles.select("shingle", *[F.get(parts, F.lit(i)).alias(f"_w{i}") for i in range(grams)])
    keys = keys.withColumn("_key", F.xxhash64(*[f"_w{i}" for i in range(grams)]))
    # only the words of a place go on from here, never the whole list of them
    ahead = [F.col("word"), *[F.get("words", F.col("place") + i) for i in range(1, grams)]]
    placed = placed_words(docs).filter((F.col("place") > 0) & ahead[-1].isNotNull()).select(
        "doc_id", "text_hash", (F.size("words") - 1).alias("n_words"), (F.col("place") - 1).alias("place"),
        F.xxhash64(*ahead).alias("_hash"), *[w.alias(f"_a{i}") for i, w in enumerate(ahead)])
    on = F.col("_hash") == F.col("_key")
    for i in range(grams):
        on &= F.col(f"_a{i}") == F.col(f"_w{i}")
    return placed.join(F.broadcast(keys) if small else keys, on).select(
        "doc_id", "text_hash", "n_words", "place", "shingle")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items with such windows,
    ``items_sha256`` digests their ids, sorted as text and joined by commas. Null or wordless texts and items have
    no words and match nothing. Rows that repeat give repeated results; an item id that stands on several rows
    has the windows of all; a null item_id counts as no item, though its words are hit.
    """
    text = ["doc_id", "text_hash"]
    windows = staged(item_windows(benchmark, size), "windows")
    distinct = windows.select("window", "width", "grams", "shingles").distinct()
    tokens = distinct.select("grams", F.explode("shingles").alias("shingle")).distinct()
    counts = {r["grams"]: r["n"] for r in tokens.groupBy("grams").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = None
    for grams in sorted(counts):
        some = shingle_places(docs, tokens.filter(F.col("grams") == grams).select("shingle"), grams,
                              counts[grams] <= BROADCAST_SHINGLES)
        places = some if places is None else places.unionByName(some)
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                         F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if places is None:
        return listed.select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"),
                             F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"),
                             F.lit(False).alias("contaminated"))
    places = staged(places.distinct(), "places")  # repeated rows have the same places

    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    placed = distinct.select("window", "width", F.size("shingles").alias("needed"),
                             F.posexplode("shingles").alias("at", "shingle"))
    # the prefix: the rarest shingle; a window with a shingle that stands nowhere cannot occur
    prefix = (placed.join(rarity, "shingle", "left").groupBy("window", "width", "needed")
              .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "at")).alias("p"))
              .filter("p.often > 0").select("window", "width", "needed", F.col("p.shingle").alias("shingle"), "p.at"))
    starts = (places.join(prefix, "shingle").withColumn("start", F.col("place") - F.col("at"))
              .filter((F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n_words")))
              .select(*text, "window", "width", "needed", "start"))
    wanted = starts.join(placed.select(F.col("window").alias("_window"), "at", "shingle"),
                         F.col("window") == F.col("_window")).select(
        *text, "window", "width", "needed", "start", (F.col("start") + F.col("at")).alias("place"), "shingle")
    key = lambda t: F.struct(t["doc_id"], t["text_hash"], t["place"], t["shingle"])
    met = (wanted.withColumn("_k", key(wanted)).join(places.select(key(places).alias("_p")),
                                                     F.col("_k") == F.col("_p"))
           .groupBy(*text, "window", "width", "needed", "start").agg(F.count(F.lit(1)).alias("met"))
           .filter("met = needed"))
    met = staged(met.select(*text, "window", "width", "start"), "occurrences")

    hit = (met.select(*text, F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("place"))
           .distinct().groupBy(*text).agg(F.count(F.lit(1)).alias("n_hit")))
    items = (met.select(*text, "window").distinct().join(windows.select("window", "item"), "window")
             .filter(F.col("item").isNotNull()).select(*text, "item").distinct()
             .groupBy(*text).agg(F.sort_array(F.collect_list("item")).alias("items")))
    facts = (hit.withColumn("_h", F.struct(*text)).select("_h", "n_hit")
             .join(items.withColumn("_i", F.struct(*text)).select("_i", "items"), F.col("_h") == F.col("_i"), "left")
             .select("_h", "n_hit", "items"))
    out = listed.withColumn("_k", F.struct(*text)).join(facts, F.col("_k") == F.col("_h"), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
