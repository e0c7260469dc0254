"""License scan by diagonal voting, in DataFrame operations only.

Every rolling pair of words of every text is hashed and joined to the places of equal pairs in the templates
(three words where a template is that long). A hit votes for the diagonal ``place in text - place in template``;
votes are counted per (text, template, diagonal), neighbouring diagonals are merged so that a few inserted or
lost words do not split a copy, and a merged span counts if it covers enough of the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationcare.llm.words import HEAD, placed_words

# fixed values: phrases and labels of the base scan
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: well-known sentences and paragraphs of license texts, as words
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
    "an action of contract tort or otherwise arising from out of or in connection with the software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "see the license for the specific language governing permissions and limitations under the license": "apache",
    "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable "
    "copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and "
    "distribute the work and such derivative works in source or object form": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed": "bsd",
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however "
    "caused and on any theory of liability whether in contract strict liability or tort": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "covered software is provided under this license on an as is basis without warranty of any kind either expressed "
    "implied or statutory": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc",
    "you must give appropriate credit provide a link to the license and indicate if changes were made": "cc",
}
GRAM = 3
DRIFT = 3
COVERAGE = 0.7
#: Number of the template that stands for the text itself.
TEXT = -1


def template_grams(spark, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """One row per gram of every template, with its number; phrases are templates that must be met whole."""
    rows = []
    listed = [(True, *p) for p in phrases.items()] + [(False, *t) for t in templates.items()]
    for number, (whole, text, label) in enumerate(listed):
        w = text.split(" ")
        gram = min(GRAM, len(w))
        if gram < 2:
            raise ValueError("a template needs two words")
        for i in range(len(w) - gram + 1):
            rows.append((number, label, whole, len(w), len(w) - gram + 1, i, w[i], w[i + 1],
                         w[i + 2] if gram == 3 else None))
    rows.append((TEXT, None, True, 0, 0, 0, HEAD, None, None))
    return spark.createDataFrame(rows, "template int, label string, whole boolean, size int, grams int, at int, "
                                       "a string, b string, c string")


def license_hits(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                 templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Votes: a row per (text, template place, text place), and one row per text with the template TEXT."""
    # of fixed size: the templates are parameters, not data
    grams = F.broadcast(template_grams(docs.sparkSession, phrases, templates)
                        .withColumn("key", F.xxhash64("a", F.coalesce("b", F.lit("")))))
    placed = placed_words(docs)
    second, third = F.get("words", F.col("place") + 1), F.get("words", F.col("place") + 2)
    key = F.xxhash64("word", F.when(F.col("place") > 0, F.coalesce(second, F.lit(""))).otherwise(""))
    same = ((F.col("_key") == F.col("key")) & (F.col("word") == F.col("a"))
            & (F.col("b").isNull() | (F.col("b") == second)) & (F.col("c").isNull() | (F.col("c") == third)))
    return (placed.withColumn("_key", key).join(grams, same)
            .select("doc_id", "text_hash", (F.size("words") - 1).alias("n_words"), "template", "label", "whole",
                    "size", "grams", "at", (F.col("place") - 1).alias("place")))


def license_spans(hits: DataFrame, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """Merged and verified spans: ``doc_id, text_hash, template, label, whole, first, last, covered``.

    Diagonals of one template that lie within ``drift`` of the one before are one span; what it covers is the
    share of the template's grams that voted. Phrases do not merge and must be covered whole.
    """
    text = ["doc_id", "text_hash", "template"]
    votes = hits.filter(F.col("template") != TEXT).withColumn("diagonal", F.col("place") - F.col("at"))
    lines = (votes.groupBy(*text, "label", "whole", "grams", "size", "diagonal")
             .agg(F.collect_set("at").alias("ats"), F.min("place").alias("first")))
    ordered = Window.partitionBy(*text).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(ordered)
    joined = lines.withColumn("_new", F.when(~F.col("whole") & (gap <= drift), 0).otherwise(1)).withColumn(
        "_span", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (joined.groupBy(*text, "label", "whole", "grams", "size", "_span")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("met"),
                  F.min("first").alias("first"), F.max(F.col("diagonal") + F.col("size") - 1).alias("last")))
    covered = F.col("met") / F.col("grams")
    enough = F.when(F.col("whole"), covered >= 1).otherwise(covered >= coverage)
    return spans.withColumn("covered", covered).filter(enough).select(
        *text, "label", "whole", "first", "last", "covered")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the largest covered share of any template (1 for a phrase). Null and empty texts have no words,
    no labels (empty strings) and score 0. Repeated rows give repeated results; an empty table gives none.
    """
    hits = license_hits(docs, phrases, templates)
    text = ["doc_id", "text_hash"]
    # equal rows vote together: count them once, and give the result as often as they stand there
    once = hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("copies"))
    spans = license_spans(once)
    marks = (F.when(F.col("whole"), F.col("first")), F.when(F.col("whole"), F.col("label")))
    facts = (spans.select(*text, marks[0].alias("start"), marks[1].alias("base"), "label", "covered",
                          F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"))
             .unionByName(once.filter(F.col("template") == TEXT).select(
                 *text, F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("base"),
                 "label", F.lit(None).cast("double").alias("covered"), "n_words", "copies")))
    listed = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    out = facts.groupBy(*text).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("start").alias("n_base"),
        F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        listed("base").alias("base_labels"), listed("label").alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"), F.max("copies").alias("_copies"))
    return (out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .drop("_copy", "_copies", "text_hash"))
