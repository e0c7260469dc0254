import re

from llm import brute

from stationcare.llm import decontaminate, licenses

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item of words"), (3, "solo"),
         (4, "two words"), (5, None), (6, "..."), (7, "one two three four five six seven eight nine ten"),
         (7, "a second text of the same item that has more than ten words in it"), (None, "nameless item here")]


def test_contamination_equals_brute_force(spark, docs, rows):
    items = ITEMS + [(100 + i, t) for i, t in rows[:6]] + [(200, dict(rows)[300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(500, "x " + ITEMS[0][1] + " y solo"), (501, "ONE TWO THREE four five six seven eight nine, ten!"),
            (502, "one two three four five six seven eight nine"), (503, "a short item, of words. two words two words"),
            (503, "a short item, of words. two words two words"), (None, "solo"), (504, "nameless item here"),
            (505, "solo " * 3000)]
    both = docs.select("doc_id", "text", "key").union(
        spark.createDataFrame([(i, t, "k") for i, t in more], "doc_id long, text string, key string"))
    got = [tuple(r) for r in decontaminate.contamination(both, bench).drop("text_hash").collect()]
    assert sorted(got, key=str) == sorted(brute.contamination([*rows, *more], items), key=str)


def test_contamination_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    bench = spark.createDataFrame([(200, dict(rows)[300])], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).drop("text_hash").collect()]
    assert sorted(got) == sorted(brute.contamination(rows, [(200, dict(rows)[300])]))


def test_contamination_of_empty_tables(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs, none).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in got)
    assert decontaminate.contamination(docs.limit(0), none).collect() == []
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []


def test_decontamination_plan_has_no_python(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (decontaminate.shingle_places(docs, bench.selectExpr("text AS shingle"), 3, True),
               licenses.scan_licenses(docs.select("doc_id", "text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_no_exchange_carries_the_words_of_a_text(spark, docs):
    shingles = docs.selectExpr("text AS shingle")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = decontaminate.shingle_places(docs, shingles, 3, False)
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(_hash" in line)
    assert "Project [" in lines[at + 1] and " AS _a2#" in lines[at + 1]
    assert not re.search(r", words#\d+[,\]]", lines[at + 1])


LICENSED = [
    (1, "Released under the MIT License."), (2, "mit-license MIT  license, the mit license"),
    (3, "Apache License and the GNU General Public License; general public license"), (4, "mit"), (5, None), (6, ""),
    (7, "Licensed under the Apache License, Version 2.0."), (7, "Licensed under the Apache License, Version 2.0."),
    (None, "apache license"), (8, "éMIT license"),
    (9, "Permission is hereby granted, free of charge, to ANY other person obtaining a copy of this software"),
    (10, "Redistribution and use in source and quite binary forms, with or without modification, are permitted"),
    (11, "apache and license of the use"), (12, "license " * 50 + "mit license " * 2000),
]


def test_license_base_equals_brute_force(spark, docs, rows):
    own = spark.createDataFrame([(i, t, "m") for i, t in LICENSED], "doc_id long, text string, label string")
    both = own.union(docs.select("doc_id", "text", "key"))
    got = sorted((tuple(r)[:6] for r in licenses.scan_licenses(both).collect()), key=str)
    want = []
    for i, text in [*LICENSED, *rows]:
        n, starts, labels = brute.base_phrases(text, licenses.PHRASES)
        want.append((i, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=str)


def test_license_templates_survive_small_edits(spark):
    df = spark.createDataFrame(LICENSED, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[9]["labels"] == "mit" and got[9]["base_labels"] == "" and 0.7 <= got[9]["score"] < 1
    assert got[10]["labels"] == "bsd" and got[11]["labels"] == "" and got[4]["score"] == 0.0
    assert got[3]["labels"] == "apache,gpl" and got[7]["score"] == 1.0


def test_license_paragraphs_are_known_alone(spark):
    """Every paragraph without its neighbours, plain, with a word put in every twelve, and twice in one text."""
    listed = list(licenses.TEMPLATES.items())
    rows = []
    for k, (text, _) in enumerate(listed):
        w = text.split(" ")
        wider = [x for i, y in enumerate(w) for x in ([y, "zebra"] if i % 12 == 11 else [y])]
        rows += [(3 * k, "Some words before. " + text.capitalize() + ", and some after."),
                 (3 * k + 1, " ".join(wider)), (3 * k + 2, f"{text} {'then other words ' * 9} {text}")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
           .collect()}
    for k, (text, label) in enumerate(listed):
        plain, wide, twice = (got[3 * k + j] for j in range(3))
        assert label in plain["labels"].split(",") and plain["score"] == 1.0
        assert label in wide["labels"].split(",") or len(text.split(" ")) < 20
        assert twice["labels"] == plain["labels"] and twice["n_base"] == 2 * plain["n_base"]


def test_license_spans_merge_diagonals_and_keep_copies_apart(spark):
    text = next(t for t in licenses.TEMPLATES if t.startswith("redistributions in binary"))
    w = text.split(" ")
    edited = w[:9] + ["plain", "words"] + w[9:20] + w[21:]
    df = spark.createDataFrame([(1, " ".join(edited)), (2, f"{text} {'other ' * 40} {text}")], "doc_id long, text string")
    number = len(licenses.PHRASES) + list(licenses.TEMPLATES).index(text)
    spans = sorted(tuple(r) for r in licenses.license_spans(licenses.license_hits(df)).filter(f"template = {number}")
                   .select("doc_id", "first", "last", "covered").collect())
    grams = len(w) - licenses.GRAM + 1
    # two words put in break two grams, the word left out three
    assert spans[0][0] == 1 and spans[0][1] == 0 and spans[0][3] == (grams - 5) / grams
    assert [(s[0], s[1], s[3]) for s in spans[1:]] == [(2, 0, 1.0), (2, len(w) + 40, 1.0)]


def test_license_scan_of_an_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
