import hashlib
import re

from pyspark.sql import functions as F

from stationcare.llm.fill_middle import fill_in_middle, restored

CASES = [(1, "a\nb\nc\n"), (2, "no line end"), (3, "\n"), (4, "\n\n\nx"), (5, "a <P> b\nc"), (6, "<S>"), (7, "x\n<M>\n"),
         (8, "<P\n>\n<S\n<\n>"), (9, "<<\nS>\n<M\n"), (10, "\r\n\r\n ä\n日本\n語"), (10, "\r\n\r\n ä\n日本\n語"), (10, "other"),
         (None, "q\nr\ns\nt"), (None, None), (-5, "minus\nfive\n"), (11, "line\n" * 30_000), (12, "é" * 70_000 + "\n")]


def plain_version(doc, text, rate=100, spm_share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    if h4 % 100 < spm_share:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                 "doc_id long, text string, form string, h1 int, output string").repartition(3)


def test_arranged_texts_equal_the_plain_version(spark, rows):
    everything = [*CASES, *rows]
    got = [tuple(r) for r in fill_in_middle(table(spark, everything)).collect()]
    want = [plain_version(*r) for r in everything]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(spark, rows):
    everything = [*CASES, *rows]
    made = fill_in_middle(table(spark, everything))
    back = made.select("doc_id", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in everything), key=str)


def test_shares_are_parameters(spark, rows):
    got = {tuple(r) for r in fill_in_middle(table(spark, rows), rate=50, spm_share=0).collect()}
    assert got == {plain_version(*r, rate=50, spm_share=0) for r in rows}
    assert {r[2] for r in got} == {"plain", "psm"}


def test_empty_table(spark):
    assert fill_in_middle(table(spark, CASES).limit(0)).collect() == []
