import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from stationcare.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha int"


def _rows():
    rng = random.Random(6)
    out = [(i, f"http://h/{i}", "".join(rng.choices("abc<>é\n", k=rng.randint(1, 4000)))) for i in range(60)]
    out += [(100 + i, None, out[i % 5][2]) for i in range(20)] + [(200, "u", None), (201, "u\r\nX: 1", ""), (202, "u", None)]
    out += [(300, "u", gzip.compress(b"WARC/1.1 inside").decode("latin-1") * 20), (301, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    return out + [(None, "u", out[0][2]), (None, "u", "alone"), (59, "u", out[59][2])]


def _want(rows, least):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(i, best.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        keeper = best.get(html or "")
        again = len(raw) >= least and keeper is not None and i != keeper
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "split"), [(0, 1 << 25), (0, 700), (50, 5000)])
def test_round_trip(spark, least, split):
    rows = _rows()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES).repartition(3)
    got = warc.round_trip(df, least, split).collect()
    assert sorted((tuple(r) for r in got), key=str) == _want(rows, least)


def test_archives_keep_payloads_and_are_plain_gzip(spark):
    folder = f"{__import__('stationcare.session').session.shared_dir(spark)}/warc-plain"
    rows = _rows()[:40]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES).coalesce(2)
    warc.write_archives(warc.page_records(df), folder)
    got = {r["record_id"]: bytes(r["payload"]) for r in
           warc.read_archives(spark, folder, 900).filter(F.col("record_type") == "response").collect()}
    for i, _, html in rows:
        assert got[f"urn:page:{i}"] == html.encode()
    import os

    names = [n for n in os.listdir(folder) if n.endswith(".warc.gz")]
    raw = b"".join(gzip.open(f"{folder}/{n}").read() for n in names)
    assert raw.count(b"WARC/1.1\r\n") >= 40
    # a range that begins inside a member starts with the next one; ranges share every record exactly once
    whole = b"".join(warc.encode_record(str(k), "response", None, None, warc.base32_sha1(b"x" * k), b"x" * k)
                     for k in range(50))
    for step in (1, 17, 200, 10**6):
        seen = [r["record_id"] for a in range(0, len(whole), step)
                for r in warc.records_in(io.BytesIO(whole), a, min(a + step, len(whole)))]
        assert seen == [str(k) for k in range(50)]


def test_damage_and_noise(spark):
    good = [warc.encode_record(str(k), "response", "u", None, warc.base32_sha1(b"p%d" % k), b"p%d" % k) for k in range(3)]
    noise = b"junk\x1f\x8b\x08\x00 no member" + gzip.compress(b"not a record") + b"\x1f\x8b"
    raw = noise + good[0] + noise + good[1] + good[2][:-9]
    assert [r["record_id"] for r in warc.records_in(io.BytesIO(raw), 0, len(raw))] == ["0", "1"]
    with pytest.raises(ValueError):
        bad = warc.encode_record("0", "response", "u", None, warc.base32_sha1(b"other"), b"payload")
        list(warc.records_in(io.BytesIO(bad), 0, len(bad)))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("least", [0, 1])
def test_pages_of_a_hot_payload_spread(spark, monkeypatch, least):
    """Half of all pages are empty: same records whether copies are looked up by broadcast or by salted keys."""
    from stationcare.operators import skew

    rows = [(k, f"u{k}", None if k % 4 == 0 else "" if k % 4 == 2 else f"<p>{k // 8}</p>") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id")
    want = sorted(map(tuple, warc.page_records(pages, least).collect()), key=str)
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("left", None, None, None, 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = warc.page_records(pages, least)
        assert "_salt" in records._jdf.queryExecution().toString()
        assert sorted(map(tuple, records.collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    empty = [r for r in want if not r[5]]
    assert len(want) == 400 and len(empty) == 200
    assert sum(r[1] == "revisit" for r in empty) == (199 if least == 0 else 0)
