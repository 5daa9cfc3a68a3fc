import base64
import glob
import hashlib
import random

import pytest

from vicinage.llm import warc
from vicinage.storage import fresh_path, local_path

SCHEMA = "page_id long, url string, html string, payload string, last string, record_type string"


def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}\r\nX: 1%0A", "<p>" + str(rng.random()) * rng.randint(1, 40) + "é", "p", "l", "r") for i in range(60)]
    rows += [(100 + i, None, "<copy>", None, None, None) for i in range(40)]
    rows += [(200, "u", None, None, None, None), (201, "u", "", None, None, None), (None, None, "<p>no id", None, None, None), (202, "u", "x" * 400_000, None, None, None)]
    rows += [(None, None, "<copy>", None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def expected(rows):
    last = {}
    for page, _, html, *_ in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, url, html, *_ in rows:
        body = (html or "").encode()
        refers = last.get(html or "")
        refers = None if refers == page else refers
        out.append((page, url, "response" if refers is None else "revisit", refers, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, frame = pages(spark)
    index = warc.write_warc(frame, fresh_path(spark, "warc"), frame_bytes=2000, bundle_bytes=20_000)
    assert sorted((tuple(r) for r in warc.read_warc(index).collect()), key=str) == expected(rows)
    assert index.select("bundle").distinct().count() > 4 and index.agg({"frame": "max"}).first()[0] > 2


def test_records_by_their_offsets(spark):
    rows, frame = pages(spark)
    index = warc.write_warc(frame, fresh_path(spark, "warc"), frame_bytes=2000)
    wanted = spark.createDataFrame([(3,), (59,), (202,), (999,)], "page_id long")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.fetch_records(index, wanted).collect()}
    assert got == {r[0]: r[2] for r in rows if r[0] in (3, 59, 202)}


def test_bundles_are_plain_zstandard(spark):
    """Any Zstandard reader that goes over frames decodes a bundle: the seek table is skippable."""
    import zstandard

    _, frame = pages(spark)
    folder = fresh_path(spark, "warc")
    warc.write_warc(frame, folder)
    names = glob.glob(local_path(folder) + "/*.warc.zst")
    text = b""
    for name in names:
        with open(name, "rb") as f:
            text += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 105


def test_small_payloads_can_stay_responses(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "long"), (4, "long")], "page_id long, html string")
    got = warc.read_warc(warc.write_warc(frame, fresh_path(spark, "warc"), min_bytes=2))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty_table(spark):
    index = warc.write_warc(spark.createDataFrame([], SCHEMA), fresh_path(spark, "warc"))
    assert index.collect() == [] and warc.read_warc(index).collect() == []


def test_damage_is_found():
    record = bytearray(warc.make_record(1, "u", b"payload", None))
    record[record.index(b"payload")] ^= 1
    with pytest.raises(ValueError):
        warc.read_record(bytes(record))
