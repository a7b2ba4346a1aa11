import glob
import hashlib
import random

import pytest
import zstandard

from tessella.llm import queries, warc
from tests.llm.conftest import same_as_sql

PAGES = "page_id long, url string, html string, digest string, n int"


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        first = min((j for j in same if j is not None), default=None)
        later = len(data) >= least and first is not None and i != first
        out.append((i, len(data), warc.digest_of(data), "revisit" if later else "response", first if later else None))
    return sorted(out, key=str)


def test_query_equals_sql(spark, sf):
    same_as_sql(spark, sf, "op9_warc")


@pytest.mark.parametrize("least", [0, 10])
def test_odd_rows_equal_brute_force(spark, tmp_path, least):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [
        (5, "http://a/1", "<p>one</p>"), (3, "http://a/2 x\r\nWARC-Type: warcinfo", "<p>one</p>"), (9, None, None), (8, "http://b", ""), (None, "http://c", "<p>one</p>"),
        (None, "http://d", "only nulls"), (3, "http://a/2", "<p>one</p>"), (11, "http://é/ ", "é\U0001f600\r\n\r\nWARC/1.1\r\n"), (12, "http://x", big), (13, "http://y", big), (14, "u", "tiny"), (15, "u", "tiny"),
    ]
    rows += [(100 + k, f"http://h/{k}", f"<html><body><p>page {k} of many</p></body></html>" * 4) for k in range(60)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    got = warc.round_trip(pages, least).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, least)

    folder = f"file://{tmp_path}/out"
    warc.archive(pages, folder, least)
    back = warc.read_archives(spark, folder).collect()
    html = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    for r in back:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() and (r.page_id is None or bytes(r.payload) == html[r.page_id])
        else:
            assert r.payload is None
    assert {r.url for r in back if r.page_id == 11} == {"http://é/ "}
    files = glob.glob(f"{tmp_path}/out/part-*.warc.zst")
    assert files and not glob.glob(f"{tmp_path}/out/part-*.txt")
    for f in files:  # dictionary first, then frames that any decoder with that dictionary reads one by one
        data = open(f, "rb").read()
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        one = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(data[8 + size + 8 :])
        assert one.startswith(b"WARC/1.1\r\n")


def records_of(folder):
    """[(WARC-Type, WARC-Record-ID, WARC-Refers-To)] of each file."""
    out = []
    for f in sorted(glob.glob(f"{folder}/part-*.warc.zst")):
        heads = [dict(x.split(": ", 1) for x in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for raw in warc.frames(open(f, "rb").read())]
        out.append([(h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To")) for h in heads])
    return out


@pytest.mark.parametrize("file_bytes", [200, 3000, 1 << 30])
def test_many_files_a_task(spark, tmp_path, file_bytes):
    """Files roll by our count of records, whatever the session asks for; ids are unique."""
    html = lambda k: f"<html><body><p>page {k % 70} of many</p></body></html>"
    rows = [(k, f"http://h/{k}", html(k)) for k in range(150)] + [(3, "http://h/3", html(3)), (3, "http://h/3", html(3)), (90, "u", html(90)), (None, "n", html(1)), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == plain(rows)
        warc.archive(pages, f"file://{tmp_path}/out", file_bytes=file_bytes)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = records_of(f"{tmp_path}/out")
    assert all([k for k, r in enumerate(f) if r[0] == "warcinfo"] == [0] for f in got)
    assert len(got) > (30 if file_bytes == 200 else 2 if file_bytes == 3000 else 0)
    every = [r for f in got for r in f if r[0] != "warcinfo"]
    assert len(every) == len(rows) and len({r[1] for r in every}) == len(rows)
    responses = {r[1].split("#")[0].rstrip(">") for r in every if r[0] == "response"}
    assert all(r[2].rstrip(">") in responses for r in every if r[0] == "revisit")
    assert sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/out", ["page_id", "record_type"]).collect()), key=str) == sorted(((r[0], r[3]) for r in plain(rows)), key=str)


def test_nothing_is_left_when_reading_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "scratch_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(warc, "read_archives", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        warc.round_trip(spark.createDataFrame([(1, "u", "x", "", 0)], PAGES))
    assert not glob.glob(f"{tmp_path}/shared/warc-*")


def test_few_and_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    one = warc.round_trip(spark.createDataFrame([(1, "u", "x", "", 0)], PAGES)).collect()
    assert [tuple(r) for r in one] == [(1, 1, warc.digest_of(b"x"), "response", None)]


def test_a_damaged_archive_is_refused():
    raw = warc.record(1, "u", b"abc", None, False)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.frames(zstandard.ZstdCompressor().compress(raw)[:-3]))
