"""WARC: an exact round trip through both forms of archive."""

import gzip
import hashlib
import json

from txnclean.llm import warc
from txnclean.llm.warc import _open, normalise_archives, read_records, write_archives

LONG = "<p>" + "é" * 60 + "</p>"
PAGES = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (3, "http://a/2", LONG), (None, "u", LONG),
         (7, "http://a/\r\n3", "short"), (8, "http://a/4", "short"), (10, "http://a/5", None), (11, "x", ""), (12, "x", "\r\n\r\nWARC/1.1\r\n" * 9000),
         (None, "y", "z" * 200), (None, "y", "z" * 200), (20, "h", "WARC/1.1\r\n\r\n" * 30 + "\U0001f600")]


def brute(pages):
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        same = [j for j, _, x in pages if (x or "").encode() == body and j is not None]
        first = min(same) if same and len(body) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    df = spark.createDataFrame([(i, u, h, "q") for i, u, h in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    raw = write_archives(df)
    members = normalise_archives(raw)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = read_records(members).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(brute(PAGES), key=key)
    assert {r["url"] for r in rows if r["page_id"] == 7} == {"http://a/%0D%0A3"}
    # the same bytes in both forms, and an index line for each member
    whole = lambda paths: sorted(x for p in paths for x in gzip.decompress(read(p)).split(b"\r\n\r\nWARC/1.1\r\nWARC-"))
    read = lambda p: _open(p)[0].open_input_stream(_open(p)[1], compression=None).read()
    a, b = [r["path"] for r in raw.collect()], [(r["path"], r["index"]) for r in members.collect()]
    assert len(b"".join(whole(a))) == len(b"".join(whole([p for p, _ in b])))
    for path, index in b:
        data = read(path)
        for x in map(json.loads, read(index).splitlines()):
            assert gzip.decompress(data[x["offset"]:x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_records(normalise_archives(write_archives(df))).count() == 0
