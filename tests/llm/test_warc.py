import io

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import warc as W

PAGES = [(i, f"http://a.example/{i}?q=\n{i}", f"<html><title>{i % 7}</title>" + "<p>some body text that repeats</p>" * (i % 7 + 3) + "</html>") for i in range(60)]
PAGES += [(100, None, None), (101, "http://b", ""), (102, "no scheme", "é" * 100_000), (None, "http://c", "alone"), (103, "http://d", "twice"), (103, "http://d", "twice")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit(1), "first": F.lit(2), "path": F.lit("p")})


def test_round_trip(pages):
    manifest = W.write_archives(pages, archive_bytes=8_000)
    assert manifest.count() > 1
    rows = W.read_archives(manifest, payloads=True).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            key = (html or "").encode()
            first[key] = min(first.get(key, page), page)
    texts = {page: (html or "").encode() for page, _, html in PAGES}
    for r in rows:
        payload = texts[r.page_id]
        revisit = r.page_id is not None and first[payload] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), W.payload_digest(payload))
        assert (r.record_type, r.refers_to) == (("revisit", first[payload]) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else payload)


def test_small_payloads_are_no_revisits(pages):
    rows = W.read_archives(W.write_archives(pages, min_bytes=1)).where("page_id IN (100, 101)").collect()
    assert {r.record_type for r in rows} == {"response"}


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    records = [W.record(i, f"http://x/{i}", (f"<html>{i}" + "common words of many pages " * 40).encode(), "D") for i in range(3000)]
    raw = b"".join(W.archive(records))
    assert int.from_bytes(raw[:4], "little") == W.DICTIONARY_MAGIC
    assert list(W.frames(io.BytesIO(raw), read_bytes=1000)) == records
    one = zstandard.ZstdCompressor(level=3)
    assert len(raw) < sum(len(one.compress(r)) for r in records)
    for n in (1, 2, 3, 16, 40):
        few = b"".join(W.archive(records[:n]))
        assert int.from_bytes(few[:4], "little") == W.DICTIONARY_MAGIC
        assert list(W.frames(io.BytesIO(few))) == records[:n]


def test_written_files_are_frames_of_single_records(pages):
    manifest = W.write_archives(pages, archive_bytes=8_000)
    rows = {}
    for r in W.read_archives(manifest, payloads=True).collect():
        rows.setdefault(r.path, []).append(r)
    found = manifest.collect()
    assert {m.path for m in found} == set(rows) and len(rows) > 1
    for m in found:
        with open(m.path.removeprefix("file://"), "rb") as file:  # as the bytes are, without a library that looks at names
            raw = file.read()
        assert len(raw) == m.n_bytes
        assert int.from_bytes(raw[:4], "little") == W.DICTIONARY_MAGIC
        size = int.from_bytes(raw[4:8], "little")
        held = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size], max_output_size=1 << 20)
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        own = sorted(rows[m.path], key=lambda r: r.offset)
        assert len(own) == m.n_records and own[0].offset == 8 + size
        assert [r.offset + r.length for r in own] == [*(r.offset for r in own[1:]), len(raw)]
        for r in own:
            assert raw[r.offset : r.offset + 4] == b"\x28\xb5\x2f\xfd"
            one = opener.decompress(raw[r.offset : r.offset + r.length])
            assert one == W.read_record(r.path, r.offset, r.length)
            assert W.parsed(one)[1] == bytes(r.payload) and f"WARC-Record-ID: {r.record_id}\r\n".encode() in one


def test_ids_are_unique_and_revisits_name_a_response(pages):
    rows = W.read_archives(W.write_archives(pages.unionByName(pages.where("page_id < 9")), archive_bytes=8_000)).collect()
    assert len({r.record_id for r in rows}) == len(rows)
    by = {r.record_id: r for r in rows}
    raws = {r.record_id: W.parsed(W.read_record(r.path, r.offset, r.length))[0] for r in rows if r.record_type == "revisit"}
    named = {k: h["warc-refers-to"] for k, h in raws.items() if "warc-refers-to" in h}
    assert named and all(by[v].record_type == "response" and by[v].page_id == by[k].refers_to for k, v in named.items())
    assert all(not h["warc-date"].startswith("1970") for h in raws.values())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_repeated_payloads_broadcast_or_not(pages, monkeypatch, limit):
    monkeypatch.setattr(W, "MAX_REPEATED", limit)
    rows = W.with_revisits(pages).collect()
    assert len(rows) == len(PAGES) and {r.first for r in rows if r.page_id in (100, 101)} == {100}


def test_damage_is_found():
    records = [W.record(i, None, b"payload", "D") for i in range(3)]
    raw = b"".join(W.archive(records))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(W.frames(io.BytesIO(raw[:-4])))


def test_no_pages(pages):
    manifest = W.write_archives(pages.limit(0))
    assert manifest.count() == 0 and W.read_archives(manifest).count() == 0


def test_ids_that_are_strings(spark):
    given = [("a\r\nb: c", "x"), ("é %41", "x"), ("", "y")]
    rows = W.read_archives(W.write_archives(spark.createDataFrame([(i, None, t) for i, t in given], "page_id string, url string, html string")), W.T.StringType(), payloads=True).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [("", "response", None), ("a\r\nb: c", "response", None), ("é %41", "revisit", "a\r\nb: c")]
