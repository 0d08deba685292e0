import gzip
import random
import zlib

import pytest

from recsim.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first int")


def test_round_trip_of_odd_rows(spark, tmp_path):
    big = "x<p>ä</p>" * 200_000
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (7, "u\n7", big), (5, "u5", big), (None, "n", "same"),
            (9, "u9", "\r\n\r\nWARC/1.1\r\n\r\n"), (-5, "neg", "only"), (1 << 62, "far", "same"), (1, "u1", "same")]
    df = pages(spark, [(*r, "clash", 3) for r in rows])
    path = str(tmp_path / "w")
    warc.write_warc(df, path, records_per_file=3)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.refers_to is None) == [
        (-5, "response", None), (1, "response", None), (1, "response", None), (3, "response", None), (5, "response", None),
        (9, "response", None)]
    assert {r.page_id: r.refers_to for r in got if r.refers_to is not None} == {2: 1, 4: 3, 7: 5, 1 << 62: 1}
    text = {i: t or "" for i, _, t in rows}
    for r in got:
        data = text[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == warc.base32_sha1(data)
        assert r.payload == (data if r.record_type == "response" else None)


def test_short_payloads_are_all_responses(spark, tmp_path):
    df = pages(spark, [(1, "a", "xx", "", 0), (2, "b", "xx", "", 0), (3, "c", "long enough", "", 0), (4, "d", "long enough", "", 0)])
    warc.write_warc(df, str(tmp_path / "w"), min_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {
        1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_files_are_plain_gzip_streams(spark, tmp_path):
    warc.write_warc(pages(spark, [(i, "u", f"p{i}", "", 0) for i in range(20)]), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 20


def test_reader_frames_and_verifies():
    records = [warc.make_record(i, "u", b"payload %d" % i, None) for i in range(3)]
    stream = b"".join(warc.member(r) + warc.EMPTY_MEMBER for r in records)
    for step in (1, 7, 1 << 16):
        assert list(warc.members(stream, step)) == records
    assert warc.parse_record(records[1])["payload"] == b"payload 1"
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[1].replace(b"payload 1", b"payload 2"))
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[1][:-5])
    with pytest.raises(warc.WarcError):
        list(warc.members(stream[:-30]))
    with pytest.raises(zlib.error):
        list(warc.members(b"not gzip"))


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "u", "".join(map(chr, rng.choices(range(33, 1000), k=100_000 if i % 10 else 3_000_000))), "", 0) for i in range(20)]
    warc.write_warc(pages(spark, rows).coalesce(2), str(tmp_path / "w"), bytes_per_file=1 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 4 and sorted(sizes)[-3] < 1 << 20 < sorted(sizes)[-2]
    got = {r.page_id: r.payload for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {r[0]: r[2].encode() for r in rows}


def test_reader_works_in_any_steps():
    records = [warc.make_record(i, "u", b"\r\n\r\n" * i + b"x" * 5_000_000 * (i == 2), 1 if i == 3 else None) for i in range(5)]
    stream = b"".join(warc.member(r) + warc.EMPTY_MEMBER for r in records)
    want = [warc.parse_record(r) for r in records]
    for step in (1, 5, 1 << 16):
        assert list(warc.read_records(stream, True, step)) == want
    bare = list(warc.read_records(stream, False))
    assert [{**r, "payload": None} for r in want] == bare
    with pytest.raises(warc.WarcError):
        list(warc.read_records(stream[:-30]))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(warc.member(b"HTTP/1.1 200 OK\r\n\r\n")))


@pytest.mark.parametrize("n", [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 62])
def test_record_ids_hold_the_page(n):
    assert warc.page_of(f"<urn:uuid:{warc.record_uuid(n)}>") == n
