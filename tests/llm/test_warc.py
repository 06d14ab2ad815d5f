import gzip
import io

import pytest

from strandframe.llm import warc as W
from strandframe.session import scratch, stored


def test_members_and_parse():
    data = b"".join(W.record(str(i), f"http://x/{i} ü", b"p" * i * 50_000, None if i % 2 else "9") for i in range(4))
    rows = [W.parse(m) for m in W.members(io.BytesIO(data), step=7)]
    assert [r["page_id"] for r in rows] == ["0", "1", "2", "3"] and rows[3]["payload"] == b"p" * 150_000
    assert rows[2]["record_type"] == "revisit" and rows[2]["refers_to"] == "9" and rows[2]["payload_bytes"] == 100_000 and rows[2]["payload"] is None
    assert len(gzip.decompress(data)) > 200_000  # members are ordinary gzip


def test_damage_is_found():
    one = W.record("1", None, b"payload", None)
    with pytest.raises(W.WarcError, match="cut"):
        list(W.members(io.BytesIO(one[:-9])))
    plain = gzip.decompress(one)
    with pytest.raises(W.WarcError, match="digest"):
        W.parse(plain.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(W.WarcError, match="length"):
        W.parse(plain[:-1])
    for header in (b"WARC-Type: response\r\n", b"WARC-Payload-Digest", b"WARC-Record-ID"):
        with pytest.raises(W.WarcError, match="no header"):
            W.parse(plain.replace(header, b"" if header.endswith(b"\n") else b"X-Other"))
    with pytest.raises(W.WarcError, match="no number"):
        W.parse(plain.replace(b"Content-Length: 88", b"Content-Length: x") if b"Content-Length: 88" in plain else plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1))


def test_ids_that_look_like_no_id():
    for name in ("null", "", "<x>", "a b", None):
        assert W.parse(gzip.decompress(W.record(name, None, b"p", None)))["page_id"] == name
        assert W.parse(gzip.decompress(W.record("1", None, b"p", name)))["refers_to"] == name


def test_round_trip_of_odd_rows(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, None, "same"), (3, "u:/ä b", None), (None, "u", "same"), (4, "u", ""), (5, "u", "Ünï\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch(spark, "t")
    back = W.read(spark, stored(W.write(W.assigned(pages), folder, max_file_bytes=300), "m"), folder).collect()
    got = sorted((r["page_id"] or "", r["payload_bytes"], r["record_type"], r["refers_to"] or "", bytes(r["payload"] or b"").decode()) for r in back)
    assert got == sorted([("1", 4, "revisit", "2", ""), ("2", 4, "response", "", "same"), ("2", 4, "response", "", "same"), ("3", 0, "revisit", "4", ""), ("", 4, "revisit", "2", ""), ("4", 0, "response", "", ""), ("5", 81, "response", "", "Ünï\r\n\r\n" * 9)])
    empty = pages.limit(0)
    assert W.read(spark, stored(W.write(W.assigned(empty), folder + "/e"), "m"), folder).count() == 0
