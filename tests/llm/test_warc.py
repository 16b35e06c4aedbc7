import hashlib
import zlib
from io import BytesIO

import pytest

from stopwise.llm import warc as m

PAGES = "page_id long, url string, html string, digest string, refers_to string"


def run(spark, folder, rows):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    archives = m.write_archives(m.decide(pages), f"file://{folder}")
    archives.cache()
    return m.read_archives(archives, f"file://{folder}")


def test_round_trip_with_revisits(spark, folder):
    long = "ä" * 600
    rows = [
        (1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, long), (4, "u", "short"),
        (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "line\r\n\r\nline"), (7, "u", "line\r\n\r\nline"),
        (8, "u", "z" * 3_000_000),
    ]
    got = m.digest_records(run(spark, folder, rows)).collect()
    found = sorted([tuple(r) for r in got], key=str)
    expected = []
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = html == long and i != 3
        expected.append((i, len(payload), hashlib.sha1(payload).hexdigest(),
                         "revisit" if revisit else "response", 3 if revisit else None))
    assert found == sorted(expected, key=str)


def test_each_record_is_a_gzip_member_and_html_comes_back(spark, folder):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(50)]
    got = run(spark, folder, rows).collect()
    assert {int(r.record_id.split(":")[-1]): r.payload.decode() for r in got} == {i: h for i, _, h in rows}
    assert {r.target_uri for r in got} == {u for _, u, _ in rows}


def test_damage_is_noticed():
    whole = m.record("response", "urn:page:1", "u", b"payload", None, hashlib.sha1(b"payload").hexdigest())
    assert m.parse(next(m.members(BytesIO(whole * 2))))[1] == b"payload"
    assert len(list(m.members(BytesIO(whole * 3)))) == 3
    plain = zlib.decompress(whole, 31)
    with pytest.raises(ValueError, match="digest"):
        m.parse(plain.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))
    with pytest.raises(ValueError, match="length"):
        m.parse(plain[:-6])
    with pytest.raises(ValueError, match="inside"):
        list(m.members(BytesIO(whole[:-5])))


def test_empty_table(spark, folder):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = m.write_archives(m.decide(pages), f"file://{folder}")
    assert m.digest_records(m.read_archives(archives, f"file://{folder}")).collect() == []
