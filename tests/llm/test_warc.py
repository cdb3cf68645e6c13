import hashlib
import uuid

import pytest

from ampliweave.llm import warc


def brute(rows, least=1000):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p in groups[data] if p is not None), default=None)
        again = len(data) >= least and top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark, tmp_path):
    big, odd = "é" * 500, "x" * 990 + "\r\n\r\nWARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (3, None, big), (None, "n", big), (4, "a\r\nb", odd), (5, "", odd), (6, "s", "small"), (7, "s", "small"),
            (8, "e", None), (9, "e", ""), (-5, "m", "y" * 1000), (-7, "m", "y" * 1000), (None, None, "z" * 2000), (10, "l", "\r\n" * 400_000), (11, "l", "\r\n" * 400_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    got = warc.archive_pages(pages, path)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)
    texts = {r.page_id: r.payload for r in got.collect() if r.record_type == "response"}
    assert texts[5] == odd and texts[11] == "\r\n" * 400_000 and texts[3] == big
    foreign = warc.read_foreign(spark, path).collect()  # by Content-Length alone
    info = [r for r in foreign if r.type == "warcinfo"]
    assert len(info) == len(list(tmp_path.glob("*/part-*"))) and len({r.record_id for r in info}) == 1
    assert len(foreign) == len(rows) + len(info) and sum(r.type == "revisit" for r in foreign) == sum(r[3] == "revisit" for r in brute(rows))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_damage_is_told(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/a"
    archive = warc.write(warc.resolve(warc.headers(pages)), f"file://{path}", compression="none")
    assert warc.read(spark, path, archive).select("url").count() == 5
    for file in tmp_path.glob("a/part-*"):
        file.write_bytes(file.read_bytes().replace(b"page 3 page 3", b"page 3 pAge 3", 1))
    for crc in tmp_path.glob("a/.*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, path, archive).select("url").collect()
