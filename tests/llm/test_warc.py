import hashlib
import random

import pytest

from govlake.llm import warc

PAGES = "page_id bigint, url string, html string, key string, rows int"


def build():
    rng = random.Random(1)
    body = ["x" * 999, "y" * 1000, "é" * 500, "z" * 5000, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 60, "", None]
    rows = [(i, f"http://a/{i} \r\nX: y", rng.choice(body), "k", 3) for i in range(80)]
    rows += [(100 + i, None, "own %d " % i * 200, "k", 3) for i in range(20)]
    rows += [rows[3], rows[90], (None, "u", "z" * 5000, "k", 3), (None, "u", "null only" * 200, "k", 3)]
    return rows


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == data and p is not None]
        top = max(same, default=None)
        revisit = len(data) >= 1000 and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark):
    return warc.write_archive(spark.createDataFrame(build(), PAGES).repartition(4))


def test_against_brute_force(archive):
    got = warc.read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(build())


def test_payloads_are_stored_once(archive):
    stored = [bytes(r.payload) for r in archive.payloads.collect()]
    assert sorted(stored) == sorted({(r[2] or "").encode() for r in build()})


def test_records_are_put_together(archive):
    whole = [(bytes(r.header), bytes(r.payload)) for r in warc.reconstruct(archive).collect()]
    assert sorted(p for _, p in whole) == sorted((r[2] or "").encode() for r in build())
    for header, payload in whole:
        assert header.startswith(b"WARC/1.1\r\n") and header.endswith(b"\r\n\r\n") and header.count(b"\r\n\r\n") == 1
        assert b"sha1:" + hashlib.sha1(payload).hexdigest().encode() in header


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_files_round_trip(spark, archive, tmp_path, gzip):
    warc.export_warc(archive, str(tmp_path / "out"), gzip)
    read = sorted((bytes(r.header), bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path / "out")).collect())
    expected = sorted((bytes(r.header), b"" if b"WARC-Type: revisit" in bytes(r.header) else bytes(r.payload)) for r in warc.reconstruct(archive).collect())
    assert read == expected


def test_damage_is_found(spark, tmp_path):
    good = warc.write_archive(spark.createDataFrame(build()[:5], PAGES), path=str(tmp_path / "a"))
    spark.read.parquet(f"{good.path}/payloads").selectExpr("key", "concat(payload, cast('!' as binary)) as payload").write.parquet(str(tmp_path / "b/payloads"))
    good.headers.write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(warc.Archive(spark, str(tmp_path / "b"), "bigint")).collect()


def test_empty_table(spark):
    assert warc.read_records(warc.write_archive(spark.createDataFrame([], PAGES))).collect() == []


def test_ids_and_payloads_of_any_characters(spark, tmp_path):
    ids = ["a b", "a%20b", "a+b", "", "none", "<x>\r\n", "ü/é?", None]
    body = [bytes(range(256)) * (i + 1) for i in range(4)]
    rows = [(p, "u", body[i % 4]) for i, p in enumerate(ids)]
    made = warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html binary"))
    got = {r.page_id: (r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(made).collect()}
    assert got.keys() == set(ids)
    for page, _, data in rows:
        same = max(p for p, _, d in rows if d == data and p is not None)
        revisit = len(data) >= 1000 and page != same
        assert got[page] == (hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", same if revisit else None)
    warc.export_warc(made, str(tmp_path / "out"), most_records=3)
    blocks = sorted(bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / "out")).collect())
    assert blocks == sorted(d if got[p][1] == "response" else b"" for p, _, d in rows)


def test_a_wrong_length_is_found(spark, tmp_path):
    good = warc.write_archive(spark.createDataFrame(build()[:5], PAGES), path=str(tmp_path / "a"))
    good.payloads.write.parquet(str(tmp_path / "c/payloads"))
    good.headers.selectExpr("cast(replace(decode(header, 'UTF-8'), 'Content-Length: ', 'Content-Length: 9') as binary) as header", "key").write.parquet(str(tmp_path / "c/headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(warc.Archive(spark, str(tmp_path / "c"), "bigint")).collect()
