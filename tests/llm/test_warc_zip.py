import base64
import hashlib
import io
import os
import zipfile

import pytest

from tablewright.llm.warc_zip import Archive, base32_sha1, op3_warc_zip, package, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, record_type string, _keep long"


def opened(raw):
    return Archive(lambda at, n: raw[at : at + n], len(raw))


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files_and_ranges_give_records(zip64):
    rows = [(k, f"http://x/{k} é\n", f"<p>{k}</p>\r\n\r\n".encode() * (k + 1), base32_sha1(b"x"), None if k % 3 else 7) for k in range(50)]
    (raw,) = package(iter(rows), zip64=zip64)
    raw += b"\n"
    with zipfile.ZipFile(io.BytesIO(raw)) as f:  # another reader agrees
        assert f.testzip() is None and f.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
    got = list(opened(raw).records())
    assert [g[2] for g in got] == [p if k % 3 else b"" for k, _, p, _, _ in rows]
    assert [int(g[1]["content-length"]) for g in got] == [len(p) for _, _, p, _, _ in rows]
    with zipfile.ZipFile(io.BytesIO(raw)) as f:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as g:  # without its index the member is walked
            g.writestr("archive/data.warc.gz", f.read("archive/data.warc.gz"))
    assert list(opened(out.getvalue()).records()) == got


def test_many_small_archives_and_damage():
    rows = [(k, "u", bytes([k % 256]) * 5000, "D", None) for k in range(20)]
    assert sum(len(list(opened(raw + b"\n").records())) for raw in package(iter(rows), most=100)) == 20
    with pytest.raises(ValueError):
        opened(b"not a zip file")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as g:
        g.writestr("indexes/index.cdxj", "x" * 999)
    with pytest.raises(ValueError):
        list(opened(out.getvalue()).records())


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = page if len(raw) < least or not same or page == max(same) else max(same)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_matches_brute_force(spark, tmp_path, least):
    rows = [(k, f"http://a/{k}", f"<p>{k % 40} é日本</p>") for k in range(150)] + [(500 + k, None, "<p>hot</p>") for k in range(150)]
    rows += [(900, None, None), (901, "u\r\nX: y", ""), (905, "http://x/{id} {b}?q={", "braces"), (902, "", "long " * 200_000), (903, "u", "tiny"), (904, "u", "tiny"), (904, "u", "tiny"), (None, "u", "tiny")]
    frame = spark.createDataFrame([(*r, "c", 3) for r in rows], SCHEMA).repartition(4)
    write_archives(frame, f"file://{tmp_path}/w", least_bytes=least, most=20_000)
    got = read_archives(spark, f"file://{tmp_path}/w", payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
    assert all(r.digest_ok for r in got if r.record_type == "response")
    whole = {(r.page_id, r.record_type): bytes(r.payload) for r in got}
    assert whole[902, "response"] == b"long " * 200_000
    if not least:
        frame.write.parquet(f"{tmp_path}/pages.parquet")
        assert sorted(map(tuple, op3_warc_zip(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert read_archives(spark, f"file://{tmp_path}/w").collect() == []


def test_ranges_and_whole_contents_agree(spark, tmp_path):
    rows = [(k, f"http://a/{{{k}}}", f"<p>{k % 7}</p>" * (k + 1)) for k in range(40)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w w", most=500)
    ranged = sorted(map(tuple, read_archives(spark, f"file://{tmp_path}/w w", payloads=True).collect()))
    seen = []
    (raw,) = package(iter([(1, "u", b"x" * 100_000, base32_sha1(b"x"), None)]))
    raw += b"\n"
    archive = Archive(lambda at, n: seen.append(n) or raw[at : at + n], len(raw))
    assert next(archive.records())[2] == b"x" * 100_000 and sum(seen) < 3000 + 2 * len(raw)
    # a relative path names no mounted folder, so whole archives come from Spark
    whole = read_archives(spark, os.path.relpath(f"{tmp_path}/w w"), payloads=True)
    assert sorted(map(tuple, whole.collect())) == ranged and len(ranged) == 40
