import hashlib
import io
import zipfile
import zlib

import pytest

from corpusmill.llm import archives, media, warc


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read_at(self, offset, length):
        return self.data[offset : offset + length]


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_both_ways(zip64):
    z = archives.ZipBuilder(zip64)
    for i in range(5):
        z.add(f"é{i}.txt", b"x" * i * 100)
    data = b"".join(z.parts())
    with zipfile.ZipFile(io.BytesIO(data)) as other:
        assert other.testzip() is None and other.read("é3.txt") == b"x" * 300
    found = archives.directory(Bytes(data))
    assert [archives.read_member(Bytes(data), m) for m in found] == [b"x" * i * 100 for i in range(5)]


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"abc")
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"z" * 1000)
        z.writestr("packed", b"y" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    file = Bytes(out.getvalue())
    members = {m.name: m for m in archives.directory(file)}
    assert archives.read_member(file, members["big"]) == b"z" * 1000
    with pytest.raises(ValueError, match="compressed"):
        archives.read_member(file, members["packed"])
    with pytest.raises(ValueError, match="end record"):
        archives.directory(Bytes(b"nothing"))


def test_media_round_trip(spark, awkward, tmp_path):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(awkward)] + [(None, "null id", 1)], "doc_id long, text string, media int").repartition(3)
    folder = f"file://{tmp_path}/m"
    assert media.write_media(df, folder).agg({"members": "sum"}).first()[0] == len(awkward) + 1
    rows = {r["doc_id"]: r for r in media.media_features(media.read_media(spark, folder, rangeBytes=2000)).collect()}
    assert len(rows) == len(awkward) + 1
    for i, t in enumerate(awkward):
        payload = media.padded((t or "").encode())
        r = rows[i]
        assert len(payload) % 192 == 0 and len(payload) >= 192 and r["n_bytes"] == len((t or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        image = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
    assert {rows[7][c] for c in ("feature", "media_sha256")} == {rows[8][c] for c in ("feature", "media_sha256")}
    assert media.read_media(spark, f"file://{tmp_path}/none").count() == 0


def test_members_are_retried_and_reported_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}" * 50) for i in range(10)], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/m"
    media.write_media(df, folder).collect()
    (path,) = (tmp_path / "m").glob("*.zip")
    data = bytearray(path.read_bytes())
    bad = archives.directory(Bytes(bytes(data)))[4]
    data[archives.data_offset(Bytes(bytes(data)), bad) + 20] ^= 255
    path.write_bytes(data)
    rows = media.read_media(spark, folder, mode="permissive", retries=1).collect()
    assert len(rows) == 10 and [(r["doc_id"], r["media"], r["attempts"]) for r in rows if r["error"]] == [(4, None, 2)]
    with pytest.raises(Exception, match="member at"):
        media.read_media(spark, folder, retries=0).collect()


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    from corpusmill.llm.runtime import stored

    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/m"
    manifest = stored(media.write_media(df, folder), "manifest")._stored_at + "/t"
    media.write_media(df.limit(5), folder).collect()  # what a failed or speculative attempt leaves
    assert media.read_media(spark, folder).count() == 25
    assert sorted(r["doc_id"] for r in media.read_media(spark, folder, manifest=manifest, rangeBytes=300).collect()) == list(range(20))
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>") for i in range(20)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = stored(warc.write_warc(warc.deduplicated(pages), folder), "manifest")._stored_at + "/t"
    warc.write_warc(warc.deduplicated(pages), folder).collect()
    assert warc.read_warc(spark, folder).count() == 40
    assert sorted(r["page_id"] for r in warc.read_warc(spark, folder, manifest=manifest).collect()) == list(range(20))
    none = stored(warc.write_warc(warc.deduplicated(pages.limit(0)), folder), "manifest")._stored_at + "/t"
    assert warc.read_warc(spark, folder, manifest=none).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corpusmill.llm.runtime import shared_root

    conf = SimpleNamespace(get=lambda _: None)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: False))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_root(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, _jsc=jsc)))


def test_png_is_png():
    image = media.to_png(media.padded(b"hello"))
    assert bytes(media.from_png(image)) == b"hello".ljust(192)
    with pytest.raises(ValueError):
        media.from_png(image[:20] + bytes([image[20] ^ 1]) + image[21:])


PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>b</p>"), (5, "u3", "<p>a</p>"), (3, "u4\r\nx", "<p>a</p>"), (4, None, None), (6, "u", ""), (7, "u", "é" * 10_000), (8, "u", "GET\r\n\r\nx")]


@pytest.mark.parametrize("zip64", [False, True])
def test_warc(spark, tmp_path, zip64):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, refers_to int").repartition(2)
    folder = f"file://{tmp_path}/w"
    assert warc.write_warc(warc.deduplicated(df), folder, zip64).agg({"records": "sum"}).first()[0] == len(PAGES)
    rows = {r["page_id"]: r for r in warc.read_warc(spark, folder, rangeBytes=700).collect()}
    last = {}
    for page, _, html in PAGES:
        last[html or ""] = max(page, last.get(html or "", page))
    for page, _, html in PAGES:
        kept = last[html or ""]
        r = rows[page]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if kept == page else ("revisit", kept))
        assert r["payload_digest"] == warc.digest_of((html or "").encode()) and r["payload_bytes"] == len((html or "").encode())
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_ties_nulls_and_threshold(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "y"), (None, "v", "y")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["html"], r["refers_to"]) for r in warc.deduplicated(df).collect()), key=str)
    assert got == sorted([(1, "x", None), (1, "x", None), (None, "x", 1), (None, "y", None), (None, "y", None)], key=str)
    assert warc.deduplicated(df, least_bytes=2).filter("refers_to is not null").count() == 0
    assert warc.deduplicated(df.limit(0)).count() == 0


def test_only_shared_payloads_are_moved(spark):
    df = spark.createDataFrame([(i, f"u{i}", "same" if i % 5 == 0 else f"page {i}") for i in range(60)], "page_id long, url string, html string")
    out = warc.deduplicated(df)
    assert {(r["page_id"], r["refers_to"]) for r in out.collect()} == {(i, 55 if i % 5 == 0 and i != 55 else None) for i in range(60)}
    plan = warc.deduplicated(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Join LeftOuter") >= 2


def test_a_record_is_read_again(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/again"
    df = spark.createDataFrame([(1, "u", "one"), (2, "v", "two")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.deduplicated(df).coalesce(1), folder).collect()
    reader, whole = warc.WarcReader({"path": folder, "retries": "2"}), warc.SharedFile.read_at
    left = {"bad": 2}

    def flaky(self, offset, length):
        data = whole(self, offset, length)
        if data[:2] == b"\x1f\x8b" and left["bad"]:
            left["bad"] -= 1
            return data[: length // 2] + bytes(length - length // 2)
        return data

    monkeypatch.setattr(warc.SharedFile, "read_at", flaky)
    rows = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(rows) == 2 and left["bad"] == 0
    left["bad"] = 100
    with pytest.raises(ValueError, match="record at"):
        [b for p in reader.partitions() for b in reader.read(p)]
