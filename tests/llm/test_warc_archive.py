import gzip
import hashlib
import json
import random
from base64 import b32encode
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.llm import warc_archive
from lexmill.llm.warc_archive import parse_archive, read_archive, write_archive

ROWS = [
    (1, "http://a/\r\nX: y", "same"), (2, "http://b/", "same"), (5, "http://c/", "same"),
    (3, None, None), (4, "http://d/", ""), (None, "http://e/", "own é"), (7, "http://f/", "x" * 300_000),
    (8, "http://g/", "twice"), (8, "http://g/", "twice"), (9, "http://h/", "WARC/1.1\r\n\r\n"),
]


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.selectExpr("*", "'k' AS key", "1 AS shard")


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, pages, tmp_path):
    folder = str(tmp_path / "archive")
    files = write_archive(pages, folder, shard_bytes=2000, roll_bytes=200).collect()
    got = read_archive(spark, folder).collect()
    other = {1: 5, 2: 5, 3: 4}
    assert sorted((r.key or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(
        (k or 0, len((h or "").encode()), digest(h), "revisit" if k in other else "response", other.get(k, 0))
        for k, _, h in ROWS
    )
    whole = {r.key: r.payload for r in got if r.record_type == "response"}
    assert whole == {k: h or "" for k, _, h in ROWS if k not in other}
    names = sorted(p.name for p in Path(folder).glob("*.warc.gz"))
    assert names == sorted(f.name for f in files) and len({f.shard for f in files}) > 2
    assert max(f.part for f in files) > 0
    manifest = json.loads((Path(folder) / "MANIFEST.json").read_text())
    assert manifest["records"] == len(ROWS) and manifest["files"] == len(files)
    ids = []
    for f in files:
        data = (Path(folder) / f.name).read_bytes()
        assert hashlib.sha1(data).hexdigest() == f.sha1 and len(data) == f.bytes
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids += [h["WARC-Record-ID"] for h, _ in parse_archive(data)]
    assert len(ids) == len(set(ids))


def test_same_files_again(spark, pages, tmp_path):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    for name, n in (("a", 1), ("b", 6)):
        spark.conf.set("spark.sql.shuffle.partitions", str(3 + n))
        write_archive(pages.repartition(n), str(tmp_path / name), shard_bytes=2000)
    spark.conf.set("spark.sql.shuffle.partitions", usual)
    first, second = (
        {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in ("a", "b")
    )
    assert first == second and len(first) > 2


@pytest.fixture
def archive(pages, tmp_path):
    folder = tmp_path / "archive"
    write_archive(pages, str(folder), shard_bytes=2000)
    return folder, sorted(folder.glob("*.warc.gz"))


def _changed(path, data):
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(data)


def test_a_lost_file_is_an_error(spark, archive, tmp_path):
    folder, files = archive
    files[0].rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match=files[0].name):
        read_archive(spark, str(folder))


def test_a_cut_file_is_an_error(spark, archive):
    folder, files = archive
    _changed(files[-1], files[-1].read_bytes()[:-7])
    with pytest.raises(ValueError, match=files[-1].name):
        read_archive(spark, str(folder))


def test_an_unnamed_file_is_an_error(spark, archive):
    folder, files = archive
    (folder / "records-99999999-0000.warc.gz").write_bytes(files[0].read_bytes())
    with pytest.raises(ValueError, match="records-99999999"):
        read_archive(spark, str(folder))


def test_a_changed_file_is_an_error(spark, archive):
    folder, files = archive
    data = bytearray(files[0].read_bytes())
    data[4] ^= 1  # the time of a gzip header, which no other check sees
    _changed(files[0], bytes(data))
    with pytest.raises(Exception, match="wrong digest"):
        read_archive(spark, str(folder)).count()


def test_a_commit_may_run_again(spark, pages, tmp_path):
    """Files that were renamed before the driver was lost are left as they are."""
    folder = str(tmp_path / "archive")
    files = write_archive(pages, folder, shard_bytes=2000)
    before = {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}
    again = files.withColumn("temporary", F.concat(F.lit("_temporary/x/"), "name"))
    warc_archive._commit(spark, again, folder)
    assert before == {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}
    assert read_archive(spark, folder).count() == len(ROWS)


def test_no_smaller_revisits_and_no_rows(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "least"), least_bytes=5)
    kinds = {r.key: r.record_type for r in read_archive(spark, str(tmp_path / "least")).collect()}
    assert set(kinds.values()) == {"response"}
    write_archive(pages.limit(0), str(tmp_path / "none"))
    assert read_archive(spark, str(tmp_path / "none")).count() == 0


def test_each_byte_is_unpacked_about_once(monkeypatch):
    rng = random.Random(1)
    blocks = [rng.randbytes(rng.choice([0, 10, 20_000, 60_000])) for _ in range(150)]
    data = b"".join(
        warc_archive._member([("WARC-Record-ID", i), ("Content-Length", len(b))], b)
        for i, b in enumerate(blocks)
    )
    given, make = [], warc_archive.zlib.decompressobj

    class Counted:
        def __init__(self, *how):
            self.own = make(*how)

        def decompress(self, piece):
            given.append(len(piece))
            return self.own.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc_archive.zlib, "decompressobj", Counted)
    assert [b for _, b in parse_archive(data)] == blocks
    assert sum(given) < 3 * len(data)
    with pytest.raises(ValueError):
        list(parse_archive(data[:-100]))
