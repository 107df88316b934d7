"""WARC archives: a deterministic sharded writer and its reader.

Records are put in a total order by key; running totals of payload bytes cut that order into
shards of about ``shard_bytes``, so what is in a shard depends on the records alone. A task
writes a whole shard, record by record as gzip members, and rolls to another file when the
compressed size reaches ``roll_bytes``. Headers and digests are made anew from the payloads.

Commit: every attempt of a task writes under its own temporary names and returns a row per
file; Spark's own commit keeps one attempt's rows. Those files are renamed to their final
names by tasks that may safely run again, the manifest gets a line per file with its name,
records, bytes and digest, and last the totals get their final name: an archive without them
isn't finished. A task that is lost leaves only temporary names. Reading compares the files with
the manifest and fails if one is missing, cut, changed or not named by it.

Of records with equal payloads that with the largest key is the response, others revisit it.

Defined cases: a null payload is empty; a null key sorts first, counts as the smallest and
reads back as null; rows repeated with the largest key are all responses, and further records
of one key get numbered ids; line breaks in addresses are percent-encoded; an empty table
gives a manifest without files and reads back empty; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.mixing import running_totals
from lexmill.session import broadcast_if_small, written

MANIFEST = "MANIFEST.json"
FILES = "MANIFEST.files.json"
# payload, not compressed, that goes to one task
SHARD_BYTES = 64 << 20
# bytes of a file that are unpacked at once
_PIECE = 1 << 14
_LINE = "name string, records long, bytes long, sha1 string"
_FILES = "name string, temporary string, shard long, part int, records long, bytes long, sha1 string"
_RECORDS = (
    "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "uri string, payload string"
)
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:record")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{key}/{number}')}>"


def _clean(uri: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri or "")


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    body = packer.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n")
    return body + packer.flush()


def _record(key, number, uri, payload: bytes, refers_to, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(key, number)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("X-Payload-Length", len(payload)),
    ]
    if key is not None:
        headers.append(("X-Record-Key", key))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to)),
            ("X-Refers-To-Key", refers_to),
        ]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _member(headers, block)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Roller:
    """Writes the records of one shard at a time under temporary names."""

    def __init__(self, folder: str, roll_bytes: int, date: str) -> None:
        self.fs, self.base = _store(folder)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        self.temporary = f"_temporary/{attempt}"
        self.fs.create_dir(f"{self.base}/{self.temporary}", recursive=True)
        self.roll_bytes, self.date = roll_bytes, date
        self.out, self.rows = None, []

    def put(self, shard: int, member: bytes) -> None:
        if self.out is None or shard != self.shard or self.size >= self.roll_bytes:
            part = self.part + 1 if self.out is not None and shard == self.shard else 0
            self.close()
            self.shard, self.part, self.size, self.records = shard, part, 0, 0
            self.name = f"records-{shard:08d}-{part:04d}.warc.gz"
            self.sha1 = hashlib.sha1()
            self.out = self.fs.open_output_stream(
                f"{self.base}/{self.temporary}/{self.name}", compression=None
            )
            info = f"software: lexmill\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\n".encode()
            headers = [
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, f"info/{self.name}")),
                ("WARC-Date", self.date), ("WARC-Filename", self.name),
                ("Content-Type", "application/warc-fields"), ("Content-Length", len(info)),
            ]
            self._write(_member(headers, info))
        self.records += 1
        self._write(member)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append(
                (self.name, f"{self.temporary}/{self.name}", self.shard, self.part, self.records,
                 self.size, self.sha1.hexdigest())
            )
            self.out = None

    def done(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Distinct ``key, sha1`` of the records that revisit another, and ``refers_to``.

    Copies are counted map-side, so a payload that makes up a third of all records sends one
    row per task to its group; the join back may split it.
    """
    narrow = records.select(
        "key", F.sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").alias("bytes")
    ).filter(F.col("bytes") >= least_bytes)
    groups = (
        narrow.groupBy("sha1")
        .agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and refers_to is not null")
        .drop("n")
    )
    return (
        narrow.drop("bytes")
        .join(groups, "sha1")
        .filter("key is null or key != refers_to")
        .distinct()
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = 128 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` to a new ``folder``; returns the manifest: a row per file.

    ``shard_bytes`` of payload, not compressed, go to one task; there are as many tasks as shards.
    """
    spark = pages.sparkSession
    records = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(uri).alias("uri"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    )
    sizes = written(
        records.select(
            "key", F.sha1(F.col("payload")).alias("sha1"),
            (F.octet_length("payload") + 512).cast("long").alias("bytes"),
        ),
        "sizes",
    )
    order = [F.col("key").asc_nulls_first(), F.col("sha1")]
    starts = (
        running_totals(sizes, order, {"upto": "bytes"})
        .groupBy(F.floor((F.col("upto") - F.col("bytes")) / shard_bytes).alias("shard"))
        .agg(F.min(F.struct("key", "sha1")).alias("least"))
        .select("least.*")
        .collect()
    )
    # a row per shard; equal rows stay in one shard
    first = sorted((r["key"] is not None, r["key"] or 0, r["sha1"]) for r in starts)
    first = spark.sparkContext.broadcast(first)

    @F.arrow_udf("long")
    def shard_of(keys: pa.Array, digests: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array(
            [bisect_right(first.value, (k is not None, k or 0, d)) - 1 for k, d in rows], pa.int64()
        )

    # a mark before the records that revisit another spares a join of the payloads
    marks = revisits(records, least_bytes).select(
        "key", "sha1", "refers_to", F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("string").alias("payload"),
    )
    ready = (
        records.withColumn("sha1", F.sha1(F.col("payload")))
        .withColumn("refers_to", F.lit(None).cast("long"))
        .unionByName(marks)
        .withColumn("shard", shard_of("key", "sha1"))
        .repartitionById(max(1, len(first.value)), F.col("shard").cast("int"))
        .sortWithinPartitions(
            "shard", F.col("key").asc_nulls_first(), "sha1", F.col("payload").isNotNull(), "uri"
        )
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, number, marked, target = None, object(), 0, None, None
        schema = pa.schema(
            [("name", pa.string()), ("temporary", pa.string()), ("shard", pa.int64()),
             ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
             ("sha1", pa.string())]
        )
        for batch in batches:
            roller = roller or _Roller(folder, roll_bytes, date)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in
                       ("shard", "key", "uri", "payload", "refers_to", "sha1")]
            for i in range(batch.num_rows):
                shard, k, address, text, other, digest = (c[i].as_py() for c in columns)
                if text is None:
                    marked, target = (k, digest), other
                    continue
                number = number + 1 if k == last else 0
                last = k
                other = target if marked == (k, digest) else None
                roller.put(shard, _record(k, number, address, text.encode(), other, date))
        if roller is not None:
            roller.close()
            rows = roller.done()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                    schema=schema,
                )

    files = written(ready.mapInArrow(write, _FILES), "files")
    _commit(spark, files, folder)
    return files.drop("temporary")


def _commit(spark: SparkSession, files: DataFrame, folder: str) -> None:
    """Rename the files of the manifest, then the manifest itself."""

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fs, base = _store(folder)
            for row in frame.itertuples():
                there = fs.get_file_info(f"{base}/{row.temporary}")
                if there.type == pafs.FileType.File:
                    fs.move(f"{base}/{row.temporary}", f"{base}/{row.name}")
                size = fs.get_file_info(f"{base}/{row.name}").size
                if size != row.bytes:
                    raise OSError(f"{row.name} has {size} bytes, not {row.bytes}")
            yield frame[["name"]]

    renamed = files.mapInPandas(rename, "name string").count()
    fs, base = _store(folder)
    fs.create_dir(base, recursive=True)
    totals = {"files": 0, "records": 0, "bytes": 0}
    # a line per file, from one partition at a time
    with fs.open_output_stream(f"{base}/_{FILES}") as out:
        for r in files.select("name", "records", "bytes", "sha1").toLocalIterator():
            out.write(json.dumps(r.asDict()).encode() + b"\n")
            totals["files"] += 1
            totals["records"] += r["records"]
            totals["bytes"] += r["bytes"]
    if renamed != totals["files"]:
        raise OSError(f"{renamed} files renamed, not {totals['files']}")
    fs.move(f"{base}/_{FILES}", f"{base}/{FILES}")
    with fs.open_output_stream(f"{base}/_{MANIFEST}") as out:
        out.write(json.dumps(totals).encode())
    fs.move(f"{base}/_{MANIFEST}", f"{base}/{MANIFEST}")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a file of gzip members."""
    data, at = memoryview(data), 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        # what is given beyond a member's end is copied: never the rest of the file
        while at < len(data) and not unpacker.eof:
            parts.append(unpacker.decompress(data[at : at + _PIECE]))
            at += min(_PIECE, len(data) - at)
        at -= len(unpacker.unused_data)
        record = b"".join(parts) + unpacker.flush()
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong length")
        yield headers, rest[:length]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row per response or revisit: ``key, payload_bytes, payload_digest, record_type,
    refers_to, uri, payload`` (null for revisits). Files, records and digests are checked against
    the manifest; a difference is an error, for files that are missing, of another size or not
    named at once, for others when they are read."""
    fs, base = _store(folder)
    with fs.open_input_stream(f"{base}/{MANIFEST}") as manifest:
        expected = json.loads(manifest.read())
    if not expected["files"]:
        return spark.createDataFrame([], _RECORDS)
    lines = spark.read.schema(_LINE).json(f"{folder}/{FILES}")
    found = lines.agg(
        F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"),
        F.sum("bytes").alias("bytes"),
    ).first()
    if found.asDict() != expected:
        raise ValueError(f"the manifest of {folder} names {found.asDict()}, not {expected}")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc.gz")
        .load(folder)
        .withColumn("name", F.substring_index("path", "/", -1))
    )
    there = files.select("name", F.col("length").alias("there"))
    torn = lines.join(there, "name", "full_outer").filter(~F.col("bytes").eqNullSafe(F.col("there")))
    wrong = torn.orderBy("name").limit(20).collect()
    if wrong:
        text = ", ".join(f"{r['name']} ({r['there']} bytes, not {r['bytes']})" for r in wrong)
        raise ValueError(f"the archive {folder} differs from its manifest: {text}")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                name, content, rows, records = row.name, row.content, [], 0
                if hashlib.sha1(content).hexdigest() != row.sha1:
                    raise ValueError(f"{name} has a wrong digest")
                for headers, block in parse_archive(content):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    records += 1
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block) or (
                        kind == "response" and digest != base32_sha1(payload)
                    ):
                        raise ValueError(f"{name}: {headers['WARC-Record-ID']} has a wrong digest")
                    key, other = headers.get("X-Record-Key"), headers.get("X-Refers-To-Key")
                    rows.append(
                        (key and int(key), int(headers["X-Payload-Length"]), digest, kind,
                         other and int(other), headers["WARC-Target-URI"],
                         payload.decode() if kind == "response" else None)
                    )
                    if len(rows) == 500:
                        yield _frame(rows)
                        rows = []
                if records != row.records:
                    raise ValueError(f"{name} has {records} records, not {row.records}")
                yield _frame(rows)

    named = files.join(broadcast_if_small(lines.drop("bytes")), "name")
    return named.select("name", "content", "records", "sha1").mapInPandas(read, _RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _RECORDS.split(", ")], dtype="object")
    return frame.astype({"key": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
