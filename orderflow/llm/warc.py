"""Deterministic sharded WARC archives: written in order of page_id, rolled by compressed size, read back.

Shards are stretches of the order of ``page_id`` and payload digest with about equal payload, cut where the exact running
total passes a multiple of the shard size, so the same pages always give the same files, and neither ids that lie far apart nor
an id that many pages share make a shard large. A task sorts its shard, writes records of one gzip member each, and starts a new file
when the compressed size is reached. Files get temporary names; the manifest of the attempts that succeeded is
stored first, and only the files it names are moved to their final names.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from orderflow.llm._shared import drop_written, scratch_path, table, text_slices, written

SHARD_BYTES = 64 << 20  # of payload
ROLL_BYTES = 32 << 20  # of compressed file
LEAST_REVISIT = 100  # bytes; smaller payloads are always written in full
RECORD_BYTES = 512  # what a record weighs beside its payload
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "name string, temporary string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    out = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(out) + pack.flush()


def _uri(url: str | None) -> str:
    """A URL fit for a header line: blanks and control characters are percent-encoded; none at all is about:blank."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def _name(page_id: int | None, digest: bytes, k: int) -> str:
    """The id of the ``k``-th record of a page id with a payload; no two records share one."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest.hex()[:32]}:{k}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, k: int, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record: the whole response, or the headers of a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id, digest, k)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest.hex()}"),
        ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to, digest, 0))]
    return _record(headers, block)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and its path there; the names that Hadoop has for object stores are known too."""
    for hadoop, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("wasb://", "abfs://")):
        path = own + path.removeprefix(hadoop) if path.startswith(hadoop) else path
    return fs.FileSystem.from_uri(path)


class _Roller:
    """Files of one shard under temporary names; ``done`` are their manifest rows."""

    def __init__(self, out: str, roll_bytes: int):
        self.fs, self.root = _store(out)
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.roll_bytes, self.shard, self.seq, self.file, self.done = roll_bytes, None, 0, None, []

    def write(self, shard: int, page_id: int | None, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.file is None:
            name = f"pages-{shard:06d}-{self.seq:05d}.warc.gz"
            temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
            self.file, self.hash = self.fs.open_output_stream(f"{self.root}/{temporary}"), sha256()
            self.row = {"name": name, "temporary": temporary, "shard": shard, "records": 0, "bytes": 0, "first_id": page_id}
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.row["records"] += 1
        self.row["last_id"] = page_id
        if self.row["bytes"] >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.hash.update(data)
        self.row["bytes"] += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append(self.row | {"sha256": self.hash.hexdigest()})
            self.file, self.seq = None, self.seq + 1


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _write_shards(out: str, roll_bytes: int):
    def run(batches):
        files, at, firsts, seen = _Roller(out, roll_bytes), object(), {}, Counter()
        for whole in batches:
            for batch in text_slices(whole, "html"):
                for row in batch.to_pylist():
                    if (row["shard"], row["page_id"]) != at:
                        at, firsts, seen = (row["shard"], row["page_id"]), {}, Counter()
                    page_id, digest = row["page_id"], row["digest"]
                    if row["kind"] == 0:
                        firsts[digest] = row["first_id"]
                        continue
                    first, k = firsts.get(digest), seen[digest]
                    revisit = first is not None and (first != page_id or k > 0)
                    seen[digest] += 1
                    files.write(row["shard"], page_id, page_record(page_id, row["url"], (row["html"] or "").encode(), digest, k, first, revisit))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist(files.done, _schema(MANIFEST))

    return run


def _commit(out: str):
    def run(batches):
        store, root = _store(out)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if store.get_file_info(source).type == fs.FileType.File:  # else an earlier attempt moved it
                    store.move(source, target)
                elif store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{row['name']} is missing or has another size than the manifest says")
            yield batch

    return run


def _place(page_id: Column, digest: Column) -> tuple[Column, Column]:
    """Two longs whose order is that of shards: by id, null first, then by the begin of the digest."""
    near = F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")
    return F.coalesce(page_id, F.lit(-(1 << 63))).alias("id"), near.alias("near")


def _begins(sizes: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Where each shard begins, in order: a pair of longs for ``shard_bytes`` of payload.

    The running total is exact: totals of ranges first, one number each, then sums within each range.
    """
    each = sizes.groupBy("id", "near").agg(F.sum("weight").alias("weight"))
    ranged = written(each.repartitionByRange("id", "near").withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("weight").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy("range").agg(F.sum("weight").alias("weight"), F.min(F.struct("id", "near")).alias("first"))
    starts = totals.select("range", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each range
    own = Window.partitionBy("range").orderBy("id", "near").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.join(F.broadcast(starts), "range").withColumn("total", F.col("start") + F.coalesce(F.sum("weight").over(own), F.lit(0)))
    shards = running.groupBy(F.floor(F.col("total") / shard_bytes).alias("shard")).agg(F.min(F.struct("id", "near")).alias("b"))
    begins = [(r.b.id, r.b.near) for r in shards.orderBy("shard").collect()]
    drop_written(ranged)
    return begins


def _shard_of(begins: list[tuple[int, int]]):
    """A function of two long columns: the number of the shard, by its begin."""
    ids, nears = (np.array(x, np.int64) for x in (zip(*begins, strict=True) if begins else ((), ())))

    @F.arrow_udf(IntegerType())
    def shard(id_: pa.Array, near: pa.Array) -> pa.Array:
        own, rest = (x.to_numpy(zero_copy_only=False) for x in (id_, near))
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        out = low - 1
        for i in np.flatnonzero(high > low):  # an id that shards begin within
            out[i] = low[i] + np.searchsorted(nears[low[i] : high[i]], rest[i], "right") - 1
        return pa.array(np.maximum(out, 0), pa.int32())

    return shard


def write_archives(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """One record per row of ``pages`` into ``out``, a new folder that all executors see; returns the manifest.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of 100 bytes or more,
    that with the smallest page_id is a response and the others revisit it (of repeats of that very row, all
    but one). A row without an id revisits an equal page that has one, and else is a response.
    Files and manifest depend on the pages alone. No pages give no files. Extra columns are not read.

    ``out`` may be a path of any file system that pyarrow knows, by Hadoop's name too.
    """
    html, page_id = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("page_id").cast("long")
    digest = F.unhex(F.sha2(html, 256))
    sizes = written(pages.select(page_id.alias("page_id"), F.octet_length(html).alias("size"), digest.alias("digest")), "payloads")
    large = sizes.where(F.col("size") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    roles = large.join(firsts, "digest").select("page_id", "digest", "first_id").distinct()
    placed = sizes.select(*_place(F.col("page_id"), F.col("digest")), (F.col("size") + RECORD_BYTES).alias("weight"))
    begins = _begins(placed, shard_bytes)
    null = lambda kind: F.lit(None).cast(kind)
    rows = pages.select(page_id.alias("page_id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), html.alias("html"), digest.alias("digest"), null("long").alias("first_id"))
    marks = roles.select("page_id", F.lit(0).alias("kind"), null("string").alias("url"), null("string").alias("html"), "digest", "first_id")
    shard = _shard_of(begins)(*_place(F.col("page_id"), F.col("digest")))
    dealt = rows.unionByName(marks).withColumn("shard", shard).repartitionById(max(1, len(begins)), F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "digest")
    done = written(ordered.mapInArrow(_write_shards(out, roll_bytes), MANIFEST), "manifest")
    done.mapInArrow(_commit(out), MANIFEST).drop("temporary").write.json(f"{out}/_manifest")
    drop_written(sizes)
    return done.drop("temporary")


def records(stream) -> object:
    """The records of an uncompressed WARC stream: header dictionary (names in lower case) and block."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:x-page:").partition(":")[0]
    return int(number) if number else None


def _read(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                if headers["warc-type"] == "warcinfo":
                    continue
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(headers["x-payload-length"])
                if f"sha256:{sha256(block).hexdigest()}" != headers["warc-block-digest"]:
                    raise ValueError(f"block digest of {headers['warc-record-id']} does not hold")
                if headers["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(payload) != size or sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {headers['warc-record-id']} does not hold")
                rows.append(
                    {
                        "page_id": _page_of(headers["warc-record-id"]),
                        "payload_bytes": size,
                        "payload_digest": digest,
                        "record_type": headers["warc-type"],
                        "refers_to": _page_of(headers.get("warc-refers-to")),
                        "url": headers["warc-target-uri"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _schema(RECORDS))


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """The page records of the archives in a folder; digests are checked against what was read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out)
    return files.select("content").mapInArrow(_read, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    out = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), out)
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_oracle() -> str:
    """The same rows in DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM p)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
           CASE WHEN strlen(h) >= {LEAST_REVISIT} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(h) >= {LEAST_REVISIT} AND k > 1 THEN first END AS refers_to
    FROM f
    """
