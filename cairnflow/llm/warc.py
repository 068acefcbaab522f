"""WARC archives in ZIP packages: writing, and reading records by ranges.

A package holds archive/data.warc.gz (a gzip member for each record), indexes/index.cdxj (a line for each record with
its offset and length) and datapackage.json, all stored without further packing. Packages have bounded size. Tasks that
succeed report their packages in a manifest, so packages of failed or repeated attempts are never read.

Records with equal payloads are written once: the row with the smallest id is the response, the others are revisit
records that refer to it and carry digest and length only.

Defined results: a null html counts as empty; an empty payload is a payload like any other; rows that repeat the
smallest id of a payload are all responses; null ids come before others and are kept; a null url is left out; an empty
table gives no packages; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zipfile
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, scratch, written
from cairnflow.llm.filters import MOST_BYTES, Filter, key_filter
from cairnflow.llm.zip_directory import ZipDirectory

PACKAGE_BYTES = 32 << 20
"""Packed bytes, of records of any kind and their index lines, after which a package is closed."""
HOT_SHARE = 1_000
"""A digest of over this part of all pages is hot: there are at most as many hot digests, so they can be broadcast."""
RECORDS, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record; the HTTP header of a revisit keeps the length of the payload that it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe=";/?:@&=+$,#%!*'()~[]") if url is not None else None,
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (None for revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    f = _fields(head)
    body = rest[: int(f["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    page = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    revisit = f["warc-type"] == "revisit"
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload of {f['warc-record-id']}")
    return {
        "page_id": page(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": f["warc-type"],
        "payload_digest": digest, "payload_bytes": size, "refers_to": page(f.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


class Package:
    def __init__(self):
        self.records, self.index, self.size, self.n = io.BytesIO(), [], 0, 0

    def add(self, page, url, payload, refers_to, revisit) -> None:
        packed = gzip.compress(record(page, url, payload, refers_to, revisit), 6, mtime=0)
        self.index.append(json.dumps({"page": page, "offset": self.records.tell(), "length": len(packed)}))
        self.records.write(packed)
        self.size += len(packed) + len(self.index[-1])
        self.n += 1

    def dump(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(RECORDS), self.records.getbuffer())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
            about = {"profile": "data-package", "resources": [{"path": RECORDS}, {"path": INDEX}], "records": self.n}
            z.writestr(zipfile.ZipInfo(ABOUT), json.dumps(about))
        return out.getvalue()


_MANIFEST = pa.schema([("package", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _chosen(known, passing: bool):
    """Rows whose digest a broadcast filter lets pass, or the others."""

    def choose(batches):
        for b in batches:
            keys = np.array([int(d[:16], 16) for d in b.column("digest").to_pylist()], np.uint64)
            yield b.filter(pa.array(known.value.has(keys) == passing))

    return choose


def write_packages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, package_bytes: int = PACKAGE_BYTES,
    filter_bytes: int = MOST_BYTES,
) -> DataFrame:
    """The manifest of the packages: package, bytes, records. The key must be an integer.

    Which record is the response is the smallest key of each payload digest: an aggregate of narrow rows. Only pages whose
    digest repeats have to learn of it; a filter of these digests, sent to all tasks where its size allows, tells which may
    be such, and all others are packed where they are. Of those it lets pass, pages of the few digests of very many pages
    meet them by broadcast, and the rest is shuffled."""
    folder = scratch(pages.sparkSession, "packages")
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("digest").agg(F.min("page").alias("first"), F.max(F.col("page").isNull()).alias("none"), F.count("*").alias("n"))
    repeated = written(first.where("n > 1"), f"{folder}/digests")
    total = rows.count()
    hot = repeated.where(F.col("n") > total // HOT_SHARE).select("digest", "first", "none")
    kinds = "page bigint, url string, html string, digest string"
    count = repeated.count()
    if Filter.size(count) * 8 <= filter_bytes:
        keys = repeated.select(F.conv(F.substring("digest", 1, 16), 16, -10).cast("long").alias("key"))
        known = spark.sparkContext.broadcast(key_filter(keys, count))
        alone, rows = (map_batches(rows, _chosen(known, passing), kinds, rows=64) for passing in (False, True))
    else:
        alone = None
    common = rows.join(F.broadcast(hot), "digest")
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(repeated.drop("n"), "digest", "left")
    placed = common.unionByName(others).withColumn(
        "revisit",
        F.coalesce((F.octet_length("html") >= min_bytes) & F.col("page").isNotNull() & ~F.col("none") & (F.col("page") > F.col("first")), F.lit(False)),
    )
    columns = ["page", "url", "html", "first", "revisit"]
    placed = placed.select(*columns)
    if alone is not None:
        own = alone.select("page", "url", "html", F.col("page").alias("first"), F.lit(False).alias("revisit"))
        placed = own.unionByName(placed)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(package: Package):
            data, name = package.dump(), uuid.uuid4().hex + ".wacz"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = {"package": f"{folder}/{name}", "bytes": len(data), "records": package.n}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        package = Package()
        for b in batches:
            for r in b.to_pylist():
                package.add(r["page"], r["url"], r["html"].encode("utf-8", "replace"), r["first"] if r["revisit"] else None, r["revisit"])
                if package.size >= package_bytes:
                    yield put(package)
                    package = Package()
        if package.n:
            yield put(package)

    manifest = map_batches(placed, run, "package string, bytes bigint, records bigint")
    return written(manifest, f"{folder}/manifest")


def read_records(package: str, size: int):
    """The records of a package, each by one range read; the package isn't extracted."""
    store, name = fs.FileSystem.from_uri(package)
    with store.open_input_file(name) as f:
        directory = ZipDirectory(lambda offset, n: f.read_at(n, offset), size)
        records, index = directory.members[RECORDS], directory.members[INDEX]
        begin = directory.place(records)
        for line in directory.range(index, 0, index.size).decode().split("\n"):
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > records.size:
                raise ValueError("an index line points beyond the archive")
            yield parse(gzip.decompress(f.read_at(entry["length"], begin + entry["offset"])))


def read_packages(manifest: DataFrame, key: str = "page_id", payload: bool = True) -> DataFrame:
    """key, url, payload_bytes, payload_digest, record_type, refers_to, and payload (null for revisits)."""
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ] + [("payload", pa.binary())] * payload
    schema = pa.schema(kinds)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                rows = []
                for r in read_records(row["package"], row["bytes"]):
                    rows.append(r)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.repartition(parts, "package")
    columns = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return map_batches(spread, run, columns + ", payload binary" * payload).withColumnRenamed("page_id", key)
