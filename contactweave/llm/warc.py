"""Web archives with resolved revisits.

Headers (page id, payload digest, payload size) are shuffled by digest; the
smallest page id of a digest stays a response and the others become revisit
records that refer to it.  Archives are written with fresh headers, one gzip
member per record, and read back by joining revisits to their responses; a
response whose payload does not have the digest of its header is an error.

A record's id is that of its page id and payload digest.  Rows that repeat both, and
rows without a page id, get ids of their own from their place in the files, and a
revisit of a repeated response names its page id only.

Files are written by executors into the shared folder through the file system of
its URI, under a temporary name first and then renamed, so a repeated task writes
the same file again.

Defined results: null html is an empty payload; rows that repeat the smallest page
id of their payload are that record again and all stay responses; null page ids
come after all others, so they are revisits of a page with their payload, are never
referred to, and stay responses where only null ids have it; null URLs leave the target
field out; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import bounded_batches, shared_folder, small, written

#: Symbols of base32 and of numbers to the base of 32, in the order of their values.
BASE32, BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_hex(payload_digest: Column) -> Column:
    """A base32 digest in lower-case hexadecimal digits, as ``sha1`` gives them."""
    group = lambda i: F.lpad(F.conv(F.translate(F.substring(payload_digest, 4 * i + 1, 4), BASE32, BASE32_DIGITS), 32, 16), 5, "0")
    return F.lower(F.concat(*map(group, range(8))))


def record_id(page_id: int | None, payload_digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, date: str, copy: str = "", refers_to: int | None = None, named: bool = True) -> bytes:
    """One WARC/1.1 record; one that refers to a page is a revisit, which keeps the
    HTTP header and drops the payload.  ``named`` tells whether the response that it
    revisits is the only one of its page id and payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, payload_digest, copy)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
        fields += [("WARC-Refers-To", record_id(refers_to, payload_digest))] * named
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive, member by member."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(view):
                raise ValueError("truncated archive")
            out.append(unzip.decompress(view[at : at + 32768]))
            at = min(at + 32768, len(view)) - len(unzip.unused_data)
        raw = io.BytesIO(b"".join(out))
        while line := raw.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields = {}
            while (line := raw.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            yield fields, raw.read(int(fields["content-length"]))


def payload_of(block: bytes) -> tuple[bytes, int]:
    """(payload, the Content-Length that its HTTP header gives)."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    return body, stated


def headers(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) per row."""
    bounded_batches(pages.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [(h or "").encode() for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())], ["page_id", "payload_digest", "payload_bytes"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(measure, "page_id bigint, payload_digest string, payload_bytes bigint")


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(r, d, n, refers_to, named, again) of the page ids and payloads that are not
    plain responses: revisits, which refer to a page, and records that several rows
    repeat (again).  Null page ids are one row by payload that a page has too."""
    ids = heads.where(F.col("page_id").isNotNull()).groupBy("page_id", F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    ids = written(ids, "payloads")
    # Copies of a payload are summed before the shuffle; the first of them is kept.
    first = F.min(F.struct("page_id", "rows")).alias("o")
    firsts = ids.where(F.col("n") >= min_bytes).groupBy(F.col("d").alias("sd"), F.col("n").alias("sn")).agg(first, F.count(F.lit(1)).alias("c"))
    same = firsts.where("c > 1").drop("c")
    met = ids.join(small(same), (F.col("d") == F.col("sd")) & (F.col("n") == F.col("sn")), "left")
    refers_to = F.when(F.col("o.page_id") < F.col("page_id"), F.col("o.page_id"))
    out = met.select(F.col("page_id").alias("r"), "d", "n", refers_to.alias("refers_to"), F.coalesce(F.col("o.rows") == 1, F.lit(True)).alias("named"), (F.col("rows") > 1).alias("again"))
    nameless = heads.where(F.col("page_id").isNull()).select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    nameless = nameless.join(firsts, (F.col("d") == F.col("sd")) & (F.col("n") == F.col("sn")))
    nameless = nameless.select(F.lit(None).cast("long").alias("r"), "d", "n", F.col("o.page_id").alias("refers_to"), (F.col("o.rows") == 1).alias("named"), F.lit(True).alias("again"))
    return out.where(F.col("refers_to").isNotNull() | F.col("again")).unionByName(nameless)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = 64 << 20, date: str | None = None) -> DataFrame:
    """Write deduplicated archives and return the names of the files.  ``date`` is
    the records' WARC-Date, by default the time of the call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = written(headers(pages, id_col, html_col), "headers")
    revisits = written(resolve(heads, min_bytes), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # Payloads of an id are told apart by the writer, which has their digests.
    found = F.struct("d", "n", "refers_to", "named", "again")
    of_id = revisits.where("r is not null").groupBy("r").agg(F.collect_list(found).alias("payloads"))
    # Rows without an id are no key of their own: they meet their revisit by payload.
    of_payload = small(revisits.where("r is null").select(digest_hex(F.col("d")).alias("hex"), F.array(found).alias("payloads")))
    named = rows.where("page_id is not null").join(of_id, F.col("page_id") == F.col("r"), "left").drop("r")
    nameless = rows.where("page_id is null").withColumn("own", F.sha1(F.coalesce("html", F.lit("")))).join(of_payload, F.col("own") == F.col("hex"), "left").drop("own", "hex")
    rows = named.unionByName(nameless).select(F.spark_partition_id().alias("part"), "page_id", "url", "html", "payloads")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part, n, held, size, at = None, 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held, size
            name = f"part-{part:06d}-{n:04d}.warc.gz"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary, compression=None) as f:
                for x in held:
                    f.write(x)
            files.move(temporary, f"{base}/{name}")
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pydict({"name": [name]})

        for b in batches:
            for row in b.to_pylist():
                part = row["part"] if part is None else part
                payload = (row["html"] or "").encode()
                d = digest(payload)
                of = next((x for x in row["payloads"] or () if (x["d"], x["n"]) == (d, len(payload))), {"refers_to": None, "named": True, "again": False})
                copy, at = f"{part}-{at}" if of["again"] or row["page_id"] is None else "", at + 1
                one = record(row["page_id"], row["url"], payload, d, date, copy, of["refers_to"], of["named"])
                held.append(gzip.compress(one, 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return written(rows.mapInArrow(write, "name string"), "archives")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """Per record: page_id, url, record_type, payload_digest, stated_bytes,
    payload (null in revisits), refers_to."""
    spark = names.sparkSession
    bounded_batches(spark)
    n = names.count()
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for fields, block in records_of(data):
                    body, stated = payload_of(block)
                    kind, stated_digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest(body) != stated_digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} in {name} does not have its digest")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                    rows.append({"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": stated_digest, "stated_bytes": stated, "payload": None if kind == "revisit" else body, "refers_to": number("warc-refers-to-page-id")})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    parts = max(1, min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return names.repartition(parts, "name").mapInArrow(read, "page_id bigint, url string, record_type string, payload_digest string, stated_bytes bigint, payload binary, refers_to bigint")


def resolved(records: DataFrame) -> DataFrame:
    """Records with full payloads' sizes: a revisit's size is that of the
    response it refers to, found by join."""
    slim = written(records.select("page_id", "record_type", "payload_digest", F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).alias("own"), "refers_to"), "records")
    originals = slim.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("o"), F.col("payload_digest").alias("od")).agg(F.max("own").alias("of_original"))
    met = slim.where("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("o")) & (F.col("payload_digest") == F.col("od")), "left")
    columns = lambda n: ("page_id", n.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return slim.where("record_type <> 'revisit'").select(*columns(F.col("own"))).unionByName(met.select(*columns(F.col("of_original"))))


def archive_table(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    folder = folder or shared_folder(pages.sparkSession, "archives")
    return resolved(read_archives(write_archives(pages, folder, min_bytes), folder))
