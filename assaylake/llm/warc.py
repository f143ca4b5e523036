"""Web archives: writing records in segments with chunked transfer framing, and putting them together again.

A record longer than a segment is a response record with segment number 1 and continuation records that name its record as
origin. Reading groups the segments by origin, orders them by number, checks that none is missing and that
their bytes add up to the total length of the last, and undoes the chunked framing. A page whose payload an earlier page has is a revisit.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.lineage import _shared_folder, cut
from assaylake.llm.common import small_batches, table
from assaylake.llm.registry import query

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
REVISIT_BYTES = 100
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SCHEMA = "origin string, page_id long, record_type string, refers_to long, segment int, total long, digest string, block binary"


# ---- writing ------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    frames = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(frames) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None when the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, record: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page, without the blank lines that end them: one, or as many segments as it takes."""
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    target = "".join(c for c in url or "" if c > " ") or f"urn:page:{page_id}"
    named = [("WARC-Record-ID", f"<{record}>"), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id)]
    if refers_to is not None:
        return [_record("revisit", [*named, ("WARC-Payload-Digest", digest), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to)], HTTP)]
    block = HTTP + chunked(payload)
    kind = [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record("response", named + kind, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", [*named, *kind, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Record-ID", f"<{record}-{i}>"), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", i)]
        out.append(_record("continuation", own + [("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part))
    return out


def first_pages(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload of at least ``least_bytes``, null on that page itself."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("_digest", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    firsts = keyed.where("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = keyed.join(firsts, "_digest", "left")
    return found.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("_first"), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html, refers_to) as gzipped archives under ``path``, by Spark's text writer.

    Null html is an empty payload; a null url or one with blanks becomes a urn of the page. Every row is a
    record, repeated rows too: a row's number makes its record id.
    """

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                record = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row['page_id']}/{row['_row']}')}"
                out += records_of(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], record, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])

    rows = small_batches(pages).select("page_id", "url", "html", "refers_to", F.monotonically_increasing_id().alias("_row"))
    rows.mapInArrow(run, "row binary").select(F.col("row").cast("string")).write.option("lineSep", END).option("compression", "gzip").text(path)


# ---- reading ------------------------------------------------------------------------------------


def parse(data: bytes):
    """(fields with lower-case names, block) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(fields["content-length"])
        yield fields, data[start : start + n]
        at = start + n + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``: origin (its own id where it is no continuation), page_id, record_type, refers_to, segment (null: whole), total, digest, block."""

    def run(batches):
        import gzip

        for batch in batches:
            for content in batch["content"]:
                rows = []
                for f, block in parse(gzip.decompress(content.as_py())):
                    number = lambda k: int(f[k]) if f.get(k, "None") != "None" else None  # noqa: B023, E731
                    rows.append({
                        "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "page_id": number("warc-page-id"), "record_type": f["warc-type"], "refers_to": number("warc-refers-to-page-id"),
                        "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "digest": f.get("warc-payload-digest"), "block": block,
                    })
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    files = spark.read.format("binaryFile").load(path).where(F.element_at(F.split("path", "/"), -1).startswith("part-")).select("content")
    return files.mapInArrow(run, SCHEMA)


RECORDS = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def _payload(block: bytes, kind: str, digest: str) -> tuple[bytes | None, str]:
    if kind == "revisit":
        return None, "ok"
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if payload is None:
        return None, "broken framing"
    return payload, "ok" if digest == "sha256:" + hashlib.sha256(payload).hexdigest() else "wrong digest"


PAGES = "page_id long, record_type string, refers_to long, digest string, payload binary, status string"


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, digest, payload and status of every page.

    Whole records stay where they are; segments alone are grouped by origin. status is "ok", "missing segments",
    "wrong length", "broken framing" or "wrong digest"; payload is null where it could not be made, and for revisits.
    """

    def whole(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, status = _payload(r["block"], r["record_type"], r["digest"])
                rows.append({"page_id": r["page_id"], "record_type": r["record_type"], "refers_to": r["refers_to"], "digest": r["digest"], "payload": payload, "status": status})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*(RECORDS.field(n) for n in ("page_id", "record_type", "refers_to", "digest")), ("payload", pa.binary()), ("status", pa.string())]))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment").drop_duplicates("segment")
        first = group.iloc[0]
        block, last = b"".join(group["block"]), group["total"].iloc[-1]
        payload, status = None, "ok"
        if list(group["segment"]) != list(range(1, len(group) + 1)) or pd.isna(last):
            status = "missing segments"
        elif len(block) != int(last):
            status = "wrong length"
        else:
            payload, status = _payload(block, first["record_type"], first["digest"])
        return pd.DataFrame([{"page_id": first["page_id"], "record_type": first["record_type"], "refers_to": first["refers_to"], "digest": first["digest"], "payload": payload, "status": status}])

    single, parts = records.where("segment is null"), records.where("segment is not null")
    return single.mapInArrow(whole, PAGES).unionByName(parts.groupBy("origin").applyInPandas(joined, PAGES))


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status: sizes and digests of full payloads as read, a revisit's from the page it refers to.

    A revisit whose page is absent, or has another digest, gets status "unresolved" and null size.
    """
    light = cut(pages.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("_bytes"), F.sha2("payload", 256).alias("_sha"), "status"))
    targets = light.where("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("_sha").alias("_t")).agg(F.max("_bytes").alias("_n"))
    same = (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.concat(F.lit("sha256:"), F.col("_t")))
    revisits = light.where("record_type = 'revisit'").join(targets, same, "left")
    revisits = revisits.select("page_id", F.col("_n").alias("payload_bytes"), F.col("_t").alias("payload_digest"), "record_type", "refers_to", F.when(F.col("_t").isNull(), "unresolved").otherwise(F.col("status")).alias("status"))
    own = light.where("record_type = 'response'").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), "record_type", "refers_to", "status")
    return own.unionByName(revisits)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to, 'ok' AS status FROM f
"""


@query("op4_warc_segments", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(first_pages(table(spark, sf_dir, "pages")), path)
    return resolve(reassemble(read_records(spark, path)))
