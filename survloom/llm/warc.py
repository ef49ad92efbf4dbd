"""WARC archives: written by Spark's text writer, read back, assembled to captures.

Each page becomes three records: its request, its response (or a revisit of an equal
payload) and a metadata record. The request and the metadata name the response in
``WARC-Concurrent-To``. A record is a line of the text writer whose line separator is
the blank line that ends WARC records, so the files are written and compressed on the
shared storage by Spark itself; gzip keeps a file in one piece for the reader, which
follows the lengths in the headers and holds one record at a time.

Of pages with equal payloads of at least ``LEAST_BYTES`` bytes those with the smallest
page id are responses and the others revisits; a revisit is resolved through its
payload digest. Null ids rank last. A null html is an empty payload, a null url an
empty target. Line breaks in urls are percent-encoded. Repeated rows are captures of
their own; rows that share the smallest id are all responses. Other columns are not
archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survloom.llm.common import table, text_of
from survloom.settings import fresh_path, staged

LEAST_BYTES = 100
#: Records of one file at most.
FILE_RECORDS = 30_000
_BREAK = "\r\n"
_END = _BREAK * 2
_DATE = "2000-01-01T00:00:00Z"


def _record(kind: str | Column, headers: list[Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [
        F.concat(F.lit("WARC/1.1" + _BREAK + "WARC-Type: "), kind),
        F.lit(f"WARC-Date: {_DATE}"),
        *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the headers that are null.
    return F.concat(F.concat_ws(_BREAK, *lines), F.lit(_END), block)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the archives of ``pages`` below ``path``."""
    address = F.regexp_replace(F.regexp_replace(text_of(url), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), address.alias("url"), text_of(html).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    shared = rows.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    shared = shared.filter("n > 1").select("digest", "first", F.lit(True).alias("shared"))
    rows = rows.join(shared, "digest", "left").withColumn("name", F.uuid())
    revisit = F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    named = lambda suffix: F.concat(F.lit("<urn:uuid:"), F.col("name"), F.lit(f"{suffix}>"))
    target = line("WARC-Target-URI", F.col("url"))
    status = F.concat(
        F.lit("HTTP/1.1 200 OK" + _BREAK + "Content-Type: text/html; charset=utf-8" + _BREAK + "Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_END),
    )
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise("response"),
        [line("WARC-Record-ID", named("")), target, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), profile,
         F.when(revisit, line("WARC-Refers-To-Date", F.lit(_DATE))), F.lit("Content-Type: application/http;msgtype=response")],
        F.when(revisit, status).otherwise(F.concat(status, F.col("html"))),
    )
    request = _record(
        "request",
        [line("WARC-Record-ID", named(":request")), target, line("WARC-Concurrent-To", named("")), F.lit("Content-Type: application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + _END)),
    )
    metadata = _record(
        "metadata",
        [line("WARC-Record-ID", named(":metadata")), line("WARC-Concurrent-To", named("")), F.lit("Content-Type: application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_BREAK)),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(data: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Records (file, headers by lower-case name, block) of the pieces (file, bytes) in order."""
    held, parts, have, need, file = b"", [], 0, 0, None
    for name, piece in data:
        if name != file:
            if held.strip() or b"".join(parts).strip():
                raise ValueError(f"{file} ends within a record")
            held, parts, have, need, file = b"", [], 0, 0, name
        parts.append(piece)
        have += len(piece)
        if have < need:
            continue
        held, parts = b"".join((held, *parts)), []
        while True:
            held_start = len(held) - len(held.lstrip(b"\r\n"))
            head = held.find(b"\r\n\r\n", held_start)
            if head < 0:
                need = 0
                break
            lines = held[held_start:head].decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            end = head + 4 + int(headers["content-length"])
            if end > len(held):
                need = end
                break
            yield name, headers, held[head + 4 : end]
            held = held[end:]
        have = len(held)
    if held.strip() or b"".join(parts).strip():
        raise ValueError(f"{file} ends within a record")


_RECORD = "type string, record_id string, concurrent_to string, target_uri string, payload_digest string, fields string, payload_bytes long, payload_sha256 string, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record; without ``payload`` only its length and digest are kept."""
    import hashlib

    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    end = _END.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (
            (file, text.encode() + end)
            for batch in batches
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        )
        out, size = [], 0
        for _, head, block in records(pieces):
            kind = head.get("warc-type")
            body = block.partition(end)[2] if kind == "response" else None
            out.append((
                kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"),
                (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                block.decode() if kind == "metadata" else None,
                None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), body if payload else None,
            ))
            size += len(block)
            if len(out) >= 2000 or size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    lines = spark.read.option("lineSep", _END).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.mapInArrow(run, _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response or revisit, and metadata.

    Requests and metadata find their response through their concurrent-to identifier;
    a capture without one of them has null there. Identifiers are unique in an archive; of
    records that share one, the largest by their fields counts. A request or metadata record
    whose response is not there makes no capture.
    """
    main = F.col("type").isin("response", "revisit")
    whole = F.struct("type", "record_id", "target_uri", "payload_digest", "payload_bytes", "payload_sha256", "payload")
    parts = {
        "request": F.when(F.col("type") == "request", F.struct("record_id", "target_uri")),
        "metadata": F.when(F.col("type") == "metadata", F.struct("record_id", "fields")),
        "response": F.when(main, whole),
    }
    # All three kinds meet in one shuffle, so the archives are read and parsed once.
    keyed = found.filter(main | F.col("type").isin("request", "metadata"))
    keyed = keyed.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    joined = keyed.groupBy("capture").agg(*[F.max(part).alias(name) for name, part in parts.items()])
    return joined.filter(F.col("response").isNotNull()).select("capture", "response", "request", "metadata")


def page_records(captures: DataFrame) -> DataFrame:
    """Columns page_id, payload_bytes, payload_digest, record_type, refers_to.

    The length and the page of a revisit come from the response with its digest. The
    captures are staged without payloads, so that the archives are read once.
    """
    number = F.regexp_extract("metadata.fields", "page-id: (-?[0-9]+)", 1)
    rows = captures.select(
        F.when(number != "", number.cast("long")).alias("page_id"), F.col("response.type").alias("record_type"),
        F.coalesce("response.payload_sha256", "response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("own"),
    )
    rows = staged(rows, "captures")
    full = rows.filter((F.col("record_type") == "response") & (F.col("own") >= LEAST_BYTES))
    full = full.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("own").alias("bytes"))
    revisits = rows.filter(F.col("record_type") == "revisit").join(full, "payload_digest", "left")
    revisits = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"))
    responses = rows.filter(F.col("record_type") == "response").select(
        "page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    return responses.unionByName(revisits)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return page_records(assemble(read(spark, path, payload=False)))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
