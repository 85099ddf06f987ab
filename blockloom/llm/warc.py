"""WARC archives: writing with revisits, segments and chunked framing, reading with reassembly.

Writing is one SQL plan whose text sink puts records into files of the shared folder.  Reading parses
files as streams of records, groups continuation records by their origin's identifier, orders them by
segment number, verifies the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import new_path, written

SEGMENT_BYTES = 1 << 20
"""Payload bytes in one record; a longer payload continues in further records."""
CHUNK_BYTES = 1 << 16
FILE_BYTES = 512 << 20
"""Payload bytes of one archive before compression, at most: a reader holds a file's content at once."""
SALTS = 16
"""Parts that rows of one payload are dealt over where repeated payloads are joined by shuffle."""
BROADCAST_ROWS = 50_000
"""Repeated payloads up to this number are broadcast to the writers; more are joined by shuffle."""
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, eight digits from every five bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _binary(text: Column) -> Column:
    return text.cast("binary")


def _frames(piece: Column, last: Column) -> Column:
    """A piece of payload in chunked framing, closed by the empty chunk if it is the last."""
    n = F.octet_length(piece)
    chunks = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(CHUNK_BYTES))).otherwise(F.array().cast("array<int>"))

    def frame(i: Column) -> Column:
        part = F.substring(piece, i, F.lit(CHUNK_BYTES))
        return F.concat(_binary(F.concat(F.lower(F.hex(F.octet_length(part))), F.lit("\r\n"))), part, _binary(F.lit("\r\n")))

    framed = F.aggregate(F.transform(chunks, frame), _binary(F.lit("")), lambda a, b: F.concat(a, b))
    return F.concat(framed, F.when(last, _binary(F.lit("0\r\n\r\n"))).otherwise(_binary(F.lit(""))))


def _header(pairs: list[tuple[str, Column]]) -> Column:
    """Header lines; those whose value is null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in pairs]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes one record for each row (and continuation records) to gzipped archives under path.

    Of rows with equal payloads of at least min_revisit_bytes the one with the largest id is a
    response and the others are revisits of it.  Null payloads are empty, null URLs leave their header
    out; null ids rank lowest and come back as null. Line breaks in URLs become %0A and %0D."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    whole = -(-segment_bytes // CHUNK_BYTES) * CHUNK_BYTES
    url = F.replace(F.replace(q(url_col).cast("string"), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))
    rows = pages.select(q(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(_binary(q(payload_col)), _binary(F.lit(""))).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("ref"), F.count("*").alias("copies"))
    repeated = written(groups.where("copies > 1 and ref is not null").select("digest", "ref"), "warc-repeats")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:  # one payload, such as the empty one, may be that of a third of all rows
        dealt = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"], "left").drop("salt")
    revisit = F.col("ref").isNotNull() & F.coalesce(F.col("id") != F.col("ref"), F.lit(True))
    rows = rows.withColumn("revisit", revisit).withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null-"), F.uuid())))
    segments = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / whole)).cast("int"))
    rows = rows.withColumn("segments", segments).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    first, last, several = F.col("k") == 0, F.col("k") == F.col("segments") - 1, F.col("segments") > 1
    piece = F.substring(F.col("payload"), (F.col("k") * whole + 1).cast("int"), F.lit(whole))
    head = _binary(F.lit(HTTP_HEAD))
    block = F.when(F.col("revisit"), head).when(first, F.concat(head, _frames(piece, last))).otherwise(_frames(piece, last))
    rest = F.col("n") % CHUNK_BYTES
    total = len(HTTP_HEAD) + F.col("n") + F.floor(F.col("n") / CHUNK_BYTES) * (len(f"{CHUNK_BYTES:x}") + 4) + F.when(rest > 0, F.length(F.hex(rest)) + 4).otherwise(0) + 5
    name = lambda k: F.concat(F.lit("<urn:page:"), F.col("key"), F.when(k > 0, F.concat(F.lit(":segment:"), k.cast("string"))).otherwise(F.lit("")), F.lit(">"))
    only = lambda cond, value: F.when(cond, value)
    text = lambda v: v.cast("string")
    lines = _header([
        ("WARC-Type", F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")),
        ("WARC-Record-ID", name(F.col("k"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", only(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        ("WARC-Profile", only(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", only(F.col("revisit"), F.concat(F.lit("<urn:page:"), text(F.col("ref")), F.lit(">")))),
        ("WARC-Segment-Number", only(several, text(F.col("k") + 1))),
        ("WARC-Segment-Origin-ID", only(~first, name(F.lit(0)))),
        ("WARC-Segment-Total-Length", only(several & last, text(total.cast("long")))),
        ("X-Payload-Length", only(first, text(F.col("n")))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        ("Content-Length", text(F.octet_length("block"))),
    ])
    record = F.concat(_binary(lines), F.col("block"), _binary(F.lit("\r\n\r")))  # the sink's line feed ends the record
    out = rows.withColumn("block", block).select(record.cast("string").alias("value"))
    # No record holds more than the largest payload or segment, so this many stay within file_bytes.
    largest = pages.agg(F.max(F.octet_length(_binary(q(payload_col))))).first()[0] or 0
    records_per_file = min(20_000, max(1, file_bytes // max(1, min(whole, largest))))
    out.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def dechunk(body: bytes) -> bytes:
    """The content of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return dechunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


_FIELDS = "record_id string, record_type string, url string, refers_to string, payload_digest string, declared_bytes long, origin string, segment int, total_length long, block binary"


def _id(value: str | None) -> str | None:
    return value.strip("<>").removeprefix("urn:page:") if value else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, segments not yet joined."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("declared_bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                stream = pa.BufferReader(raw)
                plain = gzip.GzipFile(fileobj=stream) if raw[:2].to_pybytes() == b"\x1f\x8b" else stream
                rows: list[tuple] = []
                size = 0
                for h, block in records(io.BufferedReader(plain, 1 << 20)):
                    g = h.get
                    rows.append((_id(g("warc-record-id")), g("warc-type"), g("warc-target-uri"), _id(g("warc-refers-to")), (g("warc-payload-digest") or "").removeprefix("sha1:") or None, number(g("x-payload-length")), _id(g("warc-segment-origin-id")), number(g("warc-segment-number")), number(g("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _FIELDS)


def _join_segments(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("segment").drop_duplicates("segment")
    first, last = group.iloc[[0]], group.iloc[-1]
    block = b"".join(group["block"])
    if list(group["segment"]) != list(range(1, len(group) + 1)) or pd.isna(last["total_length"]) or len(block) != last["total_length"]:
        raise ValueError(f"segments of {first['record_id'].iloc[0]} are missing or of the wrong length")
    return first.assign(block=[block], total_length=last["total_length"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit record: record_id, record_type, url, refers_to,
    payload_digest and declared_bytes as the headers have them, and payload (null for revisits).

    Continuation records are joined to their origin; missing segments, wrong total lengths and broken
    chunks raise. Empty folders of archives give an empty table."""
    every = read_records(spark, path)
    whole = every.where("segment is null")
    parts = every.where("segment is not null").withColumn("group", F.coalesce("origin", "record_id"))
    joined = parts.groupBy("group").applyInPandas(lambda g: _join_segments(g).drop(columns="group"), _FIELDS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("record_type").to_pylist()
            payloads = [http_payload(b) if k == "response" else None for k, b in zip(kinds, batch.column("block").to_pylist())]
            names = ["record_id", "record_type", "url", "refers_to", "payload_digest", "declared_bytes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(payloads, pa.binary())], names=[*names, "payload"])

    return whole.unionByName(joined).mapInArrow(decode, "record_id string, record_type string, url string, refers_to string, payload_digest string, declared_bytes long, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, with page_id and payload size."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    back = read_archives(pages.sparkSession, path)
    page = lambda c: F.when(F.col(c).rlike("^-?[0-9]+$"), F.col(c).cast("long"))
    digest = F.coalesce(base32_sha1(F.col("payload")), F.col("payload_digest"))
    return back.select(page("record_id").alias("page_id"), "url", F.coalesce(F.octet_length("payload").cast("long"), "declared_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "payload")
