"""WARC archives: writing with segmentation and chunked framing, and reassembly on reading.

A payload becomes the body of an HTTP response in chunked transfer framing. A block longer than ``segment_bytes`` is
split: the first record is the response with ``WARC-Segment-Number: 1``, the others are continuation records that name
its id in ``WARC-Segment-Origin-ID``, the last with ``WARC-Segment-Total-Length``. Records are written by Spark, one row
a record; as segments bound the records and ``records_per_file`` the files, a file never exceeds a known size, and
segments of one page may lie in different files.

Reading parses each file on its own; whole records pass on, segments are grouped by origin, ordered by number,
and checked (numbers 1 to n without gap, total length, chunk framing, payload digest). A payload digest is checked by the
algorithm it names (md5, sha1, sha256, sha512; hexadecimal or base 32), one of an unknown algorithm is not; SHA-256 is what is reported.

Of records with equal payloads of at least ``least_revisit`` bytes the one with the smallest id is the response and
the others are revisit records without payload that refer to its record by ``WARC-Refers-To``. A payload that very many
pages share is written by several tasks (``SALTS``).

Defined cases: null html is an empty payload; a null page_id is written without the id header and reads back
as null; rows that repeat an id and a payload are written each on their own, those with the smallest id all as
responses; an empty table gives an empty result; other columns are ignored. A broken or incomplete record
comes back with its fault in ``problem`` rather than being dropped: damaged compression, bytes that are no record, a missing or
wrong length, headers that are no numbers, a file that ends within a record; reading goes on at the file's next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm._spark import batches, shared_dir, shuffle_partitions, table

RECORD = "record_id string, origin_id string, record_type string, page_id bigint, url string, refers_to bigint, payload_digest string, payload_bytes bigint, segment int, total_length bigint, block binary, problem string"
SALTS = 16
RESULT = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, n_segments int, problem string"


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("a chunk of negative size")
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def with_revisits(pages: DataFrame, least_revisit: int) -> DataFrame:
    """``page_id, url, html, digest, n, refers_to, revisit``; the smallest id of each payload is found by a partial aggregate."""
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("n", F.octet_length("html").cast("bigint"))
    first = pages.where(F.col("n") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")
    # Rows of one payload are dealt to SALTS tasks by their id, those of one id stand next to each other there.
    salt = F.expr(f"pmod(xxhash64(coalesce(page_id, monotonically_increasing_id())), {SALTS})")
    dealt = pages.withColumn("salt", salt).repartition(shuffle_partitions(pages.sparkSession), "digest", "salt")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = dealt.join(first, ["digest", "salt"], "left").sortWithinPartitions("digest", "salt", "page_id")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", "n", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_name(page_id: int | None, digest: str, occurrence: int) -> str:
    """The id of a page's record: revisits name that of the first row of their first page; others that could clash are random."""
    if page_id is None or occurrence:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def write_archive(pages: DataFrame, path: str, least_revisit: int = 100, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, records_per_file: int = 400) -> None:
    """Write a record for each row of ``page_id, url, html`` as gzip-compressed WARC files under ``path``."""

    def records(iterator):
        before, occurrence = None, 0
        for t in batches(iterator, 2 << 20, "html"):
            out: list[bytes] = []
            for row in t.to_pylist():
                payload = row["html"].encode()
                # Ids are unique to the record, so that rows repeating a page_id stay apart.
                occurrence = occurrence + 1 if (row["page_id"], row["digest"]) == before else 0
                before = row["page_id"], row["digest"]
                record_id = record_name(row["page_id"], row["digest"], occurrence)
                url = re.sub(r"[\r\n]+", " ", row["url"]) if row["url"] is not None else None
                about = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("X-Page-Id", row["page_id"]), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Payload-Length", row["n"])]
                if row["revisit"]:
                    about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(row["refers_to"], row["digest"], 0)), ("X-Refers-To-Page", row["refers_to"])]
                    out.append(header([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *about, ("Content-Length", 0)]))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for k, part in enumerate(parts, 1):
                    split = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
                    if k == 1:
                        head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *about, ("Content-Type", "application/http; msgtype=response"), *split]
                    else:
                        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", record_id), *split]
                        head += [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
                    out.append(header([*head, ("Content-Length", len(part))]) + part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = with_revisits(pages, least_revisit).mapInArrow(records, "record binary")
    # Spark's text writer puts out the bytes as they are; a record ends with two line breaks.
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """The records of one archive file as (headers with lower-case names, block, fault or None).

    After a fault, parsing goes on where the next line begins a record.
    """
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end, fields, fault = data.find(b"\r\n\r\n", at), {}, None
        if not data.startswith(b"WARC/", at) or end < 0:
            fault = f"no WARC record at byte {at}"
        else:
            for line in data[at:end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
            if not re.fullmatch(r"\d+", fields.get("content-length", "")):
                fault = "no length"
            elif end + 4 + int(fields["content-length"]) > len(data):
                fault = "the file ends within the record"
            elif data[(stop := end + 4 + int(fields["content-length"])) : stop + 4] not in (b"\r\n\r\n", b"\r\n", b""):
                fault = "the length does not hold"
        if fault is None:
            yield fields, data[end + 4 : stop], None
            at = stop
        else:
            yield fields, b"", fault
            after = data.find(b"\r\nWARC/", at + 1)
            at = len(data) if after < 0 else after + 2


def inflated(data: bytes) -> tuple[bytes, str | None]:
    """The plain bytes of a file that may be gzip-compressed, in one member or one a record; what could be read, and a fault."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            plain.append(z.decompress(data))
        except zlib.error as e:
            return b"".join(plain), f"damaged compression: {e}"
        if not z.eof:
            return b"".join(plain), "the compressed file is cut short"
        data = z.unused_data
    return b"".join([*plain, data]), None


# Algorithms by the labels that archives give their digests.
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}


def digest_holds(stated: str, payload: bytes) -> bool:
    """Whether a labelled digest (``algorithm:value``, the value in base 16 or 32) is the payload's, as far as its algorithm is known."""
    label, _, value = stated.rpartition(":")
    name = ALGORITHMS.get(label.strip().lower() or "sha256")
    if name is None:
        return True
    found = hashlib.new(name, payload).digest()
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def plain_sha256(stated: str | None) -> str | None:
    """The bare hexadecimal value of a SHA-256 digest; other digests as they are."""
    label, _, value = (stated or "").rpartition(":")
    return value.strip().lower() if ALGORITHMS.get(label.strip().lower()) == "sha256" and re.fullmatch(r"[0-9a-fA-F]{64}", value.strip()) else stated


def _record(h: dict, block: bytes, fault: str | None) -> tuple:
    def number(name: str) -> int | None:
        nonlocal fault
        if h.get(name) and not re.fullmatch(r"-?\d{1,18}", h[name]):
            fault = fault or f"{name} is no number"
            return None
        return int(h[name]) if h.get(name) else None

    digest = h.get("warc-payload-digest") or None
    segment = number("warc-segment-number")
    if segment is not None and not 0 < segment < 1 << 31:
        segment, fault = None, fault or "warc-segment-number is out of range"
    row = (h.get("warc-record-id"), h.get("warc-segment-origin-id"), h.get("warc-type"), number("x-page-id"), h.get("warc-target-uri"), number("x-refers-to-page"), digest, number("x-payload-length"), segment, number("warc-segment-total-length"))
    return *row, block, fault


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the files under ``path`` (plain or gzip; see ``RECORD``)."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]

    def parse(iterator):
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in iterator:
            for k in range(batch.num_rows):
                data, fault = inflated(batch.column("content")[k].as_py())
                rows, size = [], 0
                for h, block, wrong in parse_records(data):
                    rows.append(_record(h, block, wrong))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if fault:
                    rows.append(_record({}, b"", fault))
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each response or revisit record, with ``parts``: its blocks in segment order."""
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "total_length", "block")
    # A faulty record stands for itself; a segment that is missing for it is then found missing.
    alone = F.col("problem").isNotNull() | (F.coalesce("record_type", F.lit("")) != "continuation") & F.col("segment").isNull()
    whole = records.where(alone).withColumns({"parts": F.array(part), "split": F.lit(False)})
    # Only records that were split meet in a shuffle; a group is the segments of one payload.
    split = records.where(~alone).withColumn("key", F.coalesce("origin_id", "record_id")).withColumn("part", part)
    about = ["record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "problem"]
    head = F.max(F.when(F.col("record_type") != "continuation", F.struct(*about))).alias("head")
    joined = split.groupBy("key").agg(head, F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(*about, "parts", "split").unionByName(joined.select("head.*", "parts", F.lit(True).alias("split")))


def decode_payloads(assembled: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Check and decode each record; ``RESULT``, and ``payload`` if asked for (null for revisits and broken ones)."""

    def check(iterator):
        names = [c.split()[0] for c in RESULT.split(", ")] + (["payload"] if keep_payload else [])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary()][: len(names)]
        for batch in iterator:
            rows = []
            for r in batch.to_pylist():
                parts, payload, problem = r["parts"], None, None
                try:
                    if r["problem"] is not None:
                        raise ValueError(r["problem"])
                    if r["record_type"] is None and r["split"]:
                        raise ValueError("continuation records without their first one")
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError("segments are missing or repeated")
                    if r["split"] and parts[-1]["total_length"] != len(block):
                        raise ValueError("the total length does not hold")
                    if r["record_type"] == "response":
                        http, _, body = block.partition(b"\r\n\r\n")
                        payload = dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", http) else body
                        if r["payload_digest"] is not None and not digest_holds(r["payload_digest"], payload):
                            raise ValueError("the payload's digest does not hold")
                        r["payload_digest"], r["payload_bytes"] = hashlib.sha256(payload).hexdigest(), len(payload)
                except ValueError as e:
                    problem = str(e)
                row = (r["page_id"], r["url"], r["payload_bytes"], plain_sha256(r["payload_digest"]), r["record_type"], r["refers_to"], len(parts), problem, payload)
                rows.append(row[: len(names)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return assembled.mapInArrow(check, RESULT + (", payload binary" if keep_payload else ""))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = decode_payloads(reassemble(read_records(spark, path)))
    # A fault must not pass for a result.
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("page "), F.col("page_id"), F.lit(": "), F.col("problem"))))
    return found.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
