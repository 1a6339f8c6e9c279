"""Digests of archives from elsewhere."""

from __future__ import annotations

import base64
import hashlib

import pytest

from arbora.llm import warc
from arbora.llm._spark import shared_dir

BODY = b"<html>\xc3\xa4</html>"
SHA = hashlib.sha256(BODY).hexdigest()


def stated(name, base, label=None):
    d = hashlib.new(name, BODY).digest()
    return f"{label or name}:{d.hex() if base == 16 else base64.b32encode(d).decode()}"


@pytest.mark.parametrize("digest, holds", [
    (stated("sha1", 32), True), (stated("sha1", 32).lower(), True), (stated("sha1", 16, "SHA-1"), True), (stated("md5", 16), True), (stated("md5", 32).rstrip("="), True),
    (stated("sha256", 16), True), (stated("sha256", 32), True), (SHA, True), (SHA.upper(), True), ("blake9:whatever", True), (None, True),
    ("sha1:" + "A" * 32, False), ("sha256:" + "0" * 64, False), (stated("md5", 16).replace("md5", "sha1"), False), ("0" * 64, False),
])
def test_digests_by_their_algorithm(spark, digest, holds):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + BODY
    record = warc.header([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", digest), ("Content-Length", len(http))]) + http + b"\r\n\r\n"
    path = shared_dir(spark, "foreign")
    spark.createDataFrame([(bytearray(record),)], "b binary").selectExpr("cast(b as string) as value").write.option("lineSep", "\r\n").text(path)
    row = warc.decode_payloads(warc.reassemble(warc.read_records(spark, path)), keep_payload=True).first()
    assert row["problem"] == (None if holds else "the payload's digest does not hold")
    if holds:
        assert bytes(row["payload"]) == BODY and row["payload_digest"] == SHA and row["payload_bytes"] == len(BODY)


def test_revisits_keep_a_foreign_digest(spark):
    path = shared_dir(spark, "foreign")
    records = [warc.header([("WARC-Type", "revisit"), ("WARC-Payload-Digest", d), ("Content-Length", 0)]) + b"\r\n\r\n" for d in (stated("sha1", 32), stated("sha256", 16))]
    spark.createDataFrame([(r.decode(),) for r in records], "value string").write.option("lineSep", "\r\n").text(path)
    rows = warc.decode_payloads(warc.reassemble(warc.read_records(spark, path))).collect()
    assert {r["payload_digest"] for r in rows} == {stated("sha1", 32), SHA} and not any(r["problem"] for r in rows)
