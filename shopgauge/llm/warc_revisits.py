"""WARC archives in which equal payloads are stored once.

Headers (id, length, digest) are shuffled by payload digest, never the payloads: the largest id of a digest is the
original response, all others revisit it. The decisions go back to the records by id and digest, which no hot payload
can gather in one place, and the archives are written with fresh headers; a revisit refers to the record that holds its
payload. Archives are text files below shared storage, written by Spark's own writer: a record is its header and block,
and the writer's line separator is the blank line that ends each record. They are read back by walking from record to
record by Content-Length, so a payload may hold anything, also what looks like a header.

Nulls: a null payload is empty; a null url is written as an empty target. A null id comes before every id. Rows that
share the largest id and the payload are all responses. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopgauge.session import materialize, scratch_path

#: Fixed values of the format.
_END, _VERSION = "\r\n\r\n", "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file at most, and bytes of their payloads: records are written by size, the larger the fewer to
#: a file; only a record that is larger by itself makes a larger file.
RECORDS_PER_FILE, BYTES_PER_FILE = 4096, 1 << 28
_CHUNK = 1 << 20


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 text: each five hex digits are four base32 digits."""
    digits = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def headers(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest of records (page_id, url, html), written once."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return materialize(
        records.select(
            F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(html).cast("long").alias("payload_bytes"),
            base32_sha1(html).alias("payload_digest"),
        ),
        "warc-headers",
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url) of every revisit, each once.

    Payloads of fewer than ``min_bytes`` bytes are not resolved. One row per digest comes from each task.
    """
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1")
    # A third of all headers may share a digest; adaptive execution splits such a key, and headers are small.
    revisits = large.join(originals, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    pairs = materialize(revisits.select("page_id", "payload_digest", "refers_to").distinct(), "warc-revisits")
    targets = heads.select(F.col("page_id").alias("refers_to"), "payload_digest", F.coalesce("url", F.lit("")).alias("refers_url"))
    wanted = materialize(targets.join(pairs.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"])
                         .groupBy("refers_to", "payload_digest").agg(F.min("refers_url").alias("refers_url")), "warc-originals")
    return pairs.join(wanted, ["refers_to", "payload_digest"], "left")


def _record_id(page_id: Column, payload_digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), payload_digest, F.lit(">"))


def write_archives(records: DataFrame, revisits: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write one record per row: a response with its payload, or a revisit with the response's headers only."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = records.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"),
        html.alias("html"), base32_sha1(html).alias("payload_digest"),
    )
    linked = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to", "refers_url", F.lit(True).alias("_revisit"))
    joined = rows.join(linked, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_revisit").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"), F.lit(_END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    only = [
        ("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))),
        ("WARC-Refers-To-Target-URI", F.regexp_replace("refers_url", r"[\r\n]+", " ")),
        ("WARC-Profile", F.lit(_PROFILE)),
    ]
    lines = [F.lit(_VERSION)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.when(revisit, F.concat(F.lit(f"{name}: "), value)) for name, value in only]  # concat_ws skips nulls
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)
    written = joined.select(record.alias("value"), F.when(revisit, 0).otherwise(F.octet_length("html")).alias("bytes"))
    largest = records.agg(F.max(F.octet_length("html"))).first()[0] or 0
    above, most, number = -1, RECORDS_PER_FILE, 0
    while above < largest or number == 0:
        upto = bytes_per_file // most if most > 1 else max(largest, 0)
        (
            written.where((F.col("bytes") > above) & (F.col("bytes") <= upto)).select("value").write.option("lineSep", _END)
            .option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/size={number}")
        )
        above, most, number = upto, max(1, most // 16), number + 1


def records_of(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a compressed archive, a piece of the file at a time.

    An archive may be one compressed member or many, one for each record, say.
    """
    unzip, pending, at = zlib.decompressobj(31), b"", 0

    def more() -> bool:
        nonlocal unzip, pending, at
        if at >= len(packed):
            if not unzip.eof and packed:
                raise ValueError("an archive ends within a compressed member")
            return False
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        piece = packed[at : at + _CHUNK]
        pending += unzip.decompress(piece)
        at += len(piece) - len(unzip.unused_data)
        return True

    end = _END.encode()
    while pending or more():
        while (head := pending.find(end)) < 0:
            if not more():
                if pending.strip():
                    raise ValueError("an archive ends within a record's header")
                return
        lines = pending[:head].decode().split("\r\n")
        if lines[0] != _VERSION:
            raise ValueError(f"a record starts with {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = head + len(end)
        stop = begin + int(fields["Content-Length"])
        parts, have = [pending], len(pending)
        while have < stop + len(end):
            pending = b""
            if not more():
                raise ValueError("an archive ends within a record's block")
            parts.append(pending)
            have += len(pending)
        pending = b"".join(parts)
        yield fields, pending[begin:stop]
        pending = pending[stop + len(end) :]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    end = _END.encode()
    for batch in batches:
        for packed in batch["content"]:
            rows = []
            for fields, block in records_of(packed):
                head, payload = block.split(end, 1)
                declared = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its headers")
                ids = [fields.get(k, "").removeprefix("<urn:page:").split(":")[0] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                page, refers = (int(i) if i not in ("", "none") else None for i in ids)
                rows.append((page, declared, digest, kind, refers, fields["WARC-Target-URI"]))
            frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, payloads checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    )


def deduplicated_archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, resolve(headers(pages), min_bytes), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
