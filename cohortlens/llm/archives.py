"""WARC archives with revisit records: one payload of each group of equal ones is stored, the others refer to it.

Headers alone are shuffled by payload digest, which gives each digest its original: the response with
the largest key. Records join their original (a digest held by more than a thousandth of all rows is
met by broadcast, and there are fewer than a thousand of those; the rest meet in a shuffle whose
groups are bounded by that share). Each row then becomes one record with fresh headers, built from
column expressions and written by Spark's text sink with the record separator as line end, so task
retries and remote folders are Spark's business.

Reading takes the files as binary, unpacks them as a stream and cuts records by their Content-Length,
so a payload may hold anything, record separators included. A worker holds one archive file as
stored and, where payloads are asked for, one record unpacked.

Equal payloads are those of equal SHA-1 and length. Payloads are texts in UTF-8; a null payload
counts as empty. Rows alike in key and payload are all responses where theirs is the largest key. A
null key counts as smaller than any other; its record has no key header and reads back as null.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm.common import pa_schema
from cohortlens.session import discard, materialize, scratch_path

#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
_BREAK = "\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A digest with more than this share of the rows meets its original by broadcast.
HEAVY_SHARE = 1000
_CHUNK = 1 << 20


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a text in base32: eight characters for every five bytes."""
    digest = F.sha1(F.coalesce(text, F.lit("")).cast("binary"))
    out = []
    for part in range(4):
        five = F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("bigint")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(five, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*out)


def join_originals(rows: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """Append ``original`` to every row by its digest, null where there is none. ``n``: number of rows behind ``firsts``."""
    heavy = firsts.where(F.col("copies") > max(n // HEAVY_SHARE, 1)).select("digest", F.col("original").alias("_near"))
    light = firsts.where(F.col("copies") <= max(n // HEAVY_SHARE, 1)).select("digest", F.col("original").alias("_far"))
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    # rows of heavy digests stay where they are
    near = marked.where("_near IS NOT NULL").withColumnRenamed("_near", "original")
    far = marked.where("_near IS NULL").drop("_near").join(light, "digest", "left").withColumnRenamed("_far", "original")
    return near.unionByName(far)


def _line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null; line breaks in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(_BREAK)), F.lit(""))


def _record_id(key: Column, digest: Column) -> Column:
    """A name-based id of key and payload, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record_text(key: Column, url: Column, payload: Column, digest: Column, original: Column, is_revisit: Column, refers_to: Column,
                date: str) -> Column:
    """One whole record without the line breaks that end it. ``refers_to`` is the record id a revisit keeps without an original."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=UTF-8{_BREAK}"),
                    _line("Content-Length", F.octet_length(payload)), F.lit(_BREAK))
    block = F.when(is_revisit, http).otherwise(F.concat(http, payload))
    of = F.when(is_revisit, F.when(original.isNull(), refers_to).otherwise(_record_id(original["key"], digest)))
    return F.concat(
        F.lit(f"{VERSION}{_BREAK}"),
        _line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(key, digest)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line(KEY_HEADER, key),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("WARC-Refers-To", of),
        _line("WARC-Refers-To-Target-URI", F.when(is_revisit, original["url"])),
        _line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(_BREAK), block)


def write_archives(rows: DataFrame, path: str, key_col: str, url_col: str, payload_col: str, least_bytes: int = 0, **how: str) -> None:
    """Write one record a row below ``path``: a response for the largest key of each payload, revisits for its other keys.

    Payloads below ``least_bytes`` are responses always. Files are as large as the partitions they
    come from. The source is read twice: for headers alone, and with the payloads.
    """
    facts = rows.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    _write(facts.withColumns({"digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("bigint"),
                              "refers_to_id": F.lit(None).cast("string")}), path, least_bytes, **how)


def _write(facts: DataFrame, path: str, least_bytes: int, date: str = "2000-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Records of ``facts``, whose payload is null where the row was a revisit already."""
    stored = F.col("payload").isNotNull()
    may_serve = F.when(stored & (F.col("payload_bytes") >= least_bytes), F.struct("key", "url"))
    counted = materialize(facts.groupBy("digest").agg(F.max(may_serve).alias("original"), F.count(F.lit(1)).alias("copies")))
    n = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # a payload of one row has nothing to refer to
    joined = join_originals(facts, counted.where("copies > 1 AND original IS NOT NULL"), n)
    own = F.col("key").eqNullSafe(F.col("original")["key"]) | (F.col("payload_bytes") < least_bytes) | F.col("original").isNull()
    text = record_text(F.col("key"), F.col("url"), F.coalesce("payload", F.lit("")), F.col("digest"), F.col("original"),
                       ~(stored & own), F.col("refers_to_id"), date)
    joined.select(text.alias("value")).write.text(path, compression=compression, lineSep=_BREAK * 2)
    discard(counted)


class _Records:
    """Records of one archive, cut from its stored bytes as a stream."""

    def __init__(self, stored: bytes, zipped: bool) -> None:
        self.view, self.at, self.buffer = memoryview(stored), 0, bytearray()
        self.unzip = zlib.decompressobj(31) if zipped else None

    def _more(self) -> bool:
        if self.unzip and self.unzip.eof:  # archives may hold one member a record
            self.at -= len(self.unzip.unused_data)
            self.unzip = zlib.decompressobj(31)
        held = self.unzip.unconsumed_tail if self.unzip else b""
        if not held and self.at >= len(self.view):
            return False
        if not held:
            held = bytes(self.view[self.at: self.at + _CHUNK])
            self.at += len(held)
        self.buffer += self.unzip.decompress(held, 4 * _CHUNK) if self.unzip else held
        return True

    def _take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            seen = 0
            while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.buffer)
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("an archive ends inside a header")
                    return
            head = self._take(end + 4)[:end].decode("utf-8", "surrogateescape").lstrip("\r\n")
            if not head:  # line breaks that end the record before
                continue
            version, *lines = head.split(_BREAK)
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            yield fields, self._take(int(fields["content-length"]))


_SCHEMA = ("record_id string, record_type string, key string, url string, date string, digest string, payload_bytes bigint, "
           "refers_to_id string, stored_digest string")


def read_archives(spark: SparkSession, path: str | list[str], payloads: bool = False) -> DataFrame:
    """Records below ``path``: header fields, length and digest of the payload stored (null for revisits), and ``payload`` if asked for.

    ``digest`` is the one the header states, ``stored_digest`` is taken from the bytes.
    """
    schema = _SCHEMA + (", payload string" if payloads else "")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    empty = spark.createDataFrame([], schema)
    arrow = pa_schema(empty.schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, stored in zip(batch.column(0), batch.column(1)):
                for fields, block in _Records(stored.as_buffer(), str(name).endswith(".gz")):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    body = block[block.find(b"\r\n\r\n") + 4:] if kind == "response" else None
                    row = (fields.get("warc-record-id"), kind, fields.get(KEY_HEADER.lower()), fields.get("warc-target-uri"), fields.get("warc-date"),
                           fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if body is None else len(body),
                           fields.get("warc-refers-to"), None if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode())
                    rows.append(row + ((None if body is None else body.decode("utf-8", "replace"),) if payloads else ()))
                    size += 500 + (len(body or b"") if payloads else 0)
                    if size > 8 * _CHUNK:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``refers_to`` (the key of the response a revisit stands for) and the payload's length for all.

    Revisits meet responses by payload digest; of several responses with one digest the largest key
    counts. A revisit whose response is not among the records keeps nulls.
    """
    headers = records.drop("payload")
    responses = headers.where("record_type = 'response'").withColumn("digest", F.col("stored_digest"))
    best = F.max(F.struct(F.col("key"), F.col("payload_bytes").alias("bytes"))).alias("original")
    firsts = responses.groupBy("digest").agg(best)
    revisits = headers.where("record_type = 'revisit'")
    copies = materialize(revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")))
    n = copies.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    met = join_originals(revisits, firsts.join(copies, "digest"), n)
    nothing = F.lit(None).cast(records.schema["key"].dataType)
    return responses.withColumn("refers_to", nothing).unionByName(
        met.withColumns({"refers_to": F.col("original")["key"], "payload_bytes": F.col("original")["bytes"]}).drop("original"))


def deduplicate_archives(spark: SparkSession, path: str | list[str], out: str, least_bytes: int = 0, key_type: str = "bigint", **how: str) -> None:
    """Read archives, resolve their revisits by digest and write them anew: each payload once, with fresh headers.

    Originals are chosen anew among all responses, whichever file they are in. A revisit stays one,
    and refers to the new original; where its response is nowhere among them it keeps what it referred to.
    """
    records = read_archives(spark, path, payloads=True)
    _write(records.select(
        F.col("key").cast(key_type).alias("key"), "url", "payload", F.coalesce("stored_digest", "digest").alias("digest"),
        F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"), "refers_to_id"), out, least_bytes, **how)


def archive_round_trip(rows: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every row, from archives written and read back."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession)
    write_archives(rows, path, key_col, url_col, payload_col, least_bytes)
    kind = rows.schema[key_col].dataType
    records = materialize(read_archives(spark, path).withColumn("key", F.col("key").cast(kind)))
    return resolve_revisits(records).select(
        F.col("key").alias(key_col), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
