"""WARC archives with one Zstandard frame per record and an embedded dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
follows as a frame of its own, so any one can be read alone from its offset. A payload that equals
one archived under a smaller id is written as a ``revisit`` without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.session import cut_lineage, run_path

#: Fixed values of the format: the skippable frame's magic number and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The dictionary is fitted on at most this many records, those that hash lowest, and bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 6
MANIFEST = "file string, records long, bytes long"


def open_fs(uri: str):
    """(file system, path) of a folder that all executors reach, by its URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not re.match(r"file:/[^/]", uri) else uri.replace("file:/", "file:///", 1))


def qualified(spark, folder: str) -> str:
    """``folder`` with the scheme and authority that Spark resolves it against, so that tasks open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value without control characters or other line breaks."""
    return re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(rec_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, ``response`` or (with ``refers_to``) ``revisit``; both hold the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{rec_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fit_dictionary(pages: DataFrame, id_col: str, payload_col: str, sample: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from a bounded sample of records; empty when there is too little to learn from.

    Rows whose hash lies below a cut that lets about twice ``sample`` of all rows through are
    ordered, so that tasks send the driver a few rows each and not ``sample`` rows each.
    """
    share = min(1.0, 2 * sample / max(pages.count(), 1))
    draw = F.pmod(F.xxhash64(id_col, payload_col), F.lit(1 << 32))
    rows = (
        pages.filter((F.length(payload_col) > 0) & (draw < int(share * (1 << 32))))
        .select(draw.alias("_h"), F.substring(payload_col, 1, SAMPLE_BYTES).alias("_p"))
        .orderBy("_h", "_p").limit(sample).collect()
    )
    parts = [record(str(k), None, bytes(r["_p"]), None) for k, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 0, folder: str | None = None,
) -> tuple[DataFrame, str]:
    """Write a record per row; returns (manifest of committed files, folder).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one of smallest id is
    the response (all rows that share that id are) and the others revisit it. A null html is an
    empty payload. A null id sorts first among equal payloads and is written as ``null``. Every task attempt writes a file of
    its own name, and only the manifest, which Spark commits, says which files count: a task that is
    lost or run twice leaves an unlisted file and no double record. Other columns are not read. The folder
    is one of the run folder unless named; it is returned as a full URI, a folder without a scheme
    taken as Spark takes it.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or run_path(spark)).rstrip("/")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    least = F.min(F.struct("id")).alias("first")
    first = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(least, F.count("*").alias("n"))
    joined = rows.join(first.filter("n > 1").select("digest", "first"), "digest", "left")
    own = F.struct("id").eqNullSafe(F.col("first"))
    named = joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "payload",
        F.when(F.col("first").isNotNull() & ~own, F.coalesce(F.col("first.id").cast("string"), F.lit("null"))).alias("refers_to"))
    dictionary = fit_dictionary(rows, "id", "payload")
    sent = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def write(batches):
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        kinds = {"dict_data": zstandard.ZstdCompressionDict(sent.value)} if sent.value else {}
        packer, out, count, name = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **kinds), None, 0, ""
        for rows in batches:
            for rec_id, url, payload, refers_to in rows.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)  # else the ending decides
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(sent.value)) + sent.value)
                out.write(packer.compress(record(rec_id, url, payload, refers_to)))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pd.DataFrame({"file": [name], "records": [count], "bytes": [size]})

    return cut_lineage(named.select("id", "url", "payload", "refers_to").mapInPandas(write, MANIFEST)), folder


def read_dictionary(stream) -> bytes:
    """The dictionary in the skippable frame at the head of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with a dictionary frame")
    return bytes(stream.read(size))


def records(stream, most: int = 1 << 31):
    """(headers, block) of each record of an open archive, one at a time."""
    dictionary = read_dictionary(stream)
    kinds = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    plain = io.BufferedReader(zstandard.ZstdDecompressor(**kinds).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        if size > most:
            raise ValueError(f"a record of {size} bytes")
        block = plain.read(size)
        if len(block) != size or plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


RECORD = ("page_id string, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to string, payload binary")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files in ``manifest``; ``payload`` is null for revisits (or for all).

    Files are dealt out to tasks; each is read as a stream. Digest and length of a response are
    those of the payload read, checked against its header; those of a revisit stand in its headers.
    """
    files = manifest.select("file").repartition(max(spark.sparkContext.defaultParallelism, 1), "file")

    def read(batches):
        fs, path = open_fs(folder)
        for names in batches:
            for name in names["file"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        if kind == "response" and (len(payload), payload_digest(payload)) != (length, digest):
                            raise ValueError(f"{name}: {headers['WARC-Record-ID']} differs from its digest")
                        urn = lambda h: headers[h][len("<urn:page:"):-1] if h in headers else None  # noqa: B023, E731
                        kept = payload if payloads and kind == "response" else None
                        rows.append((urn("WARC-Record-ID"), headers.get("WARC-Target-URI"), kind, length, digest, urn("WARC-Refers-To"), kept))
                        size += len(block)
                        if size > 1 << 24 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=_NAMES)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=_NAMES)

    return files.mapInPandas(read, RECORD)


_NAMES = [c.split()[0] for c in RECORD.split(", ")]
