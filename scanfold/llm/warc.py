"""WARC archives: written as monolithic gzip streams, normalised to one member a record, and read back by index.

A monolithic archive is one gzip member over all its records, which no reader can enter in the middle. The normaliser
inflates such a stream once, in bounded chunks, rewrites every record as a member of its own and writes a sidecar
index of (offset, length) lines, so that any record can be read alone from then on.

Tasks write and read archives through pyarrow's file systems, by the URI of the shared folder (file, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable
from .grouping import join_by_size

CHUNK = 1 << 20
#: Payloads below this many bytes are never replaced by revisits.
LEAST_REVISIT = 100
VERSION = b"WARC/1.1"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _write_file(uri: str):
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed WARC record; header values have their line breaks replaced by spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordSplitter:
    """Cuts an uncompressed WARC stream, fed in chunks, into records; holds one record at most."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        while True:
            at = self.buffer.find(b"\r\n\r\n")
            if at < 0:
                return
            size = next((int(x.split(b":", 1)[1]) for x in bytes(self.buffer[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            if size is None or not self.buffer.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            end = at + 4 + size + 4
            if len(self.buffer) < end:
                return
            yield bytes(self.buffer[:end])
            del self.buffer[:end]

    def close(self) -> None:
        if self.buffer:
            raise ValueError("the archive ends within a record")


def inflate(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, chunk by chunk. A stream that ends within a member is an error."""
    z, begun = zlib.decompressobj(31), False
    for data in stream:
        while data:
            begun = True
            yield z.decompress(data, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            data = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        yield z.flush()
        if not z.eof:
            raise EOFError("the gzip stream is cut off")


def normalise(source: str, target: str, index: str) -> int:
    """Rewrite the archive at ``source`` with one member a record at ``target`` and its offsets at ``index``."""
    system, path = _open(source)
    splitter, at, lines = RecordSplitter(), 0, io.StringIO()
    with system.open_input_stream(path, compression=None) as src, _write_file(target) as out:
        for part in inflate(iter(lambda: src.read(CHUNK), b"")):
            for record in splitter.feed(part):
                member = gzip.compress(record, 6, mtime=0)
                out.write(member)
                lines.write(f"{at}\t{len(member)}\n")
                at += len(member)
    splitter.close()
    with _write_file(index) as out:
        out.write(lines.getvalue().encode())
    return lines.getvalue().count("\n")


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record's member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def choose_records(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Pages (page_id, url if any, payload) with payload_digest, payload_bytes and refers_to (null for responses).

    Equal payloads are found by SHA-256. The least id of each is aggregated before its shuffle, so that one payload on
    a third of all pages is a small group.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.col("payload_bytes") >= LEAST_REVISIT
    least = base.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("least"), F.count("*").alias("same"))
    least = durable.write(least.where("same > 1"), "least")
    refers = F.when(F.col("page_id") != F.col("least"), F.col("least"))
    # payloads of digests on very many pages stay where they are
    out = join_by_size(base, least, "payload_digest", "same", base.count(), "left")
    return out.withColumn("refers_to", F.when(large, refers)).drop("least", "same")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, payload_bytes, payload_digest, refers_to) rows as one monolithic archive for each
    partition; returns their paths and numbers of records. A retried task writes a new file and names only that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, n, out, z = f"{folder}/mono/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for pdf in batches:
            if out is None and len(pdf):
                out = _write_file(uri)
            for r in pdf.itertuples(index=False):
                body = r.payload.encode("utf-8")
                revisit = not pd.isna(r.refers_to)
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{r.page_id}/{n}/{uri}')}>")]
                if r.url is not None:
                    headers.append(("WARC-Target-URI", r.url))
                if not pd.isna(r.page_id):
                    headers.append(("X-Page-ID", str(int(r.page_id))))
                headers += [("WARC-Payload-Digest", "sha256:" + r.payload_digest), ("X-Payload-Length", str(int(r.payload_bytes)))]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(int(r.refers_to)))]
                out.write(z.compress(record_bytes(headers, b"" if revisit else body)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"path": [uri], "records": [n]})

    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").withColumn("refers_to", F.col("refers_to").cast("string")).withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, "path string, records long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive; returns (path, index, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                name = f"{folder}/norm/{uuid.uuid4().hex}"
                n = normalise(path, f"{name}.warc.gz", f"{name}.idx")
                yield pd.DataFrame({"path": [f"{name}.warc.gz"], "index": [f"{name}.idx"], "records": [n]})

    return archives.mapInPandas(run, "path string, index string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, each member read at its indexed offset: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and block. A response's digest and length are taken from its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, index in zip(pdf["path"], pdf["index"], strict=True):
                system, at = _open(index)
                with system.open_input_stream(at, compression=None) as f:
                    spans = [tuple(map(int, x.split("\t"))) for x in f.read().decode().splitlines()]
                system, at = _open(path)
                rows = []
                held = 0
                with system.open_input_file(at) as f:
                    for offset, length in spans:
                        f.seek(offset)
                        h, block = read_record(f.read(length))
                        revisit = h["warc-type"] == "revisit"
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(h["x-payload-length"])):
                            raise ValueError(f"record at {offset} of {path} does not have its digest")
                        rows.append((h.get("x-page-id"), h.get("warc-target-uri"), int(h["x-payload-length"]), digest, h["warc-type"], h.get("x-refers-to-page-id"), block))
                        held += len(block)
                        if held > 8 * CHUNK:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    out = archives.select("path", "index").mapInPandas(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, block binary")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]).astype({"page_id": object, "refers_to": object})


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write pages as WARC archives in the shared folder, normalise them and return what their records hold.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and block, one row per page. A null
    payload is empty; a page with a null id is always a response, without page id. Rows that repeat the least id of a payload are all responses. Line breaks in a url
    become spaces. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = durable.new_path(spark, "warc")
    if "://" not in folder:
        folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") else "file://" + folder
    records = choose_records(pages, id_col, payload_col)
    mono = durable.write(write_archives(records, folder), "mono")
    paths = mono.repartition(max(1, mono.count()))
    norm = durable.write(normalise_archives(paths, folder), "norm")
    written, kept = (t.agg(F.sum("records")).first()[0] or 0 for t in (mono, norm))
    if written != kept:
        raise RuntimeError(f"{written} records were written and {kept} normalised")
    durable.delete(mono)
    durable.delete_path(spark, f"{folder}/mono")
    return read_archives(norm.repartition(max(1, norm.count())))

