"""WARC archives: writing, normalising and reading.

Pages are written as records of archives that are each one gzip stream. The normaliser inflates such a file once, as a
stream, writes every record as a gzip member of its own, and notes the members' offsets in an index file beside it, so
that any record can be read without those before it. Reading goes by that index.

Of pages with equal payloads of at least ``SMALL`` bytes, the one with the smallest id is a response; the others are
revisits of it: records without the payload whose HTTP head and digest still describe it. A null payload is empty.
A page whose id equals the smallest one is a response too, so repeated rows give repeated responses, and what a row is
goes by its id and its payload together: a row that repeats an id with a payload of its own keeps it. Pages without an id
are written as responses and read back without one. Line feeds in an address are escaped. An empty table gives no file.

Tasks write files under names of their own attempt; only those that Spark has committed to a table are read on.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import sized, table, work_path, written

SMALL = 100
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(text: str) -> int | None:
    number = text.strip().removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, its payload in an HTTP response; a revisit keeps the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """Fields of a record's or response's head, names in lower case."""
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def split_records(blocks):
    """Records of an inflated stream that comes in blocks of any size."""
    held = bytearray()
    need = None
    for block in blocks:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(fields_of(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("a record is cut off")


def inflated(stream, size: int = 1 << 20):
    """Blocks of a gzip stream of one or more members."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if block := unzip.decompress(data):
                yield block
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def normalise_file(source: str, target: str, level: int = 4) -> int:
    """Rewrites an archive with one gzip member for each record, and writes ``target``.idx: a line for each record
    with its offset, its length in the file, and its record id. Returns the number of records."""
    (fs, path), (to_fs, to_path) = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target)
    index, at = [], 0
    with fs.open_input_stream(path, compression=None) as raw, to_fs.open_output_stream(to_path, compression=None) as out:
        for whole in split_records(inflated(raw)):
            member = zlib.compress(whole, level, wbits=31)
            out.write(member)
            index.append(f"{at}\t{len(member)}\t{fields_of(whole[: whole.index(b'\r\n\r\n')])['warc-record-id']}")
            at += len(member)
    with to_fs.open_output_stream(f"{to_path}.idx", compression=None) as out:
        out.write("".join(f"{x}\n" for x in index).encode())
    return len(index)


def read_record(archive, at: int, length: int) -> tuple:
    """A record by its place: the columns of ``RECORDS``; a revisit's payload is null."""
    archive.seek(at)
    whole = zlib.decompress(archive.read(length), wbits=31)
    head, _, body = whole.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = body[: int(fields["content-length"])].partition(b"\r\n\r\n")
    full = int(fields_of(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    url = fields.get("warc-target-uri")
    url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    refers = page_of(fields["warc-refers-to"]) if revisit else None
    return page_of(fields["warc-record-id"]), full, digest, fields["warc-type"], refers, url, None if revisit else payload


def _digest(html_col: str):
    """SHA-256 of a payload that may be revisited; null for smaller ones."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return F.when(F.octet_length(payload) >= SMALL, F.unhex(F.sha2(payload, 256)))


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (page_id, digest, refers_to) of the pages that repeat another's payload. Only digests are shuffled; each
    digest's smallest id is found before and after the shuffle, and the digests on more than one page are broadcast where
    they are few enough; beyond, Spark joins by shuffle and splits skewed digests."""
    light = pages.select(F.col(id_col).cast("long").alias("page_id"), _digest(html_col).alias("digest")).filter("digest is not null")
    light = written(light, "payload-digests")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "first-pages")
    return light.join(sized(first, first.count()), "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """Writes every page as a record; each task's archive is one gzip stream. Returns the table of files."""
    spark = pages.sparkSession
    uri = work_path(spark, "warc")
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    repeated = written(revisits(pages, id_col, html_col), "revisits")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), _digest(html_col).alias("digest"))
    own = own.join(sized(repeated, repeated.count()), ["page_id", "digest"], "left").drop("digest")

    def write(batches):
        context = TaskContext.get()
        name = f"{uri}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n, zipped = None, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            if out is None and batch.num_rows:
                to, to_path = pafs.FileSystem.from_uri(name)
                out = to.open_output_stream(to_path, compression=None)
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out.write(zipped.compress(record(page_id, url, (html or "").encode(), refers_to)))
                n += 1
        if out is not None:
            out.write(zipped.flush())
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return written(own.mapInArrow(write, "path string, records long"), "warc-files")


def dealt(files: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of files with a partition for each file (of at most ``most``): its rows are few and small, and Spark would
    put them in one task if it went by their size."""
    return files.repartition(min(most, max(1, files.count())))


def normalise(files: DataFrame, level: int = 4, drop_source: bool = False) -> DataFrame:
    """Normalises every archive of a table of files; returns the table of new files. ``drop_source`` removes the
    old files once all new ones are there."""

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for source in batch.column("path").to_pylist():
                target = f"{source.removesuffix('.warc.gz')}-by-record-{attempt}.warc.gz"
                n = normalise_file(source, target, level)
                yield pa.record_batch([pa.array([target]), pa.array([n], pa.int64())], ["path", "records"])

    new = written(dealt(files).mapInArrow(run, "path string, records long"), "warc-normalised")
    if drop_source:

        def remove(batches):
            for batch in batches:
                for source in batch.column("path").to_pylist():
                    fs, path = pafs.FileSystem.from_uri(source)
                    if fs.get_file_info(path).type != pafs.FileType.NotFound:
                        fs.delete_file(path)
                yield batch.slice(0, 0)

        dealt(files).mapInArrow(remove, "path string, records long").count()
    return new


def read_archives(files: DataFrame) -> DataFrame:
    """All records of normalised archives, by their index files."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                fs, path = pafs.FileSystem.from_uri(source)
                rows, size = [], 0
                with fs.open_input_file(path) as archive, fs.open_input_stream(f"{path}.idx", compression=None) as index:
                    for line in index.read().decode().splitlines():
                        at, length, _ = line.split("\t")
                        rows.append(read_record(archive, int(at), int(length)))
                        size += rows[-1][1]
                        if size > 8_000_000 or len(rows) >= 5_000:
                            yield as_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt(files).mapInArrow(run, RECORDS)


def op7_warc(spark, sf_dir):
    files = normalise(write_archives(table(spark, sf_dir, "pages")), drop_source=True)
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
