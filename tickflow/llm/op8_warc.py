"""WARC archives: a writer that revisits equal payloads, and a sequential reader.

Every record is a gzip member of its own.  The reader streams an archive through an incremental
decompressor, cuts records by their content length, checks the digests of block and payload, and
raises on damage; it holds one record at a time.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest id is a response and
the others revisit it; a revisit has no payload but its length and digest.  Equal payloads are found by
digest on narrow rows; the pages are shuffled once, by their own ids.

A task writes its archive under a name of its own, and the manifest names only archives of tasks
that succeeded.

Defined cases: null html is the empty payload; a null id is always a response and stored as
``none``; rows that repeat the largest id and the payload are all responses; null urls leave the
target out; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import map_rows, table, written
from tickflow.llm.op4_records import open_folder
from tickflow.plans.session import scratch_path

LEAST = 1000
LEVEL = 6
CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """An archive whose framing or digests aren't right."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    value = urn.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit")]
    headers += [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers.append(("WARC-Payload-Digest", _digest(payload)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    http %= len(payload)
    if refers_to is None:
        block = http + payload
        headers.append(("Content-Type", "application/http; msgtype=response"))
    else:
        block = http
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
        headers.append(("Content-Type", "application/http; msgtype=response"))
    headers += [("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(source) -> Iterator[bytes]:
    """The content of each gzip member of a stream, decompressed chunk by chunk."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    started = False
    while True:
        data = rest or source.read(CHUNK)
        rest = b""
        if not data:
            break
        started = True
        try:
            out.append(unpack.decompress(data))
        except zlib.error as e:
            raise Damaged(f"compressed data: {e}") from e
        if unpack.eof:
            yield b"".join(out)
            rest = unpack.unused_data
            unpack, out, started = zlib.decompressobj(31), [], False
    if started:
        raise Damaged("the archive ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload block of a record, held against its length and digests."""
    head, found, rest = member.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    headers = dict(f.split(": ", 1) for f in fields)
    if not found or not version.startswith("WARC/"):
        raise Damaged("no record head")
    length = int(headers["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise Damaged("content length")
    if _digest(block) != headers["WARC-Block-Digest"]:
        raise Damaged("block digest")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and SHA-1 (hexadecimal) of the record's full payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(f.split(": ", 1) for f in http.decode().split("\r\n")[1:])
    length, digest = int(fields["Content-Length"]), headers["WARC-Payload-Digest"]
    if headers["WARC-Type"] == "response" and (len(payload) != length or _digest(payload) != digest):
        raise Damaged("payload digest")
    return length, base64.b32decode(digest.removeprefix("sha1:")).hex()


def write_archives(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes ``folder/archives`` and ``folder/manifest``; returns the manifest."""
    pages = df.select(
        df[id_col].cast("long").alias("page_id"),
        df[url_col].alias("url"),
        F.coalesce(df[html_col], F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    narrow = written(
        pages.where(F.octet_length("html") >= LEAST).select("page_id", "digest"), "digests"
    )
    firsts = narrow.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")
    )
    firsts = firsts.where("refers_to <> least").drop("least")
    again = narrow.join(firsts, "digest").where("page_id <> refers_to").distinct()
    dealt = pages.join(written(again, "revisits"), ["page_id", "digest"], "left")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(rows):
        name = f"archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, root = open_folder(folder)
        out, n = None, 0
        for page_id, url, html, refers_to in rows:
            if out is None:
                system.create_dir(f"{root}/archives", recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            payload = html.encode("utf-8", "surrogatepass")
            out.write(record(page_id, url, payload, refers_to, date))
            n += 1
        if out is not None:
            out.close()
            yield name, n

    manifest = map_rows(dealt.select("page_id", "url", "html", "refers_to"), run, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


_MANIFEST = "file string, records long"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives listed, one archive a task as far as there are tasks."""

    def run(rows):
        for name, expected in rows:
            system, root = open_folder(folder)
            n = 0
            with system.open_input_stream(f"{root}/{name}", compression=None) as source:
                for member in members(source):
                    headers, block = parse(member)
                    length, digest = payload_of(headers, block)
                    refers_to = headers.get("WARC-Refers-To")
                    n += 1
                    yield (
                        _page_of(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"],
                        None if refers_to is None else _page_of(refers_to),
                    )
            if n != expected:
                raise Damaged(f"{name}: {n} records of {expected}")

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long"
    )
    spread = manifest.repartition(
        max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "file"
    )
    return map_rows(spread, run, schema)


def query(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.m IS NULL OR p.page_id IS NULL OR f.m = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.m <> p.page_id THEN f.m END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 1000
"""
