"""Web archive records in ZIP packages: written by partitions, found by directories and indexes, read by ranges."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import join_counted, partitions_of, sieve, text_of
from lexivec.sources.folders import materialize, new_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads under this many bytes are never revisits.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins another package.
PACKAGE_BYTES = 64 << 20
#: Records carry this date: pages have none.
DATE = "1970-01-01T00:00:00Z"


def open_fs(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# Writing


def classify(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, payload_bytes and refers_to, the page that a revisit repeats.

    Of payloads of LEAST_BYTES or more that are equal, the smallest page_id has the response; rows that repeat that id
    are responses too. A null page_id is never smallest; where all are null all are responses. A null page is empty."""
    keyed = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("bigint"))
    slim = keyed.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= LEAST_BYTES)
    again = materialize(slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1"))
    # Only pages that may repeat another are joined; the others stay where they are.
    maybe, single = sieve(keyed, F.xxhash64("payload_digest"), again.select(F.xxhash64("payload_digest").alias("key")))
    joined = join_counted(maybe, again, "payload_digest", "k", int(again.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    columns = [*keyed.columns, "refers_to"]
    return joined.withColumn("refers_to", refers).select(*columns).unionByName(single.withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType)).select(*columns))


def name_of(page_id: str | None) -> str:
    """The name of a page's record; ids are escaped, and a null id is no page."""
    return "<urn:nil>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def record(page_id: str | None, url: str | None, html: str, digest: str, refers_to: str | None) -> bytes:
    """One record, compressed by itself. A revisit keeps the HTTP head, and so the payload's length, without the payload."""
    payload = html.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 1, mtime=0)


class Package:
    """A ZIP file that is written front to back: the records as one stored member, then their index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = open_fs(self.path)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page_id, data: bytes) -> None:
        self.data.write(data)
        self.index.append(json.dumps({"page": page_id, "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index), self.size


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(path, records, bytes) of the packages that hold a record for each row of pages (page_id, url, html).

    Each attempt of a task writes files with names of its own, and only those of attempts that ended are in the result,
    which is written before it is used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for pdf in batches:
            for page_id, refers_to, url, html, digest in pdf.itertuples(index=False, name=None):
                package = package or Package(folder)
                package.add(page_id, record(page_id, url, html, digest, refers_to))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    rows = classify(pages).select(F.col("page_id").cast("string").alias("page_id"), F.col("refers_to").cast("string").alias("refers_to"), "url", "html", "payload_digest")
    return materialize(rows.mapInPandas(run, "path string, records bigint, bytes bigint"))


# Reading


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ZipReader:
    """Members of a ZIP file by its directories, and ranges of stored members; reads only the ranges it needs."""

    END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, source):
        self.source = source
        self.length = source.size()

    def range(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {offset} are not all there")
        return data

    def directory(self) -> tuple[int, int, int]:
        """(entries, size, offset) of the central directory, from the ZIP64 end record where there is one."""
        size = min(self.length, 22 + 65_535)
        tail = self.range(self.length - size, size)
        at = tail.rfind(self.END)
        while at >= 0 and (at + 22 > size or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != size):
            at = tail.rfind(self.END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        where = self.length - size + at - 20
        if where >= 0 and (locator := self.range(where, 20))[:4] == self.LOCATOR:
            end64 = self.range(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != self.END64:
                raise ValueError("no ZIP64 end of central directory")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
        return entries, length, offset

    def members(self) -> dict[str, Member]:
        entries, length, offset = self.directory()
        data, at, out = self.range(offset, length), 0, {}
        for _ in range(entries):
            if data[at : at + 4] != self.ENTRY:
                raise ValueError(f"no directory entry at {offset + at}")
            method = struct.unpack_from("<H", data, at + 10)[0]
            packed, size, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode()
            x, stop = at + 46 + n, at + 46 + n + extra
            while x + 4 <= stop:
                tag, m = struct.unpack_from("<HH", data, x)
                if tag == 1:  # the 64-bit values of those fields that are all ones, in this order
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", data, x + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                x += 4 + m
            out[name] = Member(name, method, size, header)
            at = stop + comment
        return out

    def place(self, member: Member) -> int:
        """Where the data of a stored member begins."""
        if member.method:
            raise ValueError(f"{member.name} is compressed")
        local = self.range(member.header, 30)
        if local[:4] != self.LOCAL:
            raise ValueError(f"no local header of {member.name}")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def read_record(data: bytes) -> dict:
    """Headers, page_id, record_type, refers_to, payload_bytes, payload_digest and payload of one compressed record."""
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = block[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> str | None:
        found = re.fullmatch(r"<urn:page:(.*)>", headers.get(name, ""))
        return unquote(found[1]) if found else None

    if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    return {
        "page_id": page("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"], "refers_to": page("WARC-Refers-To"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def index_packages(packages: DataFrame) -> DataFrame:
    """(path, offset, length) in the file of every record of the packages (path)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    reader = ZipReader(source)
                    members = reader.members()
                    base, index = reader.place(members[DATA]), members[INDEX]
                    lines = reader.range(reader.place(index), index.size).decode().split("\n")
                rows = [json.loads(x) for x in lines if x]
                yield pd.DataFrame({"path": path, "offset": [base + r["offset"] for r in rows], "length": [r["length"] for r in rows]})

    return packages.select("path").mapInPandas(run, "path string, offset bigint, length bigint")


def read_records(places: DataFrame, payload: bool = False, id_type: str = "bigint") -> DataFrame:
    """Every record of places (path, offset, length), each read as a range of its package; with its payload if asked for.

    Ids are cast to id_type; a package says nothing of their type."""
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payload]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, part in pdf.groupby("path", sort=False):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    reader = ZipReader(source)
                    out += [read_record(reader.range(o, n)) for o, n in zip(part["offset"].tolist(), part["length"].tolist(), strict=True)]
            yield pd.DataFrame({c: [r[c] for r in out] for c in columns})

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payload
    dealt = places.repartition(partitions_of(places))
    ids = {c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}
    return dealt.mapInPandas(run, schema).withColumns(ids)


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits whose response is not there, or has another digest."""
    said = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return records.where("record_type = 'revisit'").join(said, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """pages written into packages in the shared folder and read back. An empty table writes nothing."""
    packages = write_packages(pages, new_folder(pages.sparkSession, "packages"))
    return read_records(index_packages(packages), payload, pages.schema["page_id"].dataType.simpleString())
