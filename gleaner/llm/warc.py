"""WARC records in ZIP packages: writing them, and reading them by range without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj``, both stored. The reader finds the central directory from the end of
the file, through the ZIP64 records where there are any, locates the stored members, reads
the index, and fetches runs of neighbouring records by byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import slices
from gleaner.session import cut_lineage, run_dir

#: Payloads from this size on are written once; equal ones become revisits.
MIN_REVISIT = 1000
#: A package is closed at this size, and records are fetched in runs of about this many bytes.
PACKAGE_BYTES = 32 << 20
RUN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_LINE = b"\r\n"


# records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed. A revisit keeps the HTTP head, whose length is that of the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8") + block + _LINE * 2, compresslevel=1, mtime=0)


def parse_record(data: bytes) -> dict:
    """Fields of one compressed record: type, ids, url, digest (hex), payload and its length."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(_LINE * 2)
    lines = head.split(_LINE)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_LINE * 2)
    length = next((int(x.split(b":")[1]) for x in http.split(_LINE) if x.lower().startswith(b"content-length:")), len(payload))
    name = lambda k: (fields[k].strip("<>").rpartition(":")[2] if k in fields else None)
    number = lambda x: int(x) if x is not None and x != "none" else None
    revisit = fields["warc-type"] == "revisit"
    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    if digest != stated or (not revisit and length != len(payload)):
        raise ValueError(f"record {fields['warc-record-id']} does not hold the payload it states")
    return {
        "page_id": number(name("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": number(name("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


# packages


class _Package:
    def __init__(self) -> None:
        self.data, self.lines = bytearray(), []

    def add(self, page_id: int | None, url: str | None, packed: bytes) -> None:
        entry = {"offset": str(len(self.data)), "length": str(len(packed)), "filename": DATA.rpartition("/")[2], "id": page_id}
        self.lines.append(f"{'-' if url is None else url.split()[0] if url.split() else '-'} 20240101000000 {json.dumps(entry)}\n")
        self.data += packed

    def write(self, folder: str) -> tuple[str, int, int]:
        """The package under a name of its own, so that a task tried twice harms nothing."""
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(DATA, bytes(self.data))
            z.writestr(INDEX, "".join(self.lines))
        store, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/{uuid.uuid4().hex}.wacz"
        with store.open_output_stream(path) as out:
            out.write(body.getbuffer())
        return f"{folder}/{path.rpartition('/')[2]}", len(self.lines), body.getbuffer().nbytes


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, refers_to, revisit`` rows; return the list ``path, records, bytes``.

    Only packages on the list count: what a lost task left behind is on no list.
    """
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, written = _Package(), []
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    payload = (row["html"] or "").encode("utf-8")
                    packed = record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                    package.add(row["page_id"], row["url"], packed)
                    if len(package.data) >= PACKAGE_BYTES:
                        written.append(package.write(folder))
                        package = _Package()
        if package.lines:
            written.append(package.write(folder))
        columns = list(zip(*written, strict=True)) or [()] * 3
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "records", "bytes"]
        )

    listed = records.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(
        run, "path string, records long, bytes long"
    )
    return cut_lineage(listed, "packages")


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that overflow taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + size], 0
            for n, value in enumerate(values):
                if value == 0xFFFFFFFF:
                    values[n] = struct.unpack_from("<Q", field, k)[0]
                    k += 8
            break
        at += 4 + size
    return values


def members(file: pa.NativeFile) -> dict[str, Member]:
    """The central directory, read from the end of the file."""
    total = file.size()
    tail_size = min(total, 22 + 0xFFFF)
    tail = file.read_at(tail_size, total - tail_size)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP package")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = file.read_at(20, total - tail_size + end - 20)
        if locator[:4] == b"PK\x06\x07":
            (record_at,) = struct.unpack_from("<Q", locator, 8)
            wide = file.read_at(56, record_at)
            count, size, start = struct.unpack_from("<QQQ", wide, 32)
    directory, at, found = file.read_at(size, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, header = _wide(extra, [plain, packed, header])
        found[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: it cannot be read by range")
    head = file.read_at(30, member.header)
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def index_runs(path: str) -> list[dict]:
    """Runs of neighbouring records of a package: ``begin, size, lengths``, by its indexes."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(base) as file:
        found = members(file)
        starts = {n.rpartition("/")[2]: data_start(file, m) for n, m in found.items() if n.startswith("archive/")}
        entries = []
        for name, member in found.items():
            if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")):
                text = file.read_at(member.size, data_start(file, member)).decode("utf-8")
                for line in text.split("\n"):
                    if "{" in line:
                        entry = json.loads(line[line.index("{") :])
                        entries.append((starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])))
    if starts and not entries:
        raise ValueError(f"{path} has no index")
    runs: list[dict] = []
    for begin, size in sorted(entries):
        last = runs[-1] if runs else None
        if last and begin == last["begin"] + last["size"] and last["size"] + size <= RUN_BYTES:
            last["size"] += size
            last["lengths"].append(size)
        else:
            runs.append({"begin": begin, "size": size, "lengths": [size]})
    return runs


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the listed packages: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, and ``payload`` (null in a revisit).

    Each payload is checked against its stated digest; a record that fails ends the job.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                runs = index_runs(path)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(runs), pa.string()),
                        pa.array([r["begin"] for r in runs], pa.int64()),
                        pa.array([r["size"] for r in runs], pa.int64()),
                        pa.array([r["lengths"] for r in runs], pa.list_(pa.int64())),
                    ],
                    ["path", "begin", "size", "lengths"],
                )

    runs = packages.select("path").mapInArrow(
        locate, "path string, begin long, size long, lengths array<long>"
    )
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    if with_payload:
        names, kinds, ddl = [*names, "payload"], [*kinds, pa.binary()], f"{ddl}, payload binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                store, base = pafs.FileSystem.from_uri(run["path"])
                with store.open_input_file(base) as file:
                    data = file.read_at(run["size"], run["begin"])
                rows, at = [], 0
                for size in run["lengths"]:
                    rows.append(parse_record(data[at : at + size]))
                    at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names
                )

    return runs.repartition("path", "begin").mapInArrow(fetch, ddl)


def as_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to, revisit`` of each page.

    Among equal payloads of MIN_REVISIT bytes or more the rows of the largest page_id are
    responses and the others revisit it. Without any id all are responses. Null html is an
    empty payload.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.length(body).alias("size")
    )
    repeated = (
        pages.filter(F.col("size") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
        .filter("n > 1 and latest is not null")
        .select("digest", "latest")
    )
    joined = pages.join(repeated.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select(
        "page_id", "url", "html", F.when(revisit, F.col("latest")).alias("refers_to"), revisit.alias("revisit")
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page to packages in the shared folder and list them."""
    return write_packages(as_records(pages), run_dir(pages.sparkSession, "archives"))
