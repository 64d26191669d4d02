import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from gleaner.llm import warc
from gleaner.session import run_dir


def plain(rows):
    latest = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and i is not None:
            latest[h] = max(latest.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = latest.get(h or "")
        refers = last if last is not None and i != last else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [
    (1, "http://a.example/x", "<p>é" * 400), (2, "http://a.example/y z", "<p>é" * 400), (9, None, "<p>é" * 400),
    (3, "", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "<p>é" * 400), (None, "u", "y" * 1500),
    (7, "u", "z" * 999), (8, "u", "z" * 999), (11, "u", "w" * 1000), (10, "u", "w" * 1000), (11, "u", "w" * 1000),
    (12, "http://b.example/", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100_000),
]


@pytest.mark.parametrize("run_bytes", [200, 4 << 20])
def test_round_trip(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    read = warc.read_packages(warc.archive_pages(pages(spark, ROWS))).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read]
    assert sorted(got, key=order) == sorted(plain(ROWS), key=order)
    for r in read:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert {r.url for r in read if r.page_id == 1} == {"http://a.example/x"}


def test_empty_table(spark):
    assert warc.read_packages(warc.archive_pages(pages(spark, []))).count() == 0


def test_files_of_lost_tasks_do_not_count(spark):
    folder = run_dir(spark, "archives")
    listed = warc.write_packages(warc.as_records(pages(spark, ROWS[:4])), folder)
    warc.write_packages(warc.as_records(pages(spark, ROWS[4:])), folder)
    assert warc.read_packages(listed).count() == 4


def package(tmp_path, compression=zipfile.ZIP_STORED, comment=b"", index=True):
    data = [warc.record(i, "u", b"x" * 10 * i, None, False) for i in range(5)]
    at, lines = 0, []
    for d in data:
        lines.append(f'u 20240101000000 {{"offset": "{at}", "length": "{len(d)}", "filename": "data.warc.gz"}}\n')
        at += len(d)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", compression) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr(warc.DATA, b"".join(data))
        if index:
            z.writestr(warc.INDEX, "".join(lines))
        z.comment = comment
    path = tmp_path / "one.wacz"
    path.write_bytes(body.getvalue())
    return str(path)


@pytest.mark.parametrize("limit", [None, 5])
def test_directories_of_both_kinds(spark, tmp_path, monkeypatch, limit):
    """With the limit at five bytes every size, offset and count goes into ZIP64 records."""
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = package(tmp_path, comment=b"a note")
    data = open(path, "rb").read()
    assert (b"PK\x06\x06" in data) == bool(limit)
    with pa.OSFile(path) as file:
        found = warc.members(file)
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                member = found[info.filename]
                assert file.read_at(member.size, warc.data_start(file, member)) == z.read(info.filename)
    rows = warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((r.page_id, len(r.payload)) for r in rows) == [(i, 10 * i) for i in range(5)]


def test_packages_that_cannot_be_read_by_range(tmp_path):
    with pytest.raises(ValueError, match="compressed"):
        warc.index_runs(package(tmp_path, zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="no index"):
        warc.index_runs(package(tmp_path, index=False))
    (tmp_path / "other").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.index_runs(str(tmp_path / "other"))


def test_a_broken_payload_is_found():
    data = warc.record(1, "u", b"x" * 50, None, False)
    import gzip

    broken = gzip.compress(gzip.decompress(data).replace(b"xxxxx", b"xxxxy", 1))
    with pytest.raises(ValueError, match="payload"):
        warc.parse_record(broken)
