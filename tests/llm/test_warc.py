import base64
import gzip
import hashlib
import re
from collections import defaultdict

import pytest

from gradus.llm.warc import read_archives, resolve_revisits, write_archives

PAGES = [
    (1, "http://a", "a", 0),
    (2, None, "a", 0),
    (3, "x\r\nWARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nx\r\n", 0),
    (4, "u", None, 0),
    (5, "", "", 0),
    (6, "é", "é\U0001f642", 0),
    (7, "q", "é\U0001f642", 0),
    (8, "z", "  \n", 0),
    (9, "long", "p\r\n" * 50_000, 0),
    (10, "long", "p\r\n" * 50_000, 0),
]


def brute(rows, least):
    groups = defaultdict(list)
    for page, _, html, _ in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        keeper = max(groups[html or ""])
        again = keeper != page and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", keeper if again else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, least):
    path = str(tmp_path / "archives")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_digest int")
    write_archives(pages, path, least, records_per_archive=3)
    records = read_archives(spark, path)
    got = resolve_revisits(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert sorted(map(tuple, got.collect())) == brute(PAGES, least)
    payload = {r.page_id: r.payload for r in records.collect()}
    for page, _, html, _ in PAGES:
        assert payload[page] in (html or "", None)
    assert all(r.stated_digest == r.payload_digest for r in records.where("record_type = 'response'").collect())


def test_repeated_and_missing_ids(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "v", "x"), (None, None, None)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = resolve_revisits(read_archives(spark, path)).collect()
    found = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert found == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "archives")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


def test_every_record_has_its_mandatory_headers(spark, tmp_path):
    path = str(tmp_path / "archives")
    rows = [*PAGES, (1, "http://a", "a", 0), (None, "n", "a", 0), (None, "n", "a", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    write_archives(pages.coalesce(1), path, date="2024-05-01T00:00:00Z", archive_bytes=100_000)
    archives = list((tmp_path / "archives").glob("*.gz"))
    assert len(archives) > 1  # about four payloads of the mean size each
    ids, kinds = [], []
    for archive in archives:
        data = gzip.decompress(archive.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            size = int(fields["Content-Length"])
            block, data = data[:size], data[size:]
            assert version == "WARC/1.1" and fields["WARC-Date"] == "2024-05-01T00:00:00Z"
            assert fields["Content-Type"] == "application/http; msgtype=response"
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            ids.append(fields["WARC-Record-ID"])
            kinds.append(fields["WARC-Type"])
            if fields["WARC-Type"] == "response":
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
            else:
                assert fields["WARC-Profile"].endswith("identical-payload-digest") and not block
                assert fields["WARC-Refers-To-Date"] == "2024-05-01T00:00:00Z"
    assert len(ids) == len(rows) == len(set(ids))
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", x) for x in ids)
    assert kinds.count("revisit") > 3
