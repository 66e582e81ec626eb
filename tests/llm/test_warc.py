"""Round trips of the archive, and what the salvage reader recovers from damaged files."""

import gzip
import hashlib
import random
import re
from base64 import b32encode

import pytest

from wattscope.llm import catalog, warc
from wattscope.llm.common import new_folder

PAGES = [(5, "http://a/1", "<p>same</p>", 1), (3, "http://a/2", "<p>same</p>", 1), (9, None, None, 1), (7, "http://é x/\r\n", "", 1),
         (11, "http://a/3", "été\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, 1), (None, "u", "<p>same</p>", 1),
         (None, "v", "alone", 1), (12, "w", "x" * 300_000, 1), (3, "http://a/2", "<p>same</p>", 1)]


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html, _ in rows:
        data, to = (html or "").encode(), first.get(html or "")
        revisit = to is not None and to != page
        out.append((page, len(data), b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, refers_to int")
    path = new_folder(spark, "warc-test")
    warc.write_archive(pages, path, compress=compress, file_bytes=200_000)
    back = warc.read_archive(spark, path)
    assert back.where("kind = 'gap'").count() == 0
    assert sorted(map(tuple, catalog.archived_pages(back).collect()), key=str) == expected(PAGES)
    kept = {r["record_id"]: bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert kept["urn:x-page:11"].decode() == PAGES[4][2] and kept["urn:x-page:9" if "urn:x-page:9" in kept else "urn:x-page:7"] == b""


def test_empty_table(spark):
    path = new_folder(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_standard_gzip_reads_the_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string, extra int")
    warc.write_archive(pages.coalesce(1), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC-Record-ID") == 5 and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def sample(compress, n=12):
    rng = random.Random(5)
    raw = [warc.record_bytes(k, f"http://x/{k}", rng.randbytes(rng.randrange(2000)), None, "2024-01-01T00:00:00Z") for k in range(n)]
    return [gzip.compress(x, mtime=0) + warc.NOTHING for x in raw] if compress else raw


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_the_damaged_records_only(compress):
    parts = sample(compress)
    for seed in range(60):
        rng = random.Random(seed)
        data, hit = bytearray(b"".join(parts)), set()
        starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        for _ in range(rng.randrange(1, 4)):
            at, n = rng.randrange(len(data)), rng.randrange(1, 40)
            for i in range(at, min(at + n, len(data))):
                data[i] ^= rng.randrange(1, 256)
            hit |= {k for k in range(len(parts)) if starts[k] < min(at + n, len(data)) and at < starts[k + 1]}
        rows = list(warc.salvage(bytes(data)))
        found = {r["record_id"].rpartition(":")[2] for r in rows if r["kind"] == "record"}
        assert {str(k) for k in set(range(len(parts))) - hit} <= found
        covered = sorted({(r["offset"], r["length"]) for r in rows})
        assert all(a[0] + a[1] <= b[0] for a, b in zip(covered, covered[1:], strict=False))
        gaps = sum(r["length"] for r in rows if r["kind"] == "gap")
        assert gaps or len([r for r in rows if r["kind"] == "record"]) == len(parts)


@pytest.mark.parametrize("compress", [True, False])
def test_cut_file_and_garbage(compress):
    parts = sample(compress, 4)
    rows = list(warc.salvage(b"junk\n" + b"".join(parts)[:-700]))
    assert (rows[0]["kind"], rows[0]["offset"], rows[0]["length"], rows[0]["reason"]) == ("gap", 0, 5, "no version line")
    assert rows[-1]["kind"] == "gap" and sum(r["kind"] == "record" for r in rows) in (2, 3)
    assert list(warc.salvage(b"")) == []


def test_wrong_length_and_digest():
    a, b, c = (warc.record_bytes(k, "u", b"payload %d" % k, None, "d") for k in range(3))
    rows = list(warc.salvage(a + b.replace(b"payload 1", b"PAYLOAD 1") + c))
    assert [r["kind"] for r in rows] == ["record", "gap", "record"] and rows[1]["reason"] == "block digest"
    rows = list(warc.salvage(a + b.replace(b"application/http", b"x", 1).replace(b"Content-Length: ", b"Content-Length: 9") + c))
    assert [r["kind"] for r in rows] == ["record", "gap", "record"]


def test_members_of_several_records():
    rng = random.Random(8)
    raw = [warc.record_bytes(k, "u", rng.randbytes(40_000), None, "d") for k in range(5)]
    bad = raw[1].replace(b"urn:x-page:1>", b"urn:x-page:1>\r\nX: y", 1)[:-5] + b"?\r\n\r\n"
    ids = lambda rows: [r["record_id"][-1] for r in rows if r["kind"] == "record"]
    whole = gzip.compress(raw[0] + bad + raw[2], mtime=0)
    rows = list(warc.salvage(b"junk\n" + whole + gzip.compress(raw[3], mtime=0)))
    assert [r["kind"] for r in rows] == ["gap", "record", "gap", "record", "record"] and ids(rows) == ["0", "2", "3"]
    assert (rows[2]["offset"], rows[2]["length"], rows[2]["reason"]) == (5, len(whole), "block digest")
    assert (rows[2]["inner_offset"], rows[2]["inner_length"]) == (len(raw[0]), len(bad))

    member = gzip.compress(b"".join(raw[:3]), mtime=0)
    wrong = member[:-8] + bytes(4) + member[-4:]
    rows = list(warc.salvage(wrong + gzip.compress(raw[3], mtime=0)))
    assert ids(rows) == ["0", "1", "2", "3"] and [r.get("reason") for r in rows] == ["damaged member"] * 4 + [None]
    rows = list(warc.salvage(gzip.compress(raw[4], mtime=0) + member[:-20_000]))
    assert ids(rows) == ["4", "0", "1"] and rows[-1]["kind"] == "gap" and rows[-1]["reason"] == "truncated member"
    # Without a digest nothing says that a record of a damaged member is right.
    plain = [re.sub(rb"WARC-(Payload|Block)-Digest: [^\r]*\r\n", b"", x) for x in raw[:2]]
    member = gzip.compress(b"".join(plain), mtime=0)
    assert ids(warc.salvage(member)) == ["0", "1"] and ids(warc.salvage(member[:-8] + bytes(8))) == []
    assert ids(warc.salvage(member[:-20_000])) == ["0"]
