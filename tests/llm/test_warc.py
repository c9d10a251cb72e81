import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from loglantern.llm import warc
from loglantern.sources.shared import new_dir


def expected(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        response = len(body) < least or page_id == first.get(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "response" if response else "revisit", None if response else first.get(body)))
    return sorted(out, key=str)


def test_small_tables(spark, sf_dir):
    rows = [tuple(r) for r in warc.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = warc.query(spark, sf_dir).drop("target_uri").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


ROWS = [
    (3, "http://a/", "<p>same</p>"), (1, "http://b/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"),
    (4, "u", None), (5, "u", ""), (6, "http://é/ ü", "é🙂\r\n\r\nWARC/1.1\r\n\r\n" * 3), (7, "u", "x" * 300_000), (None, "u", "<p>same</p>"), (None, "u", "alone"),
]


@pytest.mark.parametrize("least", [0, 20])
def test_odd_pages(spark, least):
    frame = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "page_id long, url string, html string, n_bytes long, URL string")
    path = new_dir(spark, "warc")
    warc.write_archives(frame, path, least)
    got = warc.read_archives(spark, path).collect()
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    want = [w if w[0] is not None or w[2] != expected([(0, "", "alone")])[0][2] else (None, w[1], w[2], "response", None) for w in expected(ROWS, least)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest)


def test_no_pages(spark):
    path = new_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def frames(n=50):
    import zstandard

    pages = [warc.make_record(i, "http://a/", f"<p>{i}</p>" * 40, hashlib.sha1((f"<p>{i}</p>" * 40).encode()).hexdigest(), len(f"<p>{i}</p>" * 40), i, True, "2024-01-01T00:00:00Z") for i in range(n)]
    trained = zstandard.train_dictionary(2000, pages)
    encoder = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    return trained.as_bytes(), [encoder.compress(p) for p in pages]


def test_frames_and_what_breaks_them():
    dictionary, made = frames()
    lead = warc.dictionary_frame(dictionary)
    empty = warc.EMPTY_FRAME.encode()
    whole = lead + empty + empty.join(made) + empty
    assert [warc.read_record(r)[0] for r in warc.read_frames(whole)] == list(range(50))
    for broken in (
        whole[:-30],  # cut short
        whole + b"xx",
        b"".join(made),  # no dictionary
        made[0] + lead,  # dictionary not at the start
        lead + made[0][:-2] + b"\x00\x00",  # wrong checksum
        lead + b"\x00" * 12,
    ):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_frames(broken))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/0.9"), (b"<p>1</p>", b"<p>2</p>"), (b"Content-Length: ", b"Content-Length: 1"), (b"\r\n\r\n", b"\r\n")])
def test_records_are_checked(old, new):
    body = "<p>1</p>"
    record = warc.make_record(1, "u", body, hashlib.sha1(body.encode()).hexdigest(), len(body), 1, True, "2024-01-01T00:00:00Z")
    assert warc.read_record(record)[0] == 1
    with pytest.raises((warc.BrokenArchive, KeyError, ValueError)):
        warc.read_record(record.replace(old, new))
