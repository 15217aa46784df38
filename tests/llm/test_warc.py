import hashlib
import random

import numpy as np
import pytest

from tessera.llm import warc as W

PAGES = "page_id long, url string, html string, payload string, record_type string"


def brute(data):
    out = []
    top = {}
    for i, html in data:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    for i, html in data:
        b = (html or "").encode()
        t = top.get(b) if len(b) >= 1000 else None
        shared = sum((h or "").encode() == b for _, h in data) > 1
        revisit = shared and t is not None and i != t
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", t if revisit else None))
    return sorted(out, key=repr)


def pages(spark, data):
    return spark.createDataFrame([(i, "http://x/\r\nContent-Length: 3", h, "p", "r") for i, h in data], PAGES)


def test_round_trip_with_revisits_and_false_magic(spark):
    rng = random.Random(1)
    long = "é" * 600
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    data = [(k, rng.choice([long, trap, trap * 30, "", None, "x\n" * 700, f"own {k} " * 200, "\r\n\r\n", "WARC/1.1\r\n"])) for k in range(120)]
    data += [(None, long), (None, "short"), (7, data[7][1])]
    assert sorted(map(tuple, W.query(spark, pages(spark, data)).collect()), key=repr) == brute(data)


def test_payloads_and_empty_tables(spark, tmp_path):
    data = [(1, "<html>ß</html>"), (2, "y" * 2000), (3, "y" * 2000)]
    W.write(pages(spark, data), str(tmp_path / "a"))
    got = {r.page_id: bytes(r.payload).decode() for r in W.read(spark, str(tmp_path / "a")).collect()}
    assert got == {1: "<html>ß</html>", 2: "", 3: "y" * 2000}
    assert W.query(spark, pages(spark, [])).collect() == []


def record(payload):
    return W.MAGIC + b"WARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_chains_keep_only_what_is_reached(chunk):
    inner = record(b"inner")
    data = b"".join(record(p) for p in (b"", inner, inner + inner, W.MAGIC, b"z" * 100, inner[:-3]))
    at, after = W.candidates(data, chunk)
    assert len(at) > 6
    found = W.reachable(at, after, len(data))
    want, i = [], 0
    while i < len(data):
        want.append(i)
        i = int(after[np.searchsorted(at, i)])
    assert at[found].tolist() == want and len(want) == 6


def test_broken_chains_raise():
    data = record(b"a") + b"junk" + record(b"b")
    with pytest.raises(ValueError):
        W.reachable(*W.candidates(data), len(data))
    assert W.reachable(*W.candidates(b""), 0).tolist() == []


def test_files_are_bounded_by_bytes_and_records(spark, tmp_path):
    data = [(k, f"{k} " + "x" * n) for k, n in enumerate([10] * 50 + [3000] * 40 + [40_000] * 30 + [900_000] * 5)]
    W.write(pages(spark, data).coalesce(1), str(tmp_path / "a"), file_bytes=1 << 20)
    files = sorted(p.stat().st_size for p in (tmp_path / "a").rglob("part-*"))
    assert files[-1] < (1 << 20) + 16 * 400 and sum(f > 800_000 for f in files) == 5
    got = sorted((r.page_id, bytes(r.payload).decode()) for r in W.read(spark, str(tmp_path / "a")).collect())
    assert got == data
