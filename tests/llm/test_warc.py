import base64
import glob
import hashlib

import zstandard

from envlattice.llm import queries, warc


def brute(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    n = {}
    for _, _, h in rows:
        n[h or ""] = n.get(h or "", 0) + 1
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        again = n[h or ""] > 1 and h is not None and (h or "") in top and top[h or ""] != i or n[h or ""] > 1 and (h or "") in top and top[h or ""] != i
        out.append((i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None, None if again else p))
    return sorted(out, key=str)


def test_pages(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    found = sorted((tuple(r) for r in queries.op10_warc(spark, d).collect()), key=str)
    assert found == sorted(((i, n, g, t, to) for i, _, n, g, t, to, _ in brute(rows)), key=str)


def test_round_trip_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows = [(i, f"http://x/{i}?q=%41 é\r\nb", f"<p>{i % 40}</p>\r\n\r\n" * (i % 40)) for i in range(300)]
    rows += [(400, None, None), (401, "u", ""), (401, "u", ""), (None, "n", "only"), (None, "n", "<p>39</p>\r\n\r\n" * 39), (500, "big", "é" * 20_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, archive string")
    path = str(tmp_path / "out")
    warc.write_archives(pages, path)
    found = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=str)
    assert [(a, b, c, d, e, f, bytes(g) if g is not None else None) for a, b, c, d, e, f, g in found] == brute(rows)
    for name in glob.glob(f"{path}/archive=*/part-*"):  # any reader that is given the dictionary reads the rest
        data = open(name, "rb").read()
        assert data[:4] == warc.DICTIONARY_FRAME
        assert all(h["warc-type"] in ("response", "revisit") for h, _ in warc.records(data))


def test_frames_are_apart():
    some = [b"record %d " % i * 50 for i in range(400)]
    out = list(warc.frames(some[:200], iter(some[200:])))
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(out[0][8:]))
    assert len(out) == 401
    assert [zstandard.ZstdDecompressor(dict_data=known).decompress(f) for f in out[1:]] == some


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
