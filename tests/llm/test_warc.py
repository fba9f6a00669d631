import gzip
import hashlib
from pathlib import Path

from condist.llm import warc
from condist.llm.scratch import shared_path

SCHEMA = "page_id long, url string, html string, size int"


def truth(pages):
    best = {}
    for p, html in pages:
        b = (html or "").encode()
        if len(b) >= 1000 and p is not None:
            best[b] = max(best.get(b, p), p)
    out = []
    for p, html in pages:
        b = (html or "").encode()
        k = best.get(b, p)
        revisit = len(b) >= 1000 and k != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=str)


def run(spark, pages, **options):
    df = spark.createDataFrame([(p, f"http://x/{p}" if p else None, h, 1) for p, h in pages], SCHEMA).repartition(3)
    path = shared_path(spark, "warc")
    warc.write(df, path, **options)
    return path, sorted(map(tuple, warc.page_records(warc.read(spark, path)).collect()), key=str)


def test_edges_round_trip(spark):
    long = "line\r\n" * 400
    pages = [(1, None), (2, ""), (3, "a\r"), (4, "\n\r\n"), (5, "\r\n" * 40), (6, long), (7, long), (8, long), (None, long), (9, "é" * 700), (10, "é" * 700), (11, "s" * 999), (12, "s" * 999), (13, "WARC/1.0\r\n\r\n0\r\n"), (7, long), (None, "x")]
    for size in (16, 48, 1 << 16):
        path, got = run(spark, pages, chunk_bytes=size)
        assert got == truth(pages)
    data = {}
    for r in sorted(warc.read(spark, path).where("record_type = 'response' and page_id is not null").collect(), key=lambda r: r.chunk_no):
        data[r.page_id] = data.get(r.page_id, b"") + r.data
        if r.final:
            assert hashlib.sha1(data[r.page_id]).hexdigest() == r.digest_so_far
    assert data[6 if 6 in data else 8] == long.encode() and data[4] == b"\n\r\n"


def test_archives_are_standard(spark):
    path, _ = run(spark, [(1, "abc" * 1000), (2, "abc" * 1000)], chunk_bytes=512)
    body = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path.removeprefix("file:")).glob("*.gz")))
    seen = []
    while body:
        head, _, rest = body.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n" and rest.startswith(b"HTTP/1.1 200 OK\r\n")
        seen.append(fields["WARC-Type"])
        body = rest[n + 4 :]
    assert sorted(seen) == ["response", "revisit"]


def test_whole_table_and_empty(spark):
    d = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, warc.op3_warc(spark, d).collect()), key=str) == truth(pages)
    assert run(spark, [])[1] == []
