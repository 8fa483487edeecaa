import gzip
from hashlib import sha256

from tallymill.llm import warc

BIG = "<p>" + "x é\r\n\r\n" * 40 + "</p>"


def brute(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        revisit = b in first and page != first[b]
        out.append((page, len(b), sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example.org/x", BIG), (3, "https://www.b.org:8080/y?q=1#z", BIG), (9, None, BIG), (4, "u@h", None), (1, "http://a.example.org/x", "short"),
    (2, "http://a.example.org/x", "short"), (None, "http://n.org/\r\nX: y", BIG), (7, "http://c.org", BIG + "!"), (7, "http://c.org", BIG + "!"), (8, "http://c.org/é", BIG + "!"),
    (10, "http://z.org", "y" * 300000),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    for block in (512, 1, 2):
        index = warc.archive_pages(df, block=block)
        got = sorted((tuple(r) for r in warc.read_back(spark, index).collect()), key=str)
        assert got == brute(ROWS)
        reader = warc.Reader(index)
        for page, url, html in ROWS:
            r = reader.find(warc.capture_key(url), page)
            assert r.page_id == page and (r.kind == "revisit" or r.payload == (html or "").encode())
        assert reader.find("zzz", 1) is None and reader.find(warc.capture_key("http://c.org"), 99) is None
        assert [c[1] for c in reader.captures(warc.capture_key("http://a.example.org/x"))] == [1, 2, 5]


def test_archives_are_gzip_members(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(df, folder=str(tmp_path / "w"))
    whole = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_keys():
    assert warc.capture_key("https://user@Blog.Example.com/en/7?x#t") == "com,example,blog)/en/7?x#t"
    assert warc.capture_key("http://a.org:81") == "org,a:81)"
    assert warc.capture_key(None) == ""


def test_empty_table(spark):
    index = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.directory == [] and warc.read_back(spark, index).count() == 0
