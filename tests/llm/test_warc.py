import hashlib

from inkwell.llm import warc


def test_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big, "k"), (2, "http://b", big, "k"), (5, None, big, "k"), (5, "x\r\ny: z", big, "k"), (3, "u", "small", "k"), (4, "u", "small", "k"),
            (6, "u", None, "k"), (7, "u", "", "k"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 300, "k"), (9, "u", "y" * 3_000_000, "k"), (None, "u", big, "k"), (10, "u", "x" * 999, "k"), (11, "u", "x" * 999, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h, _ in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        revisit = r.page_id in (1, 2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert r.html == (None if revisit else html)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_payloads_stay_where_they_are(spark):
    big = "z" * 2000
    pages = spark.createDataFrame([(i, None, big if i % 2 else f"{i} " * 600, "x") for i in range(40)], "page_id long, url string, html string, digest string")
    folder = warc.scratch_path(spark, "warc-test")
    archives = warc.write(pages.repartition(4), folder, date="2001-02-03T04:05:06Z")
    heads = []
    for r in archives.collect():
        with warc.open_in(r.path) as stream:
            heads += [(h, block) for h, block in warc.records(stream)]
    pages_of = [x for x in heads if x[0]["warc-type"] != "warcinfo"]
    assert len(pages_of) == 40 and {h["warc-date"] for h, _ in pages_of} == {"2001-02-03T04:05:06Z"}
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") for _, b in pages_of)
    revisits = [(h, b) for h, b in pages_of if h["warc-type"] == "revisit"]
    assert len(revisits) == 19 and all(h["warc-refers-to-page"] == "39" and b.endswith(b"\r\n\r\n") for h, b in revisits)
    whole = warc.resolve(warc.spool(pages, folder)).select("page_id", "refers_to")
    assert {r.page_id: r.refers_to for r in whole.collect()} == {i: 39 if i % 2 and i != 39 else None for i in range(40)}
