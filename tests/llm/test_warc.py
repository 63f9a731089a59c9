import base64
import hashlib

import pytest

from mojiweave.llm import common, warc


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://Blog.Example.com/en/1?a=b#top", "com,example,blog)/en/1?a=b"),
        ("http://a.b:8080", "b,a:8080)/"),
        ("user@h.org?q", "org,h)?q"),
        ("", ")/"),
        ("http://x.y/a b\n", "y,x)/a%20b%0A"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def archive(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, entry string")
    folder = common.new_path(spark, "archive")
    return pages, folder, warc.archive(pages, folder, **more)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rows = [(i, f"http://h{i % 3}.example.com/{i % 7}", f"<p>é{i % 11}</p>\r\n\r\n" * (i % 5), None) for i in range(200)]
    rows += [(900, None, None, None), (901, "http://z", "", "x"), (None, "http://n", "<p>alone</p>", None), (None, "http://n2", "<p>é1</p>\r\n\r\n", None)]
    pages, folder, shards = archive(spark, rows)
    got = warc.fetch(warc.entries_of(pages), folder, shards).collect()
    assert len(got) == len(rows)
    lead = {}
    for p, _, h, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lead.setdefault(h or "", p)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for p, _, h, _ in rows:
        if p is None:
            continue
        data, first = (h or "").encode(), lead[h or ""]
        r = by_id[p]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to, r.payload) == (("response", None, data) if p == first else ("revisit", first, None))
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", lead["<p>é1</p>\r\n\r\n"])]


def test_lookup_by_url_finds_all_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i}.org/", str(i), None) for i in range(60)]
    _, folder, shards = archive(spark, rows)
    index = warc.Index(folder + "/index", shards)
    found = [int(e.rpartition(b"\t")[2]) for e, *_ in index.find((warc.url_key("http://hot.example.com/") + "\t").encode())]
    assert found == [i for i in range(60) if i % 3]
    assert list(index.find(b"zzz")) == [] and list(index.find(b"")) and len(list(index.find(b"org,h9)/\t"))) == 1


def test_min_bytes_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abcdef", None), (4, "u", "abcdef", None), (4, "u", "abcdef", None)]
    pages, folder, shards = archive(spark, rows, min_bytes=3)
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.fetch(warc.entries_of(pages), folder, shards).collect())
    assert got == [(1, "response", 0), (2, "response", 0), (3, "response", 0), (4, "revisit", 3), (4, "revisit", 3)]
    pages, folder, shards = archive(spark, [])
    assert warc.fetch(warc.entries_of(pages), folder, shards).count() == 0


def test_damage_is_noticed():
    data = warc.record(1, "http://a", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None)
    assert warc.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"payload", b"payl0ad"))


def test_a_file_that_stands_there_is_replaced(tmp_path):
    for text in (b"first", b"second"):
        out = warc._Output(f"file://{tmp_path}", "part")
        out.write(text)
        out.close()
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("part", b"second")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = warc.op3_warc(spark, sf)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    pages = sorted(spark.read.parquet(f"{sf}/pages.parquet").collect(), key=lambda p: p.page_id)
    lead, want = {}, {}
    for p in pages:
        data = (p.html or "").encode()
        first = lead.setdefault(data, p.page_id)
        want[p.page_id] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == p.page_id else "revisit", None if first == p.page_id else first)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()} == want
