import base64
import gzip
import hashlib
import random

import pytest

from lattica.llm import url_filter, warc
from lattica.llm.util import scratch

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:k], rest[k:]
        k = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        path = tail[:k]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_urls_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "ample.net", "example.net", "www.EXAMPLE.net", "example.com", "x.example.com", "org", "a.b.org", "", "org:80"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/fr/1', '/de/', '/DE/'])}{rng.choice(['', '?a=/en/', '#://x', '?q#f'])}" for _ in range(400)]
    urls += [None, "", "no-scheme.net/en/", "://net/", "a://b://net/", "http://\nnet/\n", urls[0], urls[0]]
    rules = RULES + [("www.example.net", "/en/x", "block"), ("net", "/en/", "block")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    for r in (RULES, rules, []):
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.filter_urls(df, r).collect()}
        assert got == {i: brute(u, r) for i, u in enumerate(urls)}


def test_rules_in_parts_and_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    labels = ["a", "b", "net", "org", "x"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [(host(), rng.choice(["", "/", "/a", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(200)]
    urls = [f"http://{host()}{rng.choice(['', '/', '/a', '/a/b/c', '?/a'])}" for _ in range(500)] + ["http://" + "x." * 3000 + "net/" + "a" * 100_000]
    df = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(urls)], "page_id long, url string, path int, rule int, c0 int, _key int").repartition(3)
    for size in (1 << 20, 100):
        monkeypatch.setattr(url_filter, "PART_BYTES", size)
        assert len(url_filter._parts(url_filter._prepared(rules))) > 1 or size > 100
        got = {x["page_id"]: (x["host"], x["path"], x["verdict"]) for x in url_filter.filter_urls(df, rules).collect()}
        want = {i: brute(u, dict.fromkeys(rules)) for i, u in enumerate(urls)}
        assert got == {i: (h, p, v) for i, (h, p, _, v) in want.items()}


def test_hosts_with_commas_and_rules_with_slashes(spark):
    urls = ["http://a.net,b/", "http://net,example/en/", "http://x.net,/", "http://a,b.net/", "http://b.a/"]
    rules = [*RULES, ("b.net,x", "/", "block"), ("a/b", "/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in (RULES, rules):
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.filter_urls(df, r).collect()}
        assert got == {i: brute(u, r) for i, u in enumerate(urls)}


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(df, RULES).count() == 0
    path = scratch(spark, "warc")
    warc.write(warc.captures(df), path)
    assert warc.page_report(spark, path).count() == 0


def test_bad_verdict():
    with pytest.raises(ValueError, match="verdict"):
        url_filter._prepared([("a", "/", "maybe")])


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "REPEATS", 2)
    pages = [(1, "http://a/", "x"), (2, "http://b/\r\nX: 1", "x"), (3, None, None), (4, "u", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n"), (5, "u", "é" * 9000), (6, "v", ""), (None, "n", "null id")]
    pages += [(7, "w", "x")] * 5 + [(7, "other", "x"), (8, None, None), (8, None, None), (9, "z", "unlike"), (9, "z", "texts of one id")]
    df = spark.createDataFrame([(*p, "clash", 1, 2) for p in pages], "page_id long, url string, html string, n string, digest int, winner int").repartition(3)
    for least, size in ((0, 8 << 20), (1, 200), (2, 8 << 20)):
        monkeypatch.setattr(warc, "FILE_BYTES", size)
        path = scratch(spark, "warc")
        warc.write(warc.captures(df, min_payload=least), path)
        got = sorted(tuple(map(str, r)) for r in warc.page_report(spark, path).collect())
        want = []
        for i, _, html in pages:
            raw = (html or "").encode()
            same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None] if len(raw) >= least else [i]
            last = max(same, default=None)
            want.append((i, len(raw), sha(html), *(("response", None) if i == last or i is None else ("revisit", last))))
        assert got == sorted(tuple(map(str, r)) for r in want)
        records = warc.read(spark, path)
        assert records.count() == records.select("record_id").distinct().count() == 3 * len(pages)


def test_reports_measure_the_payload_read(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(warc.captures(spark.createDataFrame([(1, "u", "some body"), (2, "v", "some body")], "page_id long, url string, html string")).coalesce(1), path)
    (file,) = tmp_path.glob("warc/*.txt")
    raw = gzip.decompress(file.read_bytes())  # an archive of members is one gzip file to any reader
    assert file.read_bytes().count(gzip.compress(b"", mtime=0)) == 1 and raw.count(b"WARC/1.1\r\n") == 6
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged/whole.warc.gz").write_bytes(gzip.compress(raw.replace(b"some body", b"SOME body")))
    rows = sorted(tuple(r) for r in warc.page_report(spark, str(tmp_path / "damaged")).collect())
    assert rows == [(1, 9, sha("SOME body"), "revisit", 2), (2, 9, sha("SOME body"), "response", None)]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc").write_bytes(raw[:-30])
    with pytest.raises(Exception, match="broken"):
        warc.page_report(spark, str(tmp_path / "cut")).count()


def test_long_records_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)
    blocks = [bytes([65 + k]) * n for k, n in enumerate((0, 1, 63, 5000, 64))]
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in blocks)
    cut = [b"".join(gzip.compress(raw[i : i + 100]) for i in range(0, len(raw), 100)), gzip.compress(raw), raw]
    assert all([b for _, b in warc.parse(x)] == blocks for x in cut)


def test_assembled_captures_hold_payloads(spark):
    df = spark.createDataFrame([(1, "u", "body\r\n\r\nend"), (2, "u", "body\r\n\r\nend")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write(warc.captures(df), path)
    rows = {r["metadata"]["fields"]["page-id"]: r for r in warc.assemble(warc.read(spark, path)).collect()}
    assert rows["2"]["response"]["payload_bytes"] == 11 and bytes(rows["2"]["response"]["payload"]) == b"body\r\n\r\nend" and rows["1"]["response"]["payload"] is None
    assert rows["1"]["response"]["refers_to"] == rows["2"]["capture_id"] and rows["1"]["request"]["record_id"]


def test_records_without_a_partner_and_broken_archives(spark):
    got = list(warc.parse(b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"))
    assert got == [({"warc-type": "request", "content-length": "2"}, b"hi")]
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"garbage\r\n\r\n"))
