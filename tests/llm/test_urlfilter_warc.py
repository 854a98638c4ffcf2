import base64
import hashlib
import random

import pytest

from rankloom.llm import urlfilter, warc
from rankloom.llm.common import Scratch


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_rules_hosts_and_paths(spark):
    urls = {
        1: "http://A.Example.COM/en/x?y#z", 2: "https://www.example.com/en/1", 3: "http://example.com?/en/", 4: "http://x.net/es/", 5: "http://x.net/de/", 6: "http://notexample.com/en/",
        7: None, 8: "no scheme", 9: "ftp://net/fr/#a/b", 10: "x://example.com/en", 11: "http://m.www.example.com/en/?q", 12: "", 13: "a://b://c/d", 14: "http://com#/x",
    }
    rows = [(k, u, "<html>", "clash", 1) for k, u in urls.items()]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string, decision int")
    want = {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("example.com", "", None, "allow"), 4: ("x.net", "/es/", "net/es/", "block"),
        5: ("x.net", "/de/", None, "allow"), 6: ("notexample.com", "/en/", "com/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "/fr/", "net/fr/", "block"), 10: ("example.com", "/en", "com/", "allow"),
        11: ("m.www.example.com", "/en/", "www.example.com/en/", "allow"), 12: ("", "", None, "allow"), 13: ("b:", "//c/d", None, "allow"), 14: ("com", "", None, "allow"),
    }
    assert urlfilter.digest(pages).count() == len(urls) + 1
    assert verdicts(urlfilter.digest(pages)) == want
    joined = urlfilter.match_rules(pages, inline=0)
    assert {r.page_id: r.rule for r in joined.collect()} == {k: v[2] for k, v in want.items()} and joined.count() == len(urls) + 1
    assert urlfilter.digest(pages.limit(0)).collect() == []


def test_aliases_take_block_decisions_and_allow_comes_first(spark):
    link = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://x.net/es/1", link("http://x.net/a")), (2, "http://x.net/a#frag", "<p>"), (3, "http://x.net/b", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=/a">'),
        (4, "http://x.net/fr/9", link("http://ok.com/")), (5, "http://y.net/alias", link("http://ok.com/")), (6, "http://z.net/free", link("http://z.net/free2")), (7, "http://q.net/fr/1", link("//w.net/c")), (8, "http://w.net/c", None),
    ]
    got = verdicts(urlfilter.digest(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}


def test_columns_that_differ_in_case_from_the_result(spark):
    rows = [(1, "http://x.net/es/1", None, "a", "b", "c", 1.5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Rule string, VERDICT string, Host string, `a.b c` double")
    assert verdicts(urlfilter.digest(pages)) == {1: ("x.net", "/es/1", "net/es/", "block")}
    judged = urlfilter.judge(pages)
    assert [c.lower() for c in judged.columns].count("rule") == 1 and judged.first()["a.b c"] == 1.5


def test_chains_and_a_hot_target_against_union_find(spark):
    rng = random.Random(5)
    hosts, paths = ["x.net", "ok.com", "y.org", "example.com", "www.example.com"], ["/es/", "/fr/", "/en/", "/de/", "/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{i}" for i in range(900)]
    link = {i: i + 1 for i in range(0, 200)} | {i: 500 for i in range(300, 600) if i != 500} | {i: rng.randrange(900) for i in range(600, 750)}
    rows = [(i, u, f'<link rel="canonical" href="{urls[link[i]]}">' if i in link else "<p>") for i, u in enumerate(urls)]
    up = list(range(900))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in link.items():
        up[root(a)] = root(b)
    own = {r.url: r.decision for r in urlfilter.match_rules(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    group = {}
    for i, u in enumerate(urls):
        group.setdefault(root(i), set()).add(own[u])
    want = {i: own[u] or ("allow" if "allow" in group[root(i)] else "block" if "block" in group[root(i)] else "allow") for i, u in enumerate(urls)}
    got = verdicts(urlfilter.digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)))
    assert {k: v[3] for k, v in got.items()} == want and sum(own[urls[i]] is None and v == "block" for i, v in want.items()) > 2


def pages_of(rng):
    texts = ["", None, "é" * 10, "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "x" * 200_000, *[f"page {i}\n" for i in range(20)]]
    rows = [(i, rng.choice(["http://a/b", None, "http://a/\r\nb"]), rng.choice(texts), 1.0) for i in range(200)]
    return [*rows, rows[3], (None, "http://n/", "page 1\n", 2.0), (None, None, "unique", 3.0)]


def test_round_trip_and_revisits(spark):
    rows = pages_of(random.Random(2))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, original double")
    low = {}
    for k, _, h, _ in rows:
        if k is not None:
            low[h or ""] = max(low.get(h or "", k), k)
    want = []
    for k, _, h, _ in rows:
        data = (h or "").encode()
        first = low.get(h or "")
        own = first is None or k == first
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert sorted(map(tuple, warc.digest(pages).collect()), key=str) == sorted(want, key=str)
    at = Scratch(spark, "t").path("w")
    warc.write_archives(pages, at)
    back = warc.read_archives(spark, at).where("record_type = 'response'").collect()
    texts = {hashlib.sha1((h or "").encode()).digest(): (h or "").encode() for _, _, h, _ in rows}
    assert all(bytes(r.payload) == texts[base64.b32decode(r.payload_digest)] for r in back)
    assert {bytes(r.payload) for r in back} == set(texts.values())


def test_files_roll_and_repeated_rows_are_dealt(spark):
    rows = [(7, "u", "same")] * 40 + [(8, "u", "same")] * 3 + [(i, "u", f"page {i} " * 50) for i in range(100, 160)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    at = Scratch(spark, "t").path("w")
    warc.write_archives(pages, at, repeated=3, file_bytes=2000)
    parts = [r.path for r in spark.read.format("binaryFile").load(at).select("path").collect()]
    assert len(parts) >= 10
    got = warc.resolve_revisits(warc.read_archives(spark, at)).groupBy("page_id", "record_type", "refers_to").count().collect()
    some = {(r.page_id, r.record_type, r.refers_to): r["count"] for r in got}
    assert some[(7, "revisit", 8)] == 40 and some[(8, "response", None)] == 3 and sum(some.values()) == len(rows)


def test_min_bytes_empty_and_damage(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    warc.write_archives(pages, at := scratch.path("w"), min_bytes=5)
    got = warc.resolve_revisits(warc.read_archives(spark, at)).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} == {(1, "response", None, 2), (2, "response", None, 2), (3, "revisit", 4, 6), (4, "response", None, 6)}
    assert warc.digest(pages.limit(0)).collect() == []
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 17\r\n\r\nHTTP/1.1 200\r\n\r\nab"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(record.replace(b"17", b"18") + b"\r\n\r\n"))


def test_every_canonical_and_refresh_tag_is_an_edge(spark):
    html = """<link href=/a rel=canonical><link rel="nofollow canonical" href="/b"><link rel='canonical'><link rel='canonical' href='/c'>
<link rel="noncanonical" href="/no"><meta http-equiv=refresh content="0;url=/d"><meta http-equiv="refresh" content="1;url=/e">"""
    pages = spark.createDataFrame([("http://h.org/p", html)], "url string, html string")
    assert sorted(r.dst for r in urlfilter.link_edges(pages).collect()) == [f"http://h.org/{x}" for x in "abcde"]
