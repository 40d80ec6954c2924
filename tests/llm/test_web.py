import base64
import gzip
import hashlib
import io
import os

from loopweave.llm import url_filters, warc

PAGES = [(1, "http://a.org/x?y", "same"), (2, "https://b.com/", "same"), (3, "http://c.net", "own"),
         (4, None, None), (5, "http://d.org/\r\nEvil: x é", ""), (6, "http://e.org/", "same"),
         (7, "http://f.org/", "x" * 3_000_000), (8, "http://g.org", "a\r\n\r\nWARC/1.1\r\n\r\n"),
         (8, "http://g.org", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://h.org", "own"),
         (None, "http://h.org", "alone")]


def test_captures_from_the_archives(table):
    got = sorted(map(tuple, warc.captures(table("page_id long, url string, html string", PAGES)).collect()),
                 key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        kept = max(ids) if ids else None
        again = kept is not None and page != kept
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if again else "response", kept if again else None))
    assert got == sorted(want, key=str)


def test_small_payloads_stay_responses(table):
    rows = [(1, "u://x", "ab"), (2, "u://x", "ab"), (3, "u://x", "abc"), (4, "u://x", "abc")]
    got = warc.captures(table("page_id long, url string, html string", rows), least_bytes=3)
    assert {r.page_id: r.refers_to for r in got.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_nested_rows_hold_the_whole_transaction(table):
    manifest = warc.write_captures(table("page_id long, url string, html string, type int",
                                         [(*p, 0) for p in PAGES]))
    records = warc.read_records(manifest, manifest.records_at)
    assert records.count() == 3 * len(PAGES)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES)
    pages = {}
    for r in rows:
        pages.setdefault(r.metadata.fields.get("page-id"), r)
    assert pages["7"].response.payload == b"x" * 3_000_000
    assert pages["3"].request.target_uri == "http://c.net"
    assert pages["5"].metadata.fields["url"] == '"http://d.org/\\r\\nEvil: x \\u00e9"'
    assert pages["1"].response.type == "revisit" and pages["1"].response.payload is None
    for name in os.listdir(manifest.records_at):
        if name.endswith(".gz"):
            gzip.open(os.path.join(manifest.records_at, name)).read()


def test_links_in_either_direction_and_missing_parts(spark):
    kinds = warc.RECORD_DDL
    blank = (None, None, None, None, {}, None, "f")

    def record(name, kind, *to):
        return (name, kind, list(to), *blank)

    rows = [record("r1", "response", "q1"), record("q1", "request"), record("m1", "metadata", "r1"),
            record("r2", "revisit"), record("q2", "request", "r2"), record("q3", "request", "r2"),
            record("r3", "response"), record("q9", "request", "gone"), record("w", "warcinfo")]
    got = {r.response.record_id: (r.request and r.request.record_id,
                                  r.metadata and r.metadata.record_id)
           for r in warc.assemble(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None), "r3": (None, None)}


def test_plain_archives_and_damage():
    packed = warc.capture(1, "http://a/b", "text", False, "2024-01-01T00:00:00Z")
    plain = gzip.decompress(packed)
    kinds = [h["warc-type"][0] for h, _ in warc.parse(io.BytesIO(plain))]
    assert kinds == ["response", "request", "metadata"]
    headers, block = next(warc.parse(io.BytesIO(plain.replace(b"text\r\n", b"next\r\n"))))
    try:
        warc._row(headers, block, "f", True)
        raise AssertionError("damage went unnoticed")
    except ValueError:
        pass


def test_warc_of_an_empty_table(table):
    assert warc.captures(table("page_id long, url string, html string", [])).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("tie.net", "/a", "allow"),
         ("tie.net", "/a", "block"), ("x", "", "block")]


def brute(url):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest] or [len(rest)]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:min(ends)])
        path = rest[min(ends):]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in RULES
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_rules_equal_brute_force(table, rnd):
    hosts = ["org", "example.org", "WWW.Example.org", "notexample.org", "a.com", "com", "b.a.COM:80",
             "tie.net", "é.org", "", ".org", "x", "y.x", "user@q.x"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/123?q=/es/", "/en/2", "/fr/x#/de/", "/de/",
             "?/de/", "#x", "/a", "/Ä/://"]
    urls = [f"{s}{h}{t}" for s in ("http://", "://", "mailto:") for h in hosts for t in tails]
    rows = [(i, u) for i, u in enumerate(urls)] + [(-1, None), (-2, ""), (None, urls[3]), (5, urls[5])]
    rows.append((9999, "http://example.org/es/" + "x" * 50_000))
    rnd.shuffle(rows)
    rules = table("host string, path string, verdict string", RULES)
    got = url_filters.judge(table("page_id long, url string, host int", [(*r, 1) for r in rows], 6),
                            rules).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((p, *brute(u)) for p, u in rows), key=str)


def test_hosts_of_very_many_labels(table):
    long = "a." * 100_000
    pages = table("page_id long, url string", [
        (1, f"http://{long}example.org/es/x"), (2, f"http://{long}example.org/de/"),
        (3, f"http://{long}com"), (4, "http://org"), (5, "http://x..com/de/")])
    rules = table("host string, path string, verdict string", [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"),
        (None, "/", "block"), ("b.a.example.org", "/de/", "block")])
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: (None, "allow"),
                   4: (None, "allow"), 5: ("com/de/", "block")}


def test_no_rules_and_no_pages(table):
    rules = table("host string, path string, verdict string", [])
    pages = table("page_id long, url string", [(1, "http://a.org/")])
    assert [tuple(r) for r in url_filters.judge(pages, rules).collect()] == [
        (1, "a.org", "/", None, "allow")]
    rules = table("host string, path string, verdict string", RULES)
    assert url_filters.judge(pages.limit(0), rules).count() == 0
