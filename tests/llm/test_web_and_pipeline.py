"""URL lists, archives and the pipeline."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postwarden.llm import urltrie, warc
from postwarden.llm.queries import RULES


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(str.maketrans(urltrie.ascii_lower.__globals__["UPPER"], urltrie.ascii_lower.__globals__["LOWER"])), rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    path = rest[:cut]
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_url_rules(spark):
    urls = [
        None, "", "no mark", "http://", "http://example.org", "http://example.org/", "HTTP://A.Example.ORG/en/12/x?q=1#f", "https://notexample.org/es/",
        "http://example.org/es", "http://example.org/es/a", "http://b.com/fr/x", "http://com/de/", "http://x.com/de", "http://x.com:80/de/y",
        "http://example.org/en/2", "a://b://c.org/x", "http://ÄB.org/\n?x", "http://org?x/", "http://x.org#/", "://y.com/fr/", "http://example.org//es/",
        "http://.org/", "http://..com/fr/", "http://u@x.com/de/z",
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(1, "", "x", "y")], "page_id long, url string, host string, rest string")
    out = urltrie.judged(df, RULES).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id], RULES)
    assert urltrie.judged(df.limit(0), RULES).count() == 0


def test_longer_rules_win():
    trie = urltrie.build_trie([("block", "a.b", "/"), ("allow", "b", "/x/y/"), ("block", "c.a.b", "/"), ("allow", "a.b", "/x")])
    assert urltrie.longest(trie, "c.a.b", "/q")[3:] == ("c.a.b/", "block")
    assert urltrie.longest(trie, "z.a.b", "/xyz")[3:] == ("a.b/x", "allow")
    assert urltrie.longest(trie, "q.b", "/x/y/z")[3:] == ("b/x/y/", "allow")
    assert urltrie.longest(trie, "q.b", "/x/y") is None
    with pytest.raises(ValueError):
        urltrie.build_trie([("maybe", "a", "/")])


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nbody\n\nfiledesc://x", b"", b"\n\n"]
    data = warc.arc_head("a.arc", version, "20240102030405")
    for b in blocks:
        data += warc.arc_record("a.arc", version, "20240102030405", "http://a b/\n", b, len(data))
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [r["block"] for r in got] == blocks and got[0]["URL"] == "http://a%20b/%0A"
    assert list(got[0]) == [*warc.FIELDS[version].split(" "), "block"]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[5:])))


PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/ c", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/", None), (4, "", ""),
    (5, "http://d/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"), (6, "http://e/", "é😀" * 40_000), (1, "http://a/", "<p>same</p>"),
    (None, "http://f/", "<p>same</p>"), (None, "http://g/", "only"), (1, "http://h/", "another"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    out = warc.archived(df, least).collect()
    top = {}
    for page, _, html in PAGES:
        top[html or ""] = max(top.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in PAGES:
        data, best = (html or "").encode(), top[html or ""]
        revisit = len(data) >= least and best != -1 and page != best
        want.append((page, len(data), hashlib.sha1(data).digest(), "revisit" if revisit else "response", best if revisit else None))
    import base64

    got = [(r.page_id, r.payload_bytes, base64.b32decode(r.payload_digest), r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {(r.page_id, r.payload_digest): r.record_id for r in out}
    assert all(r.refers_to_record == ids[r.refers_to, r.payload_digest] for r in out if r.refers_to is not None)
    assert {r.warc_date for r in out} == {"2024-01-01T00:00:00Z"}
    assert warc.archived(df.limit(0)).count() == 0


def test_stages_keep_columns_and_take_effect(spark, docs, folder):
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    kept = {r.doc_id for r in now.collect()}
    assert not kept & {200, 201, 202, 203} and not kept & set(range(101, 108)) and 206 in kept
    assert sum(r.doc_id == 0 for r in now.collect()) <= 1
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == kept


def test_stages_on_extra_columns_and_empty_tables(spark, crowded, none, folder):
    for df in (crowded, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns
            out.agg(F.count(F.lit(1))).first()


def test_stage_results_equal_the_operators(spark, docs, folder):
    from tests.llm.test_likeness import brute_join

    rows = [tuple(r) for r in docs.collect()]
    _, root = brute_join(rows)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, folder).collect()}
    assert kept == {k for k, v in root.items() if k == v} | {None}


def test_texts_under_one_id_are_judged_apart(spark, docs, folder):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (3, c), (3, a), (9, None), (9, b), (None, a)]
    df = spark.createDataFrame([(k, t, "aa", "s", 0) for k, t in rows], docs.schema)
    out = corpus_pipeline.distinct(spark, df, folder)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (3, c), (5, b), (9, None), (None, a)], key=str)
