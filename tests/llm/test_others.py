"""HTML text, exact top-k, WARC audits and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from geostrata.llm import common, htmltext, minhash, substring, topk, warc
from tests.conftest import DATA

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">News</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for you and for all of our many partners in the world.</div>
{open}<h1>Title &amp; more</h1><p>This is the first paragraph of the story, and it has   many words that are in the list of
stop words, so it is long enough to be good.</p><div class="ad">Buy this now, it is the best that you can have in all of your life and more.</div>
<p>Short one.</p><p>Another paragraph that goes on for a while, with the usual words of the language in it, until it is as long as the
others of the page are.<br>After a break</p>{close}
<aside class="sidebar"><p>Related: this is a long text about other things that you may like, as it has been read by all of the others.</p></aside>
<form><label>Your name</label><input><p>Please fill in this form with all of the things that we want to know of you and your friends.</p></form>
<div id="comments"><p>I think that this is the worst article that I have read on this site in all of the years, and so do my friends.</p></div>
<footer>&copy; 2024 Site. All rights reserved, and this is a long line of the footer with the words of the law in it.</footer></body></html>"""
TEXT = """Title & more
This is the first paragraph of the story, and it has many words that are in the list of stop words, so it is long enough to be good.
Short one.
Another paragraph that goes on for a while, with the usual words of the language in it, until it is as long as the others of the page are. After a break"""


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<div>", "</div>"), ('<div class="content">', "</div>"), ("<main>", "</main>")])
def test_main_text(start, end):
    assert htmltext.main_text(PAGE.format(open=start, close=end)) == TEXT


def test_broken_markup():
    assert htmltext.main_text("<article><h1>One</h1><p><b>Bold start<br><p>Next <i>one") == "One\nBold start\nNext one"
    assert htmltext.main_text("<p>a < b &lt; c &#x41; &nbsp; d") in ("", "a < b < c A d")
    for odd in (None, "", "plain", "<", "<p", "<!-- never closed <p>x", "<script>never closed", "</p></div>", "<p>" * 3000 + "x", "&#0; &#xFFFFFFF;"):
        assert isinstance(htmltext.main_text(odd), str)


def test_html_tables(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert all("track(" not in r["text"] and "&copy;" not in r["text"] for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<article><p>x" * 2), (2, "u", "<article><p>x" * 2)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "text", "n_chars")})
    got = htmltext.extract(odd).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, ""), (2, "x\nx"), (2, "x\nx")]
    assert htmltext.extract(odd.limit(0)).count() == 0


def brute_top(vectors, k):
    known = {}
    for i, v in vectors:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            known.setdefault(i, []).append(np.floor(64 * np.array(v, np.float64)).astype(np.int64))
    flat = [(i, v) for i, vs in known.items() for v in vs]
    out = set()
    for q, vs in known.items():
        if q % 20 == 0:
            for v in vs[:1]:
                best = sorted((-int(v @ w), i) for i, w in flat if i != q)[:k]
                out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "PILOT", 64)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    rnd = random.Random(1)
    rows += [(1000 + i, [float(rnd.randrange(-2, 3)) for _ in range(64)]) for i in range(100)] + [(2000 + i, [1.0] * 64) for i in range(90)]
    rows += [(3000, None), (3001, [None] * 64), (3020, [float("nan")] * 64), (3040, [float("inf")] + [0.0] * 63), (None, [0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "rank", "score", "vector")})
    got = {tuple(r) for r in topk.top_k(df, lambda i: i % 20 == 0).collect()}
    assert got == brute_top(rows, 20)
    assert topk.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = {tuple(r) for r in topk.top_k(df.filter("vec_id < 7"), lambda i: i % 20 == 0).collect()}
    assert len(few) == 6


def test_top_k_of_large_numbers(spark):
    big = np.array([[2.0**27, 3.0], [-(2.0**27), 1.0]])
    assert topk.products(big, big).tolist() == [[2**54 + 9, -(2**54) + 3], [-(2**54) + 3, 2**54 + 1]]
    huge = np.array([[2.0**61, 1.0, -(2.0**61)], [3.0, 5.0, 3.0]])
    assert topk.products(huge[1:], huge).tolist() == [[5, 43]]  # sums on the way reach 2^63
    with pytest.raises(OverflowError):
        topk.products(huge, huge)
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0]), (3, [5e6, 0.0]), (4, [-1e12, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 64 * 64 * 5_000_000), (1, 3 * 4096), (2, 0), (4, -4096 * 10**12)]


def test_top_k_bounds_are_rounded_up():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(2000, 3)) * 2.0**30)
    tree = topk.Tree(np.arange(2000), np.arange(2000), v)
    exact = [[int(x) for x in row] for row in v]
    for q in range(0, 2000, 97):
        want = max(sum(a * b for a, b in zip(exact[q], w, strict=True)) for w in exact)
        assert int(tree.bound(0, v[q : q + 1])[0]) >= want
    scores, _ = tree.search(np.array([-1]), v[:1], 3, np.full(1, topk.NONE))
    assert scores[0].tolist() == sorted((sum(a * b for a, b in zip(exact[0], w, strict=True)) for w in exact), reverse=True)[:3]


def test_top_k_of_repeated_ids(spark):
    """Each row of an id is a query of its own, and a candidate of the other."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted([(20, 1, 1, 8192), (20, 2, 20, 0), (20, 1, 1, 4096), (20, 2, 20, 0)])


def test_tree_prunes(spark):
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(size=(8000, 2)) * 64)
    tree = topk.Tree(np.arange(8000), np.arange(8000), v)
    seen = []
    plain = topk.products
    try:
        topk.products = lambda a, b: seen.append(len(b)) or plain(a, b)
        scores, _ = tree.search(np.array([-1]), v[:1], 5, np.full(1, topk.NONE))
    finally:
        topk.products = plain
    assert sum(seen) < 3000 and scores[0].tolist() == sorted((v @ v[0]).astype(int).tolist(), reverse=True)[:5]


def test_warc_audit(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None), (7777, "u\nv", ""), (7777, "u\nv", "")], pages.schema)
    df = pages.union(odd).withColumns({c: F.lit(1) for c in ("id", "file", "seq", "offset", "length")})
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write_warc(df, a)
    warc.copy_replica(index, a, b)
    assert warc.audit(index, warc.trees(index, a), warc.trees(index, b)).count() == 0
    rows = index.collect()
    target = max(rows, key=lambda r: (r["file"], r["seq"]))
    path = tmp_path / "b" / "files" / target["file"]
    data = bytearray(path.read_bytes())
    data[target["offset"] + 5] ^= 1  # in the header
    path.write_bytes(data)
    found = warc.audit(index, warc.trees(index, a), warc.trees(index, b, "again")).collect()
    own = sum(r["file"] == target["file"] for r in rows)
    assert [(r["file"], r["seq"]) for r in found] == [(target["file"], target["seq"])] and found[0]["compared"] <= 2 * own.bit_length() + 2
    path.write_bytes(data[: target["offset"]] + b"")
    path.with_name(rows[0]["file"]).unlink() if rows[0]["file"] != target["file"] else None
    found = warc.audit(index, warc.trees(index, a), warc.trees(index, b, "third")).collect()
    assert (target["file"], target["seq"]) in {(r["file"], r["seq"]) for r in found}
    records = {r["id"]: r for r in warc.read_warc(index, a).collect()}
    want = {r["page_id"]: r for r in pages.collect()}
    assert all(records[i]["payload"].decode() == w["html"] and records[i]["url"] == w["url"] for i, w in want.items())
    assert records[None]["payload"] == b"" and records[7777]["url"] == "u\nv"
    none = warc.write_warc(df.limit(0), f"file://{tmp_path}/c")
    assert none.count() == 0 and warc.read_warc(none, f"file://{tmp_path}/c").count() == 0


def test_trees():
    for n in (0, 1, 2, 3, 7, 8, 100):
        leaves = [warc.leaf(i, bytes([i])) for i in range(n)]
        other = list(leaves)
        for i in range(0, n, 9):
            other[i] = b"x" * 32
        bad, compared = warc.differing(*([b"".join(x) for x in warc.levels(y)] for y in (leaves, other)))
        assert bad == list(range(0, n, 9))
    tree = [b"".join(x) for x in warc.levels(leaves)]
    assert warc.differing(tree, tree) == ([], 1) and warc.differing(tree, []) == (list(range(100)), 100)


# the pipeline


def test_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "packing"]
    kept, out = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DATA)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        out.append(kept)
    for frame in out[:-1]:
        assert frame.columns == docs.columns
    toxic, near, parts, packed = out
    groups = {r["doc_id"]: r for r in minhash.near_duplicates(toxic, k=5).collect()}
    assert {r["doc_id"] for r in near.collect()} == {i for i, r in groups.items() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in parts.collect()}
    want = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(near).collect()}
    assert clean == {i: (t, len(t)) for i, t in want.items()} and set(clean) == set(texts)
    assert {r["doc_id"] for r in packed.collect()} == set(clean)
    ran = corpus_pipeline.run(spark, DATA)
    assert ran.count() == packed.count()


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d e f", "en"), (None, "a b c d e f", None), (2, None, "en"), (3, "", None), (4, "a b c d e f", "en"), (4, "a b c d e f", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(0).cast("long") for c in ("n_chars", "score", "kept", "id", "start")})
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame, want in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        assert frame.count() == want
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert len(packed) == want and all(r["offset"] + r["length"] <= 4096 for r in packed)
        assert len({(r["sequence_id"], r["offset"]) for r in packed}) == want


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
