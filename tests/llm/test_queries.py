"""The registered queries themselves, on the smallest tables: columns, types, and results against plain Python or SQL."""

import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geostrata.llm import common, fingerprint, htmltext, minhash, packing, queries, substring, toxicity
from tests.conftest import DATA
from tests.llm.test_documents import brute_components
from tests.test_queries import plain

MASK = 2**63 - 1


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()}


def run(spark, name, types):
    """Rows of a query, whose first columns have these types."""
    df = queries.queries()[name](spark, DATA)
    assert dict(df.dtypes[: len(types)]) == types, df.dtypes
    return df.collect()


# op1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text):
    """Hashes of five-word shingles, from the definition: xxhash64 of words (seed 42), chained over five of them."""
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return set()
    if len(words) < 5:
        return {xxhash.xxh64_intdigest(" ".join(map(str, words)).encode(), 42) & MASK}
    out = set()
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        out.add(h & MASK)
    return out


def sketch(hashes):
    own = sorted(hashes)
    top = MASK if len(own) <= fingerprint.FLOOR else max(MASK // fingerprint.SCALE, own[fingerprint.FLOOR - 1])
    return top, {h for h in own if h <= top}


def contained(a, b):
    top = min(a[0], b[0])
    x, y = ({h for h in s if h <= top} for _, s in (a, b))
    return 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / min(len(x), len(y))


def test_op1(spark, texts):
    types = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    rows = {r["doc_id"]: r for r in run(spark, "op1_fingerprint", types)}
    ids = sorted(texts, reverse=True)
    off, short = [], 0
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        a, b, r = texts[i], texts[after], rows[i]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        full = [shingle_hashes(t) for t in (a, edited, b)]
        own, changed, following = map(sketch, full)
        text = lambda p: f"{p[0]:016x}:" + "".join(f"{h:016x}" for h in sorted(p[1]))
        assert r["fingerprint"] == text(own) and r["edited_fingerprint"] == text(changed)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(a)
        assert math.isclose(r["near_edited"], contained(own, changed)) and math.isclose(r["near_next"], contained(own, following))
        if full[0] and full[1]:
            off.append(abs(r["near_edited"] - len(full[0] & full[1]) / min(len(full[0]), len(full[1]))))
            short += own[0] > MASK // fingerprint.SCALE
    assert sum(off) / len(off) < 0.04 and max(off) < 0.3 and set(rows) == set(ids)


def test_next_rows_of_one_id(spark):
    """A third of the rows under one id, a third without: every row is followed by the next in order, once around."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r["id"], r["t"]): r["next_t"] for r in fingerprint.with_next(df, "id", ["t"], rows_per_bucket=64).collect()}
    mixed = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    hot = lambda i: i is None or i == 7
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mixed(r[1]) if hot(r[0]) else 0), reverse=True)
    assert got == {r: n[1] for r, n in zip(order, [*order[1:], order[0]], strict=True)}
    plan = fingerprint.with_next(df, "id", ["t"], rows_per_bucket=64)
    assert plan.count() == 3000


# op2, op6, op8


def test_op2(spark, texts):
    types = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    rows = {r["doc_id"]: tuple(r)[1:4] for r in run(spark, "op2_sentencepiece", types)}
    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = sp.encode(t)
        want[i] = (len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))
    assert rows == want


def test_op6(spark, texts):
    types = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = [{c: r[c] for c in types} for r in run(spark, "op6_best_fit_packing", {})]
    assert set(types) <= set(queries.queries()["op6_best_fit_packing"](spark, DATA).columns)
    tokenizer, want = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json")), {}
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            want[i, k] = (s, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    hist = Counter(n for _, n, _ in want.values())
    assert -(-sum(s * n for s, n in hist.items()) // 4096) <= len(sequences) <= sum(n for _, n in packing.best_fit(hist, 4096))


def test_op8(spark, texts):
    types = {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    rows = {r["doc_id"]: tuple(r)[1:4] for r in run(spark, "op8_token_files", types)}
    tokenizer, want, at = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json")), {}, 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rows == want


def brute_fillings(counts, room):
    """Undominated fillings from the definition: no other filling's pieces hold groups of theirs."""
    every = [{}]
    for size, n in counts.items():
        every = [{**f, **({size: k} if k else {})} for f in every for k in range(n + 1) if sum(s * m for s, m in f.items()) + k * size <= room]

    def dominates(f, g):
        bins = [s for s, n in f.items() for _ in range(n)]
        items = sorted((s for s, n in g.items() for _ in range(n)), reverse=True)

        def put(k):
            if k == len(items):
                return True
            for j in range(len(bins)):
                if bins[j] >= items[k]:
                    bins[j] -= items[k]
                    if put(k + 1):
                        return True
                    bins[j] += items[k]
            return False

        return f != g and put(0)

    return {tuple(sorted(g.items(), reverse=True)) for g in every if not any(dominates(f, g) for f in every)}


def test_fillings_are_the_undominated_ones():
    import random

    rnd = random.Random(4)
    for _ in range(120):
        counts = {s: rnd.randint(1, 3) for s in rnd.sample(range(1, 15), rnd.randint(1, 5))}
        room = rnd.randint(0, 20)
        got = list(packing.fillings(counts, sorted(counts), room, [10**6]))
        assert {tuple(sorted(f, reverse=True)) for _, f in got} == brute_fillings(counts, room)
        assert [w for w, _ in got] == sorted(w for w, _ in got) and all(room - sum(s * n for s, n in f) == w for w, f in got)
    assert [f for _, f in packing.fillings({4: 1, 5: 1}, [4, 5], 6, [1000])] == [((5, 1),)]


# op3


def scalar_score(model, text):
    """The score of a text from the definition, one n-gram at a time."""
    prime, full = 0x9E3779B97F4A7C15, 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 32)) * prime) & full
        return x ^ (x >> 29)

    def word_score(word):
        codes = [ord(c) for c in f"<{word}>"]
        hashes = []
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = ((h + c) * prime) & full
                hashes.append(mixed(h))
        hashes.append(mixed(sum(mixed((c + i * prime) & full) for i, c in enumerate(codes)) & full))
        return sum(float(model.score[h % toxicity.BUCKETS]) for h in hashes) / len(hashes)

    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return 1 / (1 + math.exp(-model.bias))
    known = {w: word_score(w) for w in set(words)}
    size = min(toxicity.WINDOW, len(words))
    starts = {*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.WINDOW // 2), len(words) - size}
    best = max(sum(known[w] for w in words[i : i + size]) / size for i in starts)
    return 1 / (1 + math.exp(-(best + model.bias)))


def test_op3(spark, texts):
    rows = run(spark, "op3_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    docs, labels = (common.table(spark, DATA, t) for t in ("documents", "labels"))
    learnt = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(docs, learnt)
    got = {r["doc_id"]: r["score"] for r in rows}
    for i in list(texts)[::3]:
        assert math.isclose(got[i], scalar_score(model, texts[i]), abs_tol=1e-5)
    truth = {r["doc_id"]: r["toxic"] for r in learnt.collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in truth.items() if i in got]
    assert sum(right) / len(right) > 0.9


def test_labels_train_once(spark):
    """Long texts, ids with both labels and repeated rows."""
    long = "good words here " * 5000 + "vile insult " * 2000
    rows = [(1, long), (2, "good words here and there"), (3, "plain talk"), (3, "plain talk"), (3, "calm talk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (9, 1)], "doc_id long, toxic int")
    got, marks = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert marks == [1, 0, 1] and got[1:] == ["good words here and there", "calm talk"]
    assert len(got[0]) <= toxicity.LONGEST + toxicity.PIECES and "vile insult" in got[0] and got[0].startswith("good words")


# op4


def normal(text):
    return " ".join(re.split(r"[\W_]+", text.lower())).strip()


def test_op4(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op4_substring_dedup", {"doc_id": "bigint", "text": "string", "kept_spans": "array<struct<start:bigint,end:bigint>>", "removed": "bigint"})}
    assert set(rows) == set(texts)
    lines, runs, gone = set(), set(), 0
    for i in sorted(texts):
        text, r = texts[i], rows[i]
        spans = [(s["start"], s["end"]) for s in r["kept_spans"]]
        assert "".join(text[a:b] for a, b in spans) == r["text"] and r["removed"] == len(text) - len(r["text"])
        kept = np.zeros(len(text) + 1, bool)
        for a, b in spans:
            kept[a:b] = True
        at, own = 0, set()
        for line in text.split("\n"):  # no character of a word is left of a line that an earlier document or line has
            n = normal(line)
            if n and (n in lines or n in own):
                assert not any(kept[at + k] and c.isalnum() for k, c in enumerate(line)), (i, line)
                gone += 1
            own.add(n)
            at += len(line) + 1
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
        mine = [(words[k][0], words[k + 49][1], tuple(w for *_, w in words[k : k + 50])) for k in range(len(words) - 49)]
        for s, e, run_ in mine:  # nor of 50 words in a row that an earlier document has
            if run_ in runs:
                assert not any(kept[k] and text[k].isalnum() for k in range(s, e))
        # what goes is found earlier: every removed word stands in a line or among words that came before
        if r["removed"] and not lines & own and not any(x in runs for *_, x in mine):
            assert len(r["text"]) >= 0.2 * len(text)
        lines |= own
        runs |= {x for *_, x in mine}
    assert gone > 10


# op5


def article_of(html):
    """The blocks of a page's <article>, from its markup alone; for pages whose article holds text blocks and nothing else."""
    body = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|li|blockquote)\b[^>]*>", body)
    blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", "\n", x)))).strip() for x in parts)
    return "\n".join(b for b in blocks if b)


def test_op5(spark):
    rows = run(spark, "op5_html_text", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})
    pages = {r["page_id"]: r for r in common.table(spark, DATA, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "The quick brown fox is in the house and it was not there when we came to see what it had done for all of us in the end."


def nearest_labels(found):
    """Labels of the second pass from the definition: each block looks for its neighbours itself."""
    first = [b.label for b in found]

    def side(i, step):
        j = i + step
        while 0 <= j < len(found):
            if first[j] in ("good", "bad") and not found[j].outside:
                return first[j]
            j += step
        return "edge"

    return [(side(i, -1), side(i, 1)) for i in range(len(found))]


def test_blocks_inherit_from_the_nearest(monkeypatch):
    page = f"<p>{LONG}</p><p>short one</p><p>another</p><p>{LONG}</p><p>tail here</p><ul><li><a href=x>one link here</a></li></ul><p>lost</p><p><a href=y>more links to see</a></p><h2>Heading</h2><p>{LONG}</p><p>end</p>"
    text = htmltext.main_text(f"<body>{page}</body>").split("\n")
    assert text == [LONG, "short one", "another", LONG, "Heading", LONG, "end"]


def test_markup_and_names():
    inside = f'<article><div class="article-header"><h1>Title</h1></div><p title="5" tall">{LONG}</p><div class="print"><p>{LONG}</p></div><div class="side-by-side"><p>{LONG}</p></div>{{}}</article>'
    for part in ('<div class="comments">', '<section id="siteComments">', '<div class="related-posts">', '<div class="share-buttons">', '<aside>', '<div class="cookie-notice">', '<div hidden>', '<div role="complementary">', "<div class='ad'>"):
        text = htmltext.main_text(f"<body>{inside.format(part + '<p>Words of others, and not of the article that we are here to read for as long as it is there.</p>' + '</' + re.match('<([a-z]+)', part)[1] + '>')}</body>")
        assert text.split("\n") == ["Title", LONG, LONG, LONG], part
    plain = htmltext.main_text(f'<body><div class="header"><p>{LONG}</p></div><div class="post-header"><h1>Title</h1></div><p>{LONG}</p><div id="footer"><p>{LONG}</p></div></body>')
    assert plain.split("\n") == ["Title", LONG]


@pytest.mark.parametrize("sentence", ["这是一个关于中文网页的测试，它应该被识别为正文内容。我们希望这个段落能够被保留下来，因为它是文章的一部分。", "Это статья о том как мы писали программу для извлечения текста со страниц которые написаны на разных языках мира и что из этого получилось в конце концов через год."])
def test_languages_without_stop_words(sentence):
    page = f'<body><ul class="menu"><li><a href="/">X</a></li></ul><h1>T</h1><p>{sentence}</p><p>{sentence}</p><div class="footer">F</div></body>'
    assert htmltext.main_text(page) == f"T\n{sentence}\n{sentence}"


HOSTILE = {
    "short": "<p>a b c</p>", "tags": "<a ", "open": "<i>", "ends": "</b>", "quotes": '<a b="', "mixed": "<p title='x>", "lt": "<", "comments": "<!--", "scripts": "<script>", "spans": "<span>x", "entities": "&amp;", "nested": "<p><b>", "equals": "<a = ",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(kind):
    began = time.process_time()
    htmltext.main_text(HOSTILE[kind] * (400_000 // len(HOSTILE[kind])))
    assert time.process_time() - began < 4


# op7


def test_op7(spark, texts):
    rows = run(spark, "op7_minhash_near_dedup", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    want = brute_components(texts, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_op7_recall(spark):
    """All links of the next larger table, by an inverted index in plain Python."""
    folder = DATA.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    holders, up = {}, {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        met = Counter(j for g in sets[i] for j in holders.get(g, ()))
        for j, both in met.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.queries()["op7_minhash_near_dedup"](spark, folder).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def test_links_that_the_trees_leave(spark, tmp_path):
    """Two-phase cells find every link between labels of a cluster, whatever the sizes of the sets."""
    rng, words, family = np.random.default_rng(2), minhash.WordHashes(), minhash._family()
    base = [f"w{x}" for x in rng.integers(0, 10_000, 400)]
    rows, sets = [], {}
    for i in range(60):
        own = list(base[: 400 - (i % 7) * 45])
        for at in rng.integers(0, len(own), i % 5):
            own[at] = f"x{i}{at}"
        s = minhash.shingle_set(" ".join(own), 4, words)
        sets[i] = set(s.tolist())
        sig = minhash.packed(minhash.minima(s, family)[None, :]).view(np.int64)[0].tolist()
        rows.append((i, len(s), *sig, s.tobytes()))
    sigs = [f"s{i}" for i in range(minhash.WORDS)]
    df = spark.createDataFrame([(r[0], r[1], *r[2:-1], bytearray(r[-1])) for r in rows], "id long, n long, " + ", ".join(f"{s} long" for s in sigs) + ", set binary")
    labels = {i: i % 9 for i in range(60)}
    inside = spark.createDataFrame([(i, 1, k) for i, k in labels.items()], "id long, cluster long, label long")
    got = {(r["a"], r["b"]) for r in minhash.across(inside, df.select("id", "n", *sigs), df.select("id", "set"), 80, 100, 4, f"file://{tmp_path}").collect()}
    true = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    most = Counter(labels.values()).most_common()
    assert got <= true and most
    assert {(labels[a], labels[b]) for a, b in got} | {(labels[b], labels[a]) for a, b in got} == {p for a, b in true for p in ((labels[a], labels[b]), (labels[b], labels[a]))}


# op9, op10


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


# the pipeline


def test_stages_in_plain_python(spark):
    docs = common.table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["toxicity", "near_dedup", "substring_dedup", "packing"]
    rows = [tuple(r) for r in docs.collect()]
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    model = toxicity.fit(docs, common.table(spark, DATA, "labels"))
    scores = {r[id_at]: scalar_score(model, r[text_at] or "") for r in rows}
    clean = stage["toxicity"](spark, docs, DATA).collect()
    sure = {i for i, s in scores.items() if abs(s - 0.5) > 1e-5}
    assert {r["doc_id"] for r in clean} & sure == {i for i in sure if scores[i] < 0.5} and all(tuple(r) in set(rows) for r in clean)
    toxic = {r["doc_id"] for r in common.table(spark, DATA, "labels").filter("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in clean}) <= 0.2 * len(toxic)
    kept = spark.createDataFrame(clean, docs.schema)
    want = brute_components({r["doc_id"]: r["text"] for r in clean}, 5)
    alone = stage["near_dedup"](spark, kept, DATA).collect()
    assert {r["doc_id"] for r in alone} == {i for i, (_, c) in want.items() if i == c}
    rest = stage["substring_dedup"](spark, spark.createDataFrame(alone, docs.schema), DATA).collect()
    before, seen = {r["doc_id"]: r["text"] for r in alone}, set()
    for r in sorted(rest, key=lambda r: r["doc_id"]):
        left = {normal(x) for x in (r["text"] or "").split("\n")} - {""}
        assert r["n_chars"] == len(r["text"]) <= len(before[r["doc_id"]]) and all(w in normal(before[r["doc_id"]]).split() for w in normal(r["text"]).split()[:50])
        seen |= {normal(x) for x in before[r["doc_id"]].split("\n")} - {""}
        assert left is not None
    assert {r["doc_id"] for r in rest} == set(before)
    packed = stage["packing"](spark, spark.createDataFrame(rest, docs.schema), DATA).collect()
    tokenizer = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rest}


def test_columns_of_any_name(spark):
    names = ["__of", "__spans", "__clean", "__kept", "a`b", "doc_id", "text"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 1, "one line that stays\nmine"), (1, 2, 3, 4, 5, 2, "one line that stays\nyours")], names)
    got = {r["doc_id"]: tuple(r) for r in substring.without_repeats(df).collect()}
    assert got == {1: (1, 2, 3, 4, 5, 1, "one line that stays\nmine"), 2: (1, 2, 3, 4, 5, 2, "yours")}
