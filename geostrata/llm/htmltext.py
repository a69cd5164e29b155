"""Main text of HTML pages by two passes over blocks.

First pass: a page is cut into blocks at block-level tags; a block is classed by its length, the share of its
characters inside links and the share of its words that are stop words:

* many link characters, or a place that is never the article (nav, footer, form, advert ...): bad;
* long, with many stop words: good; with few: near-good; short: short; no stop words: bad.

On a page with hardly any stop word at all (a language that the list does not hold) length, link density and a
sentence's end decide alone. Letters of scripts without spaces count as half a word each.

Second pass: near-good and short blocks take the label of the nearest decided neighbours: good if both sides agree
on good; where they differ, near-good blocks go with the article and short ones with the bad side, unless an
<article> or <main> holds the block. Headings stand with the text that follows. Where a page marks an <article>
(or <main>), blocks outside it start as bad. Class and id values are read by whole names: a name says that an element
is no part of the article if one of its words does (comments, sidebar, share ...) and the others add nothing (box, list,
site ...); header, footer and the like say so outside articles only.

The scanner is linear in a page's length. A quote opens a value only after an equals sign, so stray quotes do no harm.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline.

Cases: null or empty html gives an empty text; null ids and urls pass through; repeated rows give equal results;
an empty table gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import common

# Tags of the HTML standard, by what they do to a block.
DROPPED = frozenset("script style noscript template svg math title iframe object embed canvas audio video select datalist textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav aside footer form header menu button dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of names that say that an element is no part of the article; those that say so outside articles only; and words
#: that add nothing to either.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices nav navi navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar widget widgets related recommended recommendation recommendations share sharing social comment comments commentlist disqus reply replies respond signin signup login subscribe"
    " subscription newsletter popup modal overlay pager pagination toolbar skip".split()
)
FRAME = frozenset("header head footer foot masthead banner side copyright".split())
EMPTY = frozenset(
    "a and area bar block blocks body bottom box btn button buttons col column container content embed fixed form global group icon icons inner item items js left link links list lists main module more news outer page panel"
    " post posts article articles entry story stories right row section site slot sticky sub text thread to top unit us view wrap wrapper zone".split()
)
ARTICLE = frozenset("article post entry story content body text".split())
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "a about after all an and are as at be been but by can could do for from had has have he her his how i if in into is it its more no not of on one or our out she so some than that the their them"
        " there these they this to up was we were what when which who will with would you your"
        " aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat haben ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über"
        " um und uns von vor war wenn wie wir wird zu zum zur"
        " au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur tu un une vous y"
        " al como con cuando del desde el ella ellas ellos entre era es esta este esto fue ha hay la las le lo los más me mi muy ni no nos o para pero por porque que se según ser si sin sobre su sus también te tiene un"
        " una uno ya yo"
    ).split()
)
#: Words of a long block, of a short one; shares of stop words and of link characters.
LONG, SHORT, STOP_HIGH, STOP_LOW, LINKS = 25, 10, 0.25, 0.1, 0.4
#: Share of stop words on a page below which its language is unknown.
UNKNOWN = 0.03
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/]|$))", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"=\s*([\"'])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Letters of scripts that put no spaces between words, and what ends a sentence.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_END = re.compile(r"[.!?…。！？।۔؟]")


@dataclass
class Block:
    text: str
    links: int
    tag: str
    inside: bool
    outside: bool
    label: str = ""


def _no_part(name: str, in_article: bool) -> bool:
    """Whether a class or id names a part that is not the article's."""
    words = [w.lower() for w in _NAME.findall(name)]
    if any(w in PARTS for w in words):
        return all(w in PARTS or w in FRAME or w in EMPTY for w in words)
    return not in_article and any(w in FRAME for w in words) and all(w in FRAME or w in EMPTY and w not in ARTICLE for w in words)


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the article by its tag or by its class, id and role."""
    if name in OUTSIDE and not (name == "header" and in_article):
        return True
    if name in ("html", "body", "main") or not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and any(_no_part(x, in_article) for x in value.split()):
            return True
    return False


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags; comments and declarations have no name. Elements of raw text end
    with their end tag. Every character is looked at a fixed number of times."""
    at, size = 0, len(html)
    last = {c: html.rfind(c) for c in (">", '"', "'", "-->", "]]>")}
    gone: dict[str, bool] = {}  # raw-text elements that no end tag follows any more
    while (at := html.find("<", at)) >= 0:
        if html.startswith(("<!", "<?"), at):
            mark = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            end = html.find(mark, at + 2) + len(mark) if last[mark] >= at + 2 else size
            yield at, end, "", "", ""
            at = end
            continue
        m = _TAG.match(html, at)
        if m is None:
            at += 1
            continue
        end = begin = m.end()
        while last[">"] >= end:
            close = html.find(">", end)
            value = _VALUE.search(html, end, close)
            if value is None or last[value[1]] < value.end():
                end = close + 1
                break
            end = html.find(value[1], value.end()) + 1
        else:  # no end: an unfinished tag is dropped with what follows
            yield at, size, "", "", ""
            return
        name, attributes = m[2].lower(), html[begin : end - 1]
        if name in DROPPED and not m[1] and not (name in ("svg", "math") and attributes.rstrip().endswith("/")) and name not in VOID:
            if not gone.get(name):
                stop = re.compile(rf"</{name}\s*>", re.I).search(html, end)
                gone[name] = stop is None
                end = stop.end() if stop else size
            else:
                end = size
        yield at, end, m[1], name, attributes
        at = end


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, str]] = []  # tag, inside an article, outside it, nearest block-level tag
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked: list[str] = []
    links = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(held))).strip()
        if text:
            _, inside, outside, tag = stack[-1] if stack else ("", False, False, "")
            own = len(_SPACE.sub(" ", unescape("".join(linked))).strip())
            out.append(Block(text, min(own, len(text)), tag, inside, outside))
        held.clear()
        linked.clear()

    def put(text: str) -> None:
        held.append(text)
        if links:
            linked.append(text)

    at = 0
    for start, end, slash, name, attributes in tags(html):
        put(html[at:start])
        at = end
        if not name:
            continue
        if slash:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                close()
            if opened[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in DROPPED:
            continue
        if name == "br":
            put("\n")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name == "a":
            links += 1
        if name in BLOCKS:
            close()
            links = links if name != "body" else 0
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or name in HEADINGS:  # their end tags may be missing
                same = {"p"} | ({name} if name not in HEADINGS else set()) | ({"dt", "dd"} if name in ("dt", "dd") else set()) | ({"td", "th"} if name in ("td", "th", "tr") else set())
                while stack and (stack[-1][0] in same or stack[-1][0] not in BLOCKS and any(x[0] in same for x in stack[-4:])):
                    pop()
            elif stack and stack[-1][0] == "p":
                pop()
        _, inside, outside, tag = stack[-1] if stack else ("", False, False, "")
        outside = outside or _outside(name, attributes, inside or name == "article")
        inside = inside or name in ("article", "main") or name == "div" and bool(re.search(r"(?:^|\s)role\s*=\s*[\"']?main", attributes, re.I))
        stack.append((name, inside, outside, name if name in BLOCKS else tag))
        opened[name] += 1
    put(html[at:])
    close()
    return out


def _measures(text: str) -> tuple[int, int]:
    """Words of a text, and stop words among them."""
    words = _WORD.findall(text.lower())
    dense = len(_DENSE.findall(text)) if not text.isascii() else 0
    return len(words) + dense // 2, sum(w in STOP_WORDS for w in words)


def classify(found: list[Block]) -> None:
    """Labels good or bad for every block, in two passes."""
    marked = any(b.inside and not b.outside for b in found)
    sizes = [_measures(b.text) for b in found]
    plain = [z for b, z in zip(found, sizes, strict=True) if not b.outside and b.links <= LINKS * len(b.text)]
    unknown = sum(s for _, s in plain) < UNKNOWN * sum(n for n, _ in plain)
    for b, (words, stops) in zip(found, sizes, strict=True):
        stop = stops / words if words else 0.0
        if b.outside or marked and not b.inside:
            b.label = "bad"
        elif b.links > LINKS * len(b.text):
            b.label = "bad"
        elif b.text.startswith(("©", "Copyright ©")):
            b.label = "bad"
        elif words < SHORT:
            b.label = "short"
        elif unknown:
            b.label = "good" if words >= LONG and _END.search(b.text) else "near"
        elif stop >= STOP_HIGH:
            b.label = "good" if words >= LONG else "near"
        elif stop >= STOP_LOW or b.inside:
            b.label = "near"
        else:
            b.label = "bad" if words >= LONG else "short"
    first = [b.label for b in found]
    if marked and "good" not in first:
        for b in found:
            if b.label in ("near", "short") and b.inside:
                b.label = "good"
        return

    def sweep(order: Iterable[int]) -> list[str]:
        """Of every block, the label of the nearest decided one before it in this order."""
        seen, near = "edge", [""] * len(found)
        for i in order:
            near[i] = seen
            if first[i] in ("good", "bad") and not found[i].outside:
                seen = first[i]
        return near

    before, after = sweep(range(len(found))), sweep(range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        sides = {before[i], after[i]}
        if b.inside:
            b.label = "good" if "good" in sides or "edge" in sides else "bad"
        elif b.tag in HEADINGS and after[i] == "good" or sides <= {"good"}:
            b.label = "good"
        elif "good" in sides:
            b.label = "good" if first[i] == "near" or "edge" in sides and b.tag in ("p", "blockquote", "pre", "td") else "bad"
        else:
            b.label = "good" if first[i] == "near" and "bad" not in sides else "bad"


def main_text(html: str | None) -> str:
    found = blocks((html or "").replace("\x00", ""))
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. No shuffle."""
    common.ship(pages.sparkSession)
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(plain.dtypes)
    out = plain.mapInArrow(_run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
