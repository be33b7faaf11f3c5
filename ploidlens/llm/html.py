"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page becomes a sequence of tokens. Words score positive and tags negative, with weights that are
log odds of each kind of token inside and outside the main text of labelled pages: pages that mark it themselves,
by an article or main element. A bounded sample of the table's own such pages is used (PAGES, those with the
smallest hashes, whole); a table without any gets the weights of a few made by a rule. A page's text doesn't
depend on its own marks but by these weights. One linear scan (Kadane) finds the contiguous region of the highest sum.
Of the region, elements known as furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments, ...) by tag, role, class or id are left out: their words and tags score nothing, so they don't cut it.

A block is the text between block-level tags. Character references are decoded, white space within
a block becomes one space, blocks are joined by a newline in page order. Nothing else is dropped.

Null or empty html, and pages without words outside furniture: "". Text without any tag is its own
main text. Broken markup (unclosed tags, quotes, comments) is read to its end in linear time. Rows
are kept one by one, repeated or not; extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.llm import common as C

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*)((?:[^><"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([A-Za-z][^\s/><]*)([^>]*)(?:>|$)|<!--|<[!?/][^>]*(?:>|$)""")
ATTR = re.compile(r"""(?i)(?:^|[\s"'])(class|id|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "audio", "video"}
RAW_END = {t: re.compile(rf"(?i)</{t}\b[^>]*(?:>|$)") for t in RAW}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are furniture, and words in a class, id or role that make one so.
FURNITURE = set("nav header footer aside form menu dialog button select option datalist fieldset label head".split())
NAMES = set("nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar aside complementary rail footer contentinfo colophon copyright header masthead banner topbar toolbar ad ads advert adverts advertisement adsense adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus discussion related recommended recommendations widget search searchbox form tags skip hidden".split())
#: Names that also occur for parts of an article ("article-header", "post-footer"): there only as the whole name.
CONTENT = set("article content post entry main story body text page".split())
#: Names that make furniture of containers only, as headings and paragraphs of an article may have them, too; and of no element as id.
AMBIGUOUS = set("search notice notices alert related tags share sharing form widget skip comment comments reply replies login social rail menu notification discussion copyright subscription masthead".split())
AS_ID = {"discussion", "search", "notice", "notices", "related", "tags"}
#: Elements followed by depth; others only if they are furniture by name.
CONTAINERS = set("div section article main nav header footer aside form menu dialog table ul ol dl figure fieldset details body head blockquote button select".split())


def furniture(tag: str, attrs: str) -> bool:
    if not attrs:
        return tag in FURNITURE
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = NAME.findall(name)
                if tag not in CONTAINERS and not AMBIGUOUS.isdisjoint(parts) or key == "id" and name in AS_ID and tag in ("section", "article"):
                    continue
                if not NAMES.isdisjoint(parts) and (len(parts) == 1 or CONTENT.isdisjoint(parts) or not NAMES.isdisjoint(set(parts) - {"header", "footer", "form", "tags", "banner", "text"})):
                    return True
    return tag in FURNITURE


def tokens(html: str):
    """(kind, text, block, kept): kinds are tags, "word" (a run of words), "link" and "other"; block counts block breaks; kept tells what is outside furniture (its own tags are inside)."""
    at, block, n, stack, bad, article = 0, 0, len(html), [], 0, 0
    links = 0
    heading = 0
    while at < n:
        m = TAG.search(html, at)
        end = m.start() if m else n
        if end > at:
            text = html[at:end]
            kept = not bad or (heading and article and all(x[0] == "header" for x in stack if x[1]))
            yield ("other" if not kept else "link" if links else "word"), text, block, kept
        if not m:
            return
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        close, attrs = (m[1] or m[4] or "") == "/", m[3] or m[6] or ""
        if tag in RAW and not close:
            if not attrs.endswith("/") or tag != "svg":
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            block += 1
        single = tag in VOID or attrs.endswith("/")
        if close or single:
            yield ("/" if close else "") + tag, "", block, not bad
        if tag == "a":
            links = 0 if close else 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = 0 if close else 1
        if single:
            continue
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    bad -= sum(x[1] for x in stack[k:])
                    article -= sum(x[0] in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    break
                if tag not in CONTAINERS and stack[k][0] in CONTAINERS:
                    break
        else:
            if tag in BLOCK and stack and stack[-1][0] == "p":
                bad -= stack.pop()[1]
            f = furniture(tag, attrs)
            if tag == "body" or tag == "html":
                f = False
            if tag == "body" and stack and stack[-1][0] == "head":
                bad -= stack.pop()[1]
            if tag == "li" and stack and stack[-1][0] == "li":
                bad -= stack.pop()[1]
            if f or tag in CONTAINERS:
                stack.append((tag, f))
                bad += f
                article += tag in ("article", "main")
            yield tag, "", block, not bad


def _labelled() -> list[tuple[str, bool]]:
    """Labelled pages by a rule: (piece of a page, whether it is of the main text)."""
    words = "one reads here what the writer of this long and quiet story has to say about it all".split()
    text = lambda n: " ".join(words[k % len(words)] for k in range(n))
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(words[:7])) + "</ul>"
    link = '<div><a href="/x">one two</a> <span>three</span></div>'
    out = []
    for k, wrap in enumerate(("article", "main", "div", "section", "td")):
        out += [("<html><head><meta charset=x><link rel=y></head><body>", False), (f"<header><div><img src=x><a href=/>{text(2)}</a></div></header><nav>{menu}</nav>", False), (f"<div>{menu}</div><div>{link}{link}</div>", False)]
        paras = "".join(f"<p>{text(30 + 9 * j)} <a href=/y>{text(2)}</a> {text(9)} <b>{text(3)}</b><br>{text(12)}</p>" for j in range(3 + k))
        out += [(f"<{wrap}>", False), (f"<h1>{text(7)}</h1>{paras}<h2>{text(4)}</h2><ul><li>{text(12)}</li><li>{text(15)}</li></ul><blockquote><p>{text(20)}</p></blockquote>", True), (f"</{wrap}>", False)]
        out += [(f"<aside><h3>{text(2)}</h3>{menu}</aside><form><input><label>{text(2)}</label><button>{text(1)}</button></form><div>{link}{link}{link}</div><footer><p>{text(6)}</p>{menu}</footer></body></html>", False)]
    return out


def marked(html: str) -> list[tuple[str, int, bool]]:
    """Kinds of tokens of a page that marks its main text, with numbers of words (tags: 1) and whether they are in it."""
    out, depth = [], 0
    for kind, text, _, kept in tokens(html):
        depth += (kind in ("article", "main")) - (kind in ("/article", "/main"))
        out.append((kind, len(text.split()) if text else 1, kept and depth > 0 and kind not in ("article", "main")))
    return out if any(inside for _, _, inside in out) else []


def fit(found: list[tuple[str, int, bool]]) -> dict[str, float]:
    """Weights of kinds of tokens: log odds within and outside the main text; of tags below 0, of words above."""
    inside, outside = Counter(), Counter()
    for kind, n, main in found:
        (inside if main else outside)[kind] += n
    a, b = max(1, sum(inside.values())), max(1, sum(outside.values()))
    out = {k: math.log((inside[k] + 0.5) / a) - math.log((outside[k] + 0.5) / b) for k in {*inside, *outside}}
    out = {k: min(MOST, max(0.1, v)) if k in ("word", "link") else 0.0 if k == "other" else min(-0.1, max(LEAST, v)) for k, v in out.items()}
    return {"word": 0.1, "link": 0.1, "other": 0.0} | out


#: Tags seen only outside the main text count no less than this; tags never seen count UNSEEN; words count MOST at most.
LEAST, UNSEEN, MOST = -1.2, -0.5, 4.0
#: Pages that the weights are learned from at most.
PAGES = 200
WEIGHTS = fit([(kind, len(text.split()) if text else 1, main) for page, main in _labelled() for kind, text, _, _ in tokens(page)])


def region(seq: list, weights: dict[str, float] = WEIGHTS) -> tuple[int, int]:
    """Where the contiguous region of the highest sum begins and ends; the first of equal ones."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for k, (kind, text, _, kept) in enumerate(seq):
        gain = 0.0
        if kept:
            gain = weights[kind] * len(text.split()) if text else weights.get(kind, UNSEEN)
        if here <= 0 and gain > 0:
            here, start = 0.0, k
        here += gain
        if here > best:
            best, found = here, (start, k + 1)
    return found


def extract(html: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The main text of a page."""
    if not html:
        return ""
    seq = list(tokens(html))
    a, b = region(seq, weights)
    blocks: list[str] = []
    last = None
    while a and seq[a - 1][2] == seq[a][2]:  # whole blocks
        a -= 1
    while 0 < b < len(seq) and seq[b][2] == seq[b - 1][2]:
        b += 1
    for kind, text, block, kept in seq[a:b]:
        if not text:
            if blocks and block == last and kind in ("br", "td", "/td", "th", "/th", "img"):
                blocks[-1] += " "
            continue
        if not kept:
            continue
        if block == last:
            blocks[-1] += text
        else:
            blocks.append(text)
            last = block
    return "\n".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b)


def learned(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from PAGES different pages of the table that mark their main text; those of WEIGHTS if none does."""
    h = F.col(f"`{html_col}`")
    rows = pages.filter(h.rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(h).alias("h"), h.alias("html"))
    few = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(PAGES).collect()]
    if not few:
        return WEIGHTS
    got = rows.filter(F.col("h").isin(few)).groupBy("h").agg(F.min("html").alias("html")).collect()  # PAGES rows at most
    found = [x for r in got for x in marked(r["html"])]
    return fit(found) if found else WEIGHTS


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page: id_col, url_col, text and n_chars."""
    weights = learned(pages, html_col)

    def run(batches):
        for b in batches:
            text = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), html_col).mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")


def op1_html_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(C.documents(spark, sf_dir, "pages"))
