"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of branches (paths of tags with their classes). For every
branch two entropies over the host's distinct pages tell its importance: how varied its presentation is
(child tags, share of links) and how specific its content is (1 - log df / log m for a block of text seen
on df of m pages). Branches of low importance are the site's frame and are removed from each page,
together with what the markup itself names as frame (navigation, forms, scripts, adverts, comments).
Unmarked text inside an article is never removed: copies of one article are no frame.

Features are counted per (host, branch, feature) with partial sums, so a host with a third of all pages
is spread over its branches and features; only branches of low importance come back to the pages.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, small_side, staged

#: A branch is judged on so many distinct pages of its host at least, and is frame below this importance.
MIN_PAGES, MIN_IMPORTANCE, CONTENT_WEIGHT = 8, 0.3, 0.8

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_MARKS = re.compile(r"[a-z]+")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr".split())
_FRAME = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "object", "audio", "video", "canvas", "menu", "dialog", "fieldset"}
_MAIN = {"article", "main"}
#: Words of class and id names that mark frame; those of the second set only outside an article.
_NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe subscription sidebar sidenav widget related recommended nav navbar navigation breadcrumb breadcrumbs menu "
    "comment comments disqus respond share sharing social login signup footer toolbar pagination pager skip".split()
)
_NOISE_OUTSIDE = {"header", "masthead", "banner", "topbar", "top", "side", "search", "hero", "alert"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert", "toolbar"}


class Block:
    __slots__ = ("path", "main", "marked", "text", "style")

    def __init__(self, path, main, marked, text, style):
        self.path, self.main, self.marked, self.text, self.style = path, main, marked, text, style


def blocks(page: str) -> list[Block]:
    """Blocks of text outside what the markup names as frame, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, frame, main, marked
    parts: list[str] = []
    inline: list[str] = []

    def flush():
        if parts:
            _, path, frame, main, marked = stack[-1] if stack else ("", "", False, False, False)
            if not frame:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    out.append(Block(path, main, marked, text, " ".join(sorted(set(inline)))))
            parts.clear()
        inline.clear()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                parts.append(entities.escape(m["cdata"]))
            continue
        name = name.lower()
        if m["end"]:
            if name in _INLINE and not any(x[0] == name for x in stack[-3:]):
                continue
            if name == "br" or any(x[0] == name for x in stack):
                flush()
                if name != "br":
                    while stack.pop()[0] != name:
                        pass
            continue
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            continue
        _, path, frame, main, marked = stack[-1] if stack else ("", "", False, False, False)
        classes, noise = [], name in _FRAME or (name == "header" and not main)
        for key, a, b, c in _ATTR.findall(m["attrs"]) if m["attrs"] else ():
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                words = _MARKS.findall(value)
                classes += words
                noise = noise or not _NOISE.isdisjoint(words) or (not main and not _NOISE_OUTSIDE.isdisjoint(words))
            elif key == "role":
                noise = noise or value in _ROLES
                main = main or value == "main"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                noise = True
        if name in ("body", "html"):
            noise = False
        noise = noise and name not in _MAIN
        if name in _INLINE:
            inline.append(name)
            if not noise:
                continue
        flush()
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"):
            if stack and stack[-1][0] == name or name[0] == "h" and stack and stack[-1][0] == "p":
                stack.pop()
                _, path, frame, main, marked = stack[-1] if stack else ("", "", False, False, False)
        elif stack and stack[-1][0] == "p":
            stack.pop()
            _, path, frame, main, marked = stack[-1] if stack else ("", "", False, False, False)
        main = main or name in _MAIN
        branch = f"{path}/{name}.{'.'.join(sorted(classes))}" if classes else f"{path}/{name}"
        stack.append((name, branch, frame or noise, main, (marked or bool(classes)) and name not in _MAIN))
    parts.append(page[at:])
    flush()
    return out


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _features(batches):
    """A row for each block of each page: its branch, presentation and content as hashes."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = blocks(page)
            whole = _key("\n".join(x.text for x in found))
            children: dict[str, list[str]] = {}
            for x in found:
                children.setdefault(x.path, []).append(x.style)
            styles = {k: _key("|".join(dict.fromkeys(v))) for k, v in children.items()}
            rows += {(host, _key(x.path), styles[x.path], _key(x.text), whole) for x in found if x.marked or not x.main}
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "style", "content", "page"])


def frame_branches(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of the branches that ``pages`` (host, html) show to be their host's frame."""
    rows = pages.mapInArrow(_features, "host string, path long, style long, content long, page long").distinct()
    rows = staged(rows, "features")
    seen = rows.groupBy("host", "path").agg(F.count_distinct("page").alias("m")).where(F.col("m") >= MIN_PAGES)
    content = rows.groupBy("host", "path", "content").agg(F.count_distinct("page").alias("df"))
    style = rows.select("host", "path", "style", "page").distinct().groupBy("host", "path", "style").count()
    specific = content.join(seen, ["host", "path"]).groupBy("host", "path", "m").agg(
        (F.sum(F.col("df") * (1 - F.log("df") / F.log("m"))) / F.sum("df")).alias("content")
    )
    varied = style.join(seen, ["host", "path"]).withColumn("p", F.col("count") / F.col("m"))
    varied = varied.groupBy("host", "path").agg(F.sum(-F.col("p") * F.log("p") / F.log("m")).alias("presentation"))
    importance = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.least(F.col("presentation"), F.lit(1.0))
    out = specific.join(varied, ["host", "path"]).select("host", "path", importance.alias("importance"))
    return out.where(F.col("importance") < MIN_IMPORTANCE)


def main_text(page: str, frame: set[int]) -> str:
    """Text of ``page`` without its frame: the articles if it has any, else everything."""
    found = blocks(page)
    if any(x.main for x in found):
        found = [x for x in found if x.main]
    return " ".join(x.text for x in found if not (frame and (x.marked or not x.main) and _key(x.path) in frame))


def _texts(batches):
    for batch in batches:
        texts, frames = [], batch.column("frame").to_pylist()
        for page, frame in zip(batch.column("html").to_pylist(), frames):
            texts.append(main_text(page, set(frame or ())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html has the text ''. Pages with a null url share the host ''. Null ids and repeated rows
    keep their rows; extra columns are ignored; an empty table gives an empty result.
    """
    pages = plain(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    frame = staged(frame_branches(pages.select("host", "html")), "frame")
    lists = frame.groupBy("host").agg(F.collect_list("path").alias("frame"))
    lists = small_side(lists) if frame.count() <= 500_000 else lists
    return pages.join(lists, "host", "left").select("page_id", "url", "html", "frame").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
