"""Main text of web pages with a site style tree.

The elements of all pages of a host are merged by their path of tags and classes.
For each path the tree knows how its children vary over pages (presentation) and
how the text of its blocks is spread over pages (content). Text that every page
repeats tells nothing, text of one page tells all; a branch's importance combines
the entropy of its own presentation with the mean importance of the blocks below.
Branches of low importance are cut out of each page, beside what tags and classes
mark as furniture.

Pages with the same main text count once in the tree. Where a page has an article or
main element, text outside of it is not main text. A branch that belongs to the
article is only cut where it has a class or id and its blocks hardly differ, or where
a word of its class speaks for furniture and another for something else (menu-review)
and its blocks mostly repeat.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLANK = re.compile(r"[\x20\x09-\x0D]+")
# Elements of HTML by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag closes these open elements, no further up than the scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"})}
CLOSES |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE = set("nav footer aside form button select option dialog menu head label svg audio video canvas object".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MARKED = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead sidebar aside widget widgets related recommended cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login social share sharing comment comments commentlist respond reply replies "
    "disqus pagination pager toc toolbar".split()
)
ARTICLE = {"article", "main"}
# Words beside a marked one that leave its meaning: a class of nothing else is furniture wherever it stands.
NEUTRAL = set(
    "area bar block body box btn button buttons col column container content entry feed footer form group header icon icons inner item items "
    "label left link links list main outer panel placeholder post posts right row section site slot small text title top bottom unit wrap wrapper "
    "article articles story stories page author meta media thread count cta".split()
)
# Ends the name of an element whose class holds a marked word among others; in an article the tree decides on it.
DOUBTFUL = "~"
# A path is taken to have been seen on this many more pages, each with a content of its own: few pages are little evidence.
UNSEEN = 0.5
LOW = 0.25
LOW_IN_ARTICLE = 0.02
GAMMA = 0.9
BROADCAST_BRANCHES = 200_000
# Elements nested deeper are read as if their tags were not there, as browsers do.
MOST_DEPTH = 512


def short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def names_of(attributes: str) -> tuple[list[str], str]:
    """Words of class and id, in lower case with digits left out, and the role."""
    words, role = [], ""
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        value = html.unescape(a or b or c).lower()
        if kind.lower() == "role":
            role = value.strip()
        else:
            words += value.split()
    return words, role


def marks_furniture(words: list[str]) -> tuple[bool, bool]:
    """Whether a word of class or id holds a marked one, and whether one holds nothing of another meaning beside it."""
    parts = [[p for p in re.split(r"[^a-z]+", w) if p] for w in words]
    marked = [p for p in parts if MARKED.intersection(p)]
    return bool(marked), any(MARKED.union(NEUTRAL).issuperset(p) for p in marked)


class Page:
    """Blocks and elements of a page, in its order.

    A block is (path, text, furniture, in the article); an element is (path, names of
    its children with repetitions in a row left out).
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.elements: list[tuple[str, str]] = []
        self.stack = [("", "", False, False, [])]  # tag, path, furniture, article, children
        self.parts: list[str] = []
        self.too_deep: Counter[str] = Counter()
        self._read(source or "")

    def _flush(self) -> None:
        if self.parts:
            text = BLANK.sub(" ", html.unescape("".join(self.parts))).strip(" ")
            self.parts = []
            if text:
                # The block belongs to the nearest block element; inline ones do not part it.
                tag, path, furniture, article, _ = next(e for e in reversed(self.stack) if e[0] in BLOCK or not e[0])
                self.blocks.append((path, text, furniture, article))

    def _pop(self) -> None:
        tag, path, _, _, children = self.stack.pop()
        if tag in BLOCK:
            self.elements.append((path, ",".join(children)))

    def _text(self, text: str) -> None:
        if text:
            # Furniture within a block, such as a button in a paragraph, leaves the block.
            block = next((e[2] for e in reversed(self.stack) if e[0] in BLOCK or not e[0]), False)
            if block or not self.stack[-1][2]:
                self.parts.append(text)

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1][0] in BLOCK:
                self._flush()
            self._pop()

    def _implied(self, tag: str) -> None:
        if tag in BLOCK:
            inner, scope = {"p"}, {"table", "td", "th", "caption", "button", "object"}
            self._close_nearest(inner, scope)
        if tag in CLOSES:
            self._close_nearest(*CLOSES[tag])

    def _close_nearest(self, tags, scope) -> None:
        found = None
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in tags:
                found = depth
                if tags == {"p"} or tags == {"li"}:
                    break
            elif self.stack[depth][0] in scope:
                break
        if found:
            self._close_to(found)

    def _open(self, tag: str, attributes: str) -> None:
        self._implied(tag)
        if tag in BLOCK:
            self._flush()
        elif tag in ("br", "wbr"):
            self.parts += [" "] if tag == "br" and self.parts else []
        if tag in VOID:
            return
        if len(self.stack) > MOST_DEPTH:
            self.too_deep[tag] += 1
            return
        words, role = names_of(attributes) if attributes else ([], "")
        _, path, furniture, article, children = self.stack[-1]
        name = ".".join([tag, *sorted({re.sub(r"\d+", "#", w) for w in words})])
        within = article
        marked, surely = marks_furniture(words) if words and tag not in ("html", "body", "main") else (False, False)
        if marked and within and not surely:
            name += DOUBTFUL
        if not children or children[-1] != name:
            children.append(name)
        article = article or tag in ARTICLE or role in ("main", "article")
        furniture = furniture or tag in FURNITURE or role in ROLES or (tag == "header" and not article)
        furniture = furniture or (surely if within else marked)
        self.stack.append((tag, f"{path}/{name}", furniture, article, []))

    def _end(self, tag: str) -> None:
        if self.too_deep[tag]:
            self.too_deep[tag] -= 1
            if tag in BLOCK:
                self._flush()
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self._close_to(depth)
                return
            if self.stack[depth][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break  # an end tag without a start inside a cell closes nothing outside of it
        if tag in BLOCK:
            self._flush()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = TOKEN.search(source, at)
            if not found:
                break
            self._text(source[at : found.start()])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW:
                # Nothing in it is markup up to its own end tag.
                ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = ends.end() if ends else len(source)
            else:
                self._open(tag, attributes)
        self._text(source[at:])
        self._flush()
        self._close_to(1)
        self._pop()

    def main_blocks(self) -> list[tuple[str, str, bool]]:
        """(path, text, in the article) of blocks outside furniture; of the article alone if there is one."""
        blocks = [(p, t, a) for p, t, furniture, a in self.blocks if not furniture]
        return [b for b in blocks if b[2]] or blocks


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def tree_rows(pages: DataFrame) -> DataFrame:
    """What each page adds to its host's tree: host, page (digest of its main text), path, kind, digest, article.

    ``kind`` is block or element; the digest is that of a block's text or of an element's children.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for host, source in zip(frame["host"], frame["html"]):
                page = Page(source)
                digest = short("\n".join(t for _, t, _ in page.main_blocks()))
                rows += [(host, digest, p, True, short(t), a) for p, t, furniture, a in page.blocks if not furniture]
                rows += [(host, digest, p, False, short(c), False) for p, c in page.elements if c]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "page", "path", "block", "digest", "article"])

    return pages.select("host", "html").mapInPandas(run, "host string, page long, path string, block boolean, digest long, article boolean")


def importances(rows: DataFrame) -> DataFrame:
    """host, branch, article and importance of every branch with a block below it.

    A content seen on c of the m pages of a path has entropy log c / log (m + ``UNSEEN``), a
    path's content importance is one less the mean over its blocks: one that all pages repeat
    counts for more the fewer the pages are. Presentation importance is the entropy of the
    children's names over the pages, to the base m. A branch takes both, the more from the
    blocks below the fewer styles it has. Nothing is repeated on a single page, so nothing of
    it is of low importance.
    """
    seen = rows.groupBy("host", "path", "block", "digest", "page").agg(F.max("article").alias("article"))
    counts = seen.groupBy("host", "path", "block", "digest").agg(F.count("*").alias("c"), F.max("article").alias("article"))
    pages = seen.select("host", "path", "block", "page").distinct().groupBy("host", "path", "block").agg(F.count("*").alias("m"))
    spread = F.log("c") / F.log(F.col("m") + UNSEEN)
    share = F.col("c") / F.col("m")
    # Only how many contents there are of each count matters: a few rows for a path, however many pages it has.
    kinds = counts.groupBy("host", "path", "block", "c").agg(F.count("*").alias("k"), F.max("article").alias("article"))
    with_m = kinds.join(pages, ["host", "path", "block"])
    seen_on = F.col("k") * F.col("c")
    content = (
        with_m.where("block")
        .groupBy("host", "path")
        .agg(F.sum(seen_on * (1 - spread)).alias("told"), F.sum(seen_on).alias("n"), F.max("article").alias("article"))
    )
    presentation = (
        with_m.where("not block")
        .groupBy("host", "path")
        .agg(
            F.max(F.when(F.col("m") > 1, 0.0).otherwise(1.0)).alias("alone"),
            F.sum(F.when(F.col("m") > 1, -F.col("k") * share * F.log(share) / F.log("m")).otherwise(0.0)).alias("varied"),
            F.sum("k").alias("styles"),
        )
    )
    # Every block counts for all branches above it.
    depth = F.size(F.split("path", "/"))
    above = content.withColumn("upto", F.explode(F.sequence(F.lit(2), depth))).select(
        "host", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("upto")), "/").alias("branch"), "told", "n", "article"
    )
    below = above.groupBy("host", "branch").agg((F.sum("told") / F.sum("n")).alias("content"), F.max("article").alias("article"))
    both = below.join(presentation.withColumnRenamed("path", "branch"), ["host", "branch"], "left")
    kept = F.pow(F.lit(GAMMA), F.coalesce("styles", F.lit(0)))
    importance = (1 - kept) * F.coalesce(F.greatest("alone", "varied"), F.lit(0.0)) + kept * F.col("content")
    return both.select("host", "branch", "article", importance.alias("importance"))


def low_branches(rows: DataFrame) -> DataFrame:
    """host and the array of its paths of low importance; hosts without one have no row."""
    last = F.element_at(F.split("branch", "/"), -1)
    bound = F.when(~F.col("article") | last.endswith(DOUBTFUL), LOW).when(last.contains("."), LOW_IN_ARTICLE).otherwise(-1.0)
    return importances(rows).where(F.col("importance") < bound).groupBy("host").agg(F.collect_set("branch").alias("low"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row's id, url and ``text``: its main blocks in page order, joined by two newlines.

    White space (space and 0x09 to 0x0D) inside a block becomes one space. A null
    or empty page has an empty text. Rows without a url share a tree. Repeated
    rows give repeated results; other columns are not read. A host's pages are
    weighed from the second one on, with what they say growing with their number.
    """
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")
    )
    # Written, as several aggregations read the rows; pages are not parsed for each of them.
    low = written(low_branches(written(tree_rows(source), "tree-rows")), "low-branches")
    size = low.agg(F.sum(F.size("low"))).first()[0] or 0
    # Pages stay where they are while the branches to cut are few; beyond that they meet by host.
    joined = source.join(F.broadcast(low) if size <= BROADCAST_BRANCHES else low, "host", "left").select("id", "url", "html", "low")
    kind = source.schema["id"].dataType.simpleString()

    def text(source, low) -> str:
        cut = set() if low is None else set(low)
        kept = []
        for path, block, _ in Page(source).main_blocks():
            steps = path.split("/")
            if not cut or not any("/".join(steps[:i]) in cut for i in range(2, len(steps) + 1)):
                kept.append(block)
        return "\n\n".join(kept)

    def run(batches):
        for batch in batches:
            found = [text(h.as_py(), w.as_py()) for h, w in zip(batch.column("html"), batch.column("low"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string())], ["id", "url", "text"])

    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_extract(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_extract": op7_html_extract}
