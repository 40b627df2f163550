"""HTML main text by a site style tree.

The pages of a host are merged into one tree of element paths (tag and class), articles included. A node's content importance
is the entropy of its texts over the pages that have it, its presentation importance that of the styles of its children: what
recurs alike on the pages of a host carries little. Nodes that both say little of are noise, on every page. Names decide the
rest: menus, headers, footers, asides, notices, adverts, forms and comments are noise by tag, role, or a whole class or id.
Such a branch stays, though, if it has over half of the page's unique text, which is what the tree does not call noise, or
the page's largest article where no article is outside such branches; the tree then decides inside it. If an article (or main)
has text left, only articles are kept. A page that the tree would empty keeps what names leave. Entropies are counted in Spark,
and only the noise goes back to the pages.

Blocks are what block elements enclose; inline elements and <br> do not end them. Character references are decoded, white
space becomes single spaces, blocks are joined by a line feed.

Defined results: a null or empty html has an empty text. A null url is a host of its own. Rows that repeat are each done.
Columns of the input named text or n_chars are replaced. A tag without ">" is text. A quote that is never closed ends with its tag.
Scripts, styles, titles and the like without an end tag lose their tag only. A host with one page has no entropy: there names
alone decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, stage, table

#: A tag's name and attributes. A quote is one only after "=", and only where it is closed.
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|\Z)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("nav header footer aside form button select dialog menu object canvas audio video head".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promotion related recommended register search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
MAIN_ROLES = frozenset(("article", "main"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog".split())

#: A page alone has no entropy.
LOW, PAGES = 0.2, 2


def noisy(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is noise by its names, whether it is hidden, and its style for the tree."""
    noise, hidden, style = tag in NOISE_TAGS and not (inside and tag == "header"), False, tag
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            found = NOISE_NAMES.intersection(value.split())
            noise |= bool(found - {"header"} if inside else found) and tag not in ("body", "html", "main")
            if name == "class":
                style += "." + ".".join(sorted(value.split()))
        elif name == "role":
            noise |= value in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return noise, hidden, style


class Scanner:
    """The tags of a page in order, in time linear in its length whatever is unbalanced in it."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.odd = False  # a tag whose quotes swallow the rest of the page: from there on a tag ends at the first ">"
        self.ends: dict[str, int] = {}

    def tag(self, at: int) -> tuple[int, bool, str, str] | None:
        """End, whether it closes, name and attributes of the tag at `at`; without name for comments and the like; None: text."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), False, "", ""
        if at > self.last:
            return None
        if page.startswith(("<!", "<?"), at):
            return page.index(">", at) + 1, False, "", ""
        m = None if self.odd else TAG.match(page, at)
        if m:
            return m.end(), page[at + 1] == "/", m[1].lower(), m[2]
        close = page.startswith("/", at + 1)
        if not page[at + 1 + close : at + 2 + close].isalpha():
            return None
        self.odd = True
        end = page.index(">", at) + 1
        name, _, rest = page[at + 1 + close : end - 1].partition(" ")
        return end, close, name.strip("/\t\r\n\f").lower(), rest

    def after(self, tag: str, at: int) -> int:
        """Where the raw content of an element ends that begins at `at`: after its end tag, or where there is none at once."""
        if self.ends.get(tag, at) < at or tag not in self.ends:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
            self.ends[tag] = m.end() if m else len(self.page) + 1
        return self.ends[tag] if self.ends[tag] <= len(self.page) else at


class Page:
    """found: the blocks with text that are not hidden, as path, text, branch, article. A branch is the number of the innermost
    element above that is noise by name (0: none), above[branch] the next one around it; an article is the number of the outermost
    one (0: none), around[article] the branch it is in. children: the styles of each path's children. Paths are hashes."""

    def __init__(self, page: str):
        self.found: list[tuple[int, str, int, int]] = []
        self.children: dict[int, list[str]] = {}
        self.above, self.around = [0], [0]
        stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]
        opened: Counter[str] = Counter()
        parts: list[str] = []
        scan, at, n = Scanner(page), 0, len(page)

        def end() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text and not stack[-1][4]:
                    self.found.append((stack[-1][1], text, stack[-1][2], stack[-1][3]))
                parts.clear()

        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                parts.append(page[at:])
                break
            if begin > at:
                parts.append(page[at:begin])
            tag = scan.tag(begin)
            if tag is None:
                parts.append("<")
                at = begin + 1
                continue
            at, close, name, attributes = tag
            if not name:
                continue
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                continue
            end()
            if close:
                if opened[name]:
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == name:
                            break
                continue
            closed = attributes.rstrip().endswith("/")
            if name in RAW:
                if not closed:
                    at = scan.after(name, at)
                continue
            if name in VOID or closed:
                continue
            if name in ENDS_P and stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                opened[stack.pop()[0]] -= 1
            _, path, branch, inside, hidden = stack[-1]
            noise, hides, style = noisy(name, attributes, inside > 0)
            if noise:
                self.above.append(branch)
                branch = len(self.above) - 1
            if not inside and not noise and (name in MAIN_ROLES or MAIN.search(attributes)):
                self.around.append(branch)
                inside = len(self.around) - 1
            self.children.setdefault(path, []).append(style)
            opened[name] += 1
            stack.append((name, path_of(path, style), branch, inside, hidden or hides))
        end()


MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)


def path_of(parent: int, style: str) -> int:
    return int.from_bytes(blake2b(f"{parent} {style}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def kept(page: str, low: set[int]) -> list[str]:
    """The texts of a page's main blocks; low: its host's noise."""
    read = Page(page)
    found = read.found
    unique = [0 if p in low else len(t) for p, t, _, _ in found]
    of_branch, of_article = [0] * len(read.above), [0] * len(read.around)
    for n, (_, _, branch, article) in zip(unique, found, strict=True):
        of_branch[branch] += n
        of_article[article] += n
    for k in range(len(of_branch) - 1, 0, -1):
        of_branch[read.above[k]] += of_branch[k]
    total = sum(unique)
    stay = [k == 0 or 2 * n > total for k, n in enumerate(of_branch)]

    def fine() -> list[bool]:
        out = [True] * len(stay)
        for k in range(1, len(stay)):
            out[k] = stay[k] and out[read.above[k]]
        return out

    good = fine()
    articles = {x[3] for x in found if x[3]}
    if articles and not any(good[read.around[k]] for k in articles):
        k = read.around[max(articles, key=lambda k: (of_article[k], -k))]
        while k:
            stay[k] = True
            k = read.above[k]
        good = fine()
    named = [x for x in found if good[x[2]]]
    told = [x for x in named if x[0] not in low] or named
    return [t for _, t, _, _ in ([x for x in told if x[3]] or told)]


def host_of(c: str) -> Column:
    return F.lower(F.regexp_extract(F.col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def site_noise(pages: DataFrame, low: float = LOW, least: int = PAGES) -> DataFrame:
    """(host, path): nodes with text whose content and presentation importance are below `low` on at least `least` pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, str, bool]] = []
            for h, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                read = Page(x)
                seen = {(p, t) for p, t, _, _ in read.found}
                rows += [(h, p, t, False) for p, t in seen] + [(h, p, ">".join(read.children.get(p, ())), True) for p in {p for p, _ in seen}]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "path", "value", "page"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, path long, value string, page boolean")
    count = seen.groupBy("host", "path", F.xxhash64("value").alias("k"), "page").count()
    # A row of `page` for each page that has the node, its value the node's presentation; the others are its texts.
    m = F.sum(F.when(F.col("page"), F.col("count")))
    same = [F.sum(F.when(x, F.col("count") * F.ln("count"))) / F.sum(F.when(x, F.col("count"))) for x in (~F.col("page"), F.col("page"))]
    node = count.groupBy("host", "path").agg(m.alias("m"), same[0].alias("content"), same[1].alias("presentation"))
    importance = F.greatest(*(1 - F.col(x) / F.ln("m") for x in ("content", "presentation")))
    return node.where(F.col("m") >= max(least, 2)).where(importance < low).select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    own = {x: free(x, pages.columns) for x in ("host", "noise", "h")}
    rows = pages.select(*(F.col(f"`{c}`") for c in names), F.coalesce(host_of("url"), F.lit("")).alias(own["host"]))
    noise = site_noise(rows.select(F.col(own["host"]).alias("host"), F.coalesce("html", F.lit("")).alias("html")))
    by_host = stage(noise.groupBy("host").agg(F.collect_set("path").alias(own["noise"])), "op7-noise")  # 8 bytes for each style that recurs on a site

    @F.pandas_udf("string")
    def extract(html: pd.Series, noise: pd.Series) -> pd.Series:
        out = ["\n".join(kept(page, set(low) if low is not None else set())) for page, low in zip(html, noise, strict=True)]
        return pd.Series(out, dtype=object)

    joined = rows.join(by_host.withColumnRenamed("host", own["h"]), F.col(own["host"]) == F.col(own["h"]), "left")
    text = extract(F.coalesce("html", F.lit("")), own["noise"])
    out = joined.select(*(F.col(f"`{c}`") for c in names), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
