"""Main text of web pages: site templates removed.

Every page is read twice. The first reading hashes each element subtree (its tag and all that is in it) and Spark counts, per
host, on how many different contents a subtree occurs; copies of a page count once. The second reading deletes the template:

1. subtrees on at least TEMPLATE_SHARE of the host's contents, and no fewer than TEMPLATE_LEAST;
2. block elements of TEMPLATE_WORDS words and more on at least RECUR_SHARE of the host's contents, and no fewer than RECUR_LEAST.
   Near copies of an article are different contents too. So only contents bear witness of which no more than half the words stand
   in subtrees that recur as often; paragraphs that near copies share have none. Shorter texts and inline elements (a table cell,
   a link) recur in articles by themselves, and paragraphs of article and main elements (PARAGRAPHS) may be passages or license
   lines that articles share; where they stand they bear no witness, so they fall under the first rule alone.

A host has at most 1 / RECUR_SHARE times as many such subtrees as its mean page has subtrees, so their list per host is bounded.

Elements whose tag, role, class or id says that they are not the article (menus, footers, forms, adverts, comments and the like)
are left out in both readings. Names count by their parts, but names of states ("no-sidebar", "comments-open") don't. Class and id
don't leave out main, an article outside of others, or what holds main; an element with such a name that holds an article is left
out only if the page has an article or main elsewhere. If a page has article elements, or else main elements, only these are read; other pages are
read whole. A block ends at every block element and line break; text of blocks is trimmed and joined by one space.

Null html is empty, with empty text. Pages without a host are one host. Broken markup never fails: what is not a tag is text,
end tags without a start are ignored, and open elements end with the page. Very long pages are parsed in the one
task that reads them, and repeated rows are read alike. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.llm.words import pieces
from molweave.sources.scratch import stored

TEMPLATE_SHARE = 0.5
TEMPLATE_LEAST = 5
RECUR_SHARE = 0.001
RECUR_LEAST = 20
TEMPLATE_WORDS = 5
# Template subtrees that may be broadcast, of 8 bytes each and their hosts' names; parts of a host's pages beyond that.
BROADCAST_TEMPLATES = 500_000
SALTS = 64

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
LEFT_OUT = frozenset(
    "head script style title noscript template iframe nav footer aside form button select textarea input dialog menu svg canvas "
    "object audio video map datalist".split()
)
# A start tag of the first kind ends an open element of the second.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
LISTS = frozenset("ul ol dl table select".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figure figcaption".split())
KEPT_ALWAYS = frozenset(("html", "body", "main", "article"))
# Parts of class and id names, and roles, of elements that are not the article.
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended "
    "related replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
# One attribute with its value; a quoted value is skipped as a whole.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
_NAMED = re.compile(r"class|id|role|hidden", re.I)
_PARTS = re.compile(r"[_-]+")
# First and last parts of names that tell the state of a page or block.
STATES_FIRST = frozenset("no not non has have with without is".split())
STATES_LAST = frozenset("open opened closed enabled disabled on off active inactive visible hidden allowed shown loaded ready".split())
# How an element is left out: by its class or id, or by its tag, role or hidden.
BY_NAME, BY_KIND = 1, 2


def not_article(tag: str, attributes: str, inside: bool) -> int:
    """BY_NAME or BY_KIND for an element that is left out, else 0; ``inside`` tells if an article is open."""
    if tag in KEPT_ALWAYS:
        if tag != "article" or not attributes:
            return 0
        why = _named(attributes, inside)
        return why if inside or why == BY_KIND else 0
    if tag in LEFT_OUT or (tag == "header" and not inside):
        return BY_KIND
    return _named(attributes, inside) if attributes else 0


def _named(attributes: str, inside: bool) -> int:
    if not _NAMED.search(attributes):
        return 0
    seen: set[str] = set()
    why = 0
    for found in _ATTRIBUTE.finditer(attributes):
        name = (found[1] or "").lower()
        # Of an attribute that is given twice, the first counts.
        if name not in ("class", "id", "role", "hidden") or name in seen:
            continue
        seen.add(name)
        value = html.unescape(found[2] or found[3] or found[4] or "").lower()
        if name == "hidden" or (name == "role" and value.strip() in ROLES):
            return BY_KIND
        if name in ("class", "id") and any(_tells(word, inside) for word in value.split()):
            why = BY_NAME
    return why


def _tells(word: str, inside: bool) -> bool:
    """True for a class or id of an element that is not the article."""
    parts = [p for p in _PARTS.split(word) if p]
    if len(parts) > 1 and (parts[0] in STATES_FIRST or parts[-1] in STATES_LAST):
        return False
    return not NAMES.isdisjoint(parts) or ("header" in parts and not inside)


@dataclass
class Element:
    tag: str
    start: int
    out: int
    parts: list = field(default_factory=list)
    own: int = 0
    words: int = 0


class Reader:
    """Reads one page. ``removed`` are the hashes of subtrees to delete; ``subtrees`` collects those that are seen.

    A subtree has the number of words that are its own, not an inner element's, and if it may be a template by the second rule.
    ``loose`` are the words that stand in no subtree.
    """

    def __init__(self, removed: frozenset[int] | set[int] = frozenset(), lenient: bool = False):
        self.removed = removed
        # With ``lenient``, class and id don't leave out what holds an article.
        self.lenient = lenient
        self.found = self.held = 0
        self.subtrees: dict[int, tuple[int, bool]] = {}
        self.loose = 0
        self.text: list[str] = []
        self.kept: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.open: list[Element] = []
        self.left_out = self.by_kind = 0
        self.articles = 0
        self.counts: dict[str, int] = {}

    def read(self, page: str) -> str:
        text = self._read(page)
        if self.held and not self.found:
            # All articles stand in elements that are left out by class or id.
            self.__init__(self.removed, lenient=True)
            text = self._read(page)
        return text

    def _read(self, page: str) -> str:
        at, low = 0, None
        for_raw = None
        while True:
            if for_raw is not None:
                # No markup inside: the element ends at its own end tag.
                low = low or page.lower()
                end = low.find(f"</{for_raw}", at)
                at = len(page) if end < 0 else end
                for_raw = None
            tag = _TAG.search(page, at)
            self._text(page[at : tag.start() if tag else len(page)])
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                if tag[0].startswith("<![CDATA["):
                    self._text(tag[0][9:-3], raw=True)
                continue
            if tag[1] or tag[4]:
                self._end(name)
            else:
                attributes = tag[3] or tag[6] or ""
                self._start(name, attributes)
                if name in RAW and self.counts.get(name):
                    for_raw = name
        while self.open:
            self._close()
        for name in ("article", "main"):
            if self.kept[name]:
                picked = [x for first, last in self.kept[name] for x in [*self.text[first:last], " "]]
                return " ".join("".join(picked).split())
        return " ".join("".join(self.text).split())

    def _text(self, text: str, raw: bool = False) -> None:
        if not text or self.left_out:
            return
        if not raw and "&" in text:
            text = html.unescape(text)
        self.text.append(text)
        words = text.split()
        if self.open and words:
            self.open[-1].parts.append(" ".join(words).encode("utf-8", "replace"))
            self.open[-1].own += len(words)
        if not self.open or self.open[-1].tag in KEPT_ALWAYS:
            self.loose += len(words)

    def _start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            if not self.left_out:
                self.text.append(" ")
            if self.counts.get("p") and name not in VOID | {"option"}:
                self._end_open({"p"}, KEPT_ALWAYS | {"td", "th", "button"})
            if name in ENDS:
                self._end_open(ENDS[name], LISTS)
        if name in VOID:
            return
        out = not_article(name, attributes, self.articles > 0)
        if name in ("article", "main") and not out and not self.by_kind:
            if self.left_out and (name == "main" or self.lenient) and not self.articles:
                for element in self.open:
                    element.out = 0
                self.left_out = 0
            self.held += self.left_out > 0
            self.found += not self.left_out
        self.open.append(Element(name, len(self.text), out))
        self.counts[name] = self.counts.get(name, 0) + 1
        self.left_out += out > 0
        self.by_kind += out == BY_KIND
        self.articles += name == "article"

    def _end_open(self, names: set[str], stop: frozenset[str]) -> None:
        """End the nearest open element of these names, unless one of ``stop`` lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in names:
                while len(self.open) > i:
                    self._close()
                return
            if self.open[i].tag in stop:
                return

    def _end(self, name: str) -> None:
        if name not in INLINE and not self.left_out:
            self.text.append(" ")
        if not self.counts.get(name):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == name:
                while len(self.open) > i:
                    self._close()
                return
            if name in INLINE and self.open[i].tag not in INLINE:
                return

    def _close(self) -> None:
        element = self.open.pop()
        self.counts[element.tag] -= 1
        self.left_out -= element.out > 0
        self.by_kind -= element.out == BY_KIND
        self.articles -= element.tag == "article"
        if self.left_out or element.out:
            return
        digest = hashlib.blake2b(element.tag.encode("utf-8", "replace") + b"\0" + b"\0".join(element.parts), digest_size=8).digest()
        value = int.from_bytes(digest, "little", signed=True)
        # A removed subtree still counts in the hash of the one around it, so that both readings give the same hashes.
        element.words += element.own
        if self.open and element.parts:
            self.open[-1].parts.append(digest)
            self.open[-1].words += element.words
        if element.tag not in KEPT_ALWAYS and element.parts:
            self.subtrees[value] = (element.own, self._counted(element) or self.subtrees.get(value, (0, False))[1])
            if value in self.removed:
                del self.text[element.start :]
                for name, ranges in self.kept.items():
                    self.kept[name] = [r for r in ranges if r[0] < element.start]
                return
        if element.tag in self.kept:
            inner = [r for r in self.kept[element.tag] if r[0] < element.start]
            self.kept[element.tag] = [*inner, (element.start, len(self.text))]

    def _counted(self, element: Element) -> bool:
        if element.tag in INLINE or element.words < TEMPLATE_WORDS:
            return False
        return element.tag not in PARAGRAPHS or not (self.counts.get("article") or self.counts.get("main"))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


READING = "host string, content long, loose long, subtrees array<long>, own array<long>, block array<boolean>"


def subtree_rows(batches):
    """(host, content, loose, subtrees, own, block): the hash of a page's text, its words in no subtree, and its subtrees."""
    for piece in pieces(batches, "html"):
        contents, loose, lists, own, block = [], [], [], [], []
        for page in piece.column("html").to_pylist():
            reader = Reader()
            text = reader.read(page or "")
            contents.append(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
            loose.append(reader.loose)
            seen = sorted(reader.subtrees)
            lists.append(seen)
            own.append([reader.subtrees[s][0] for s in seen])
            block.append([reader.subtrees[s][1] for s in seen])
        longs = pa.list_(pa.int64())
        columns = [pa.array(contents, pa.int64()), pa.array(loose, pa.int64()), pa.array(lists, longs), pa.array(own, longs)]
        yield pa.record_batch(
            [piece.column("host"), *columns, pa.array(block, pa.list_(pa.bool_()))], names=["host", "content", "loose", "subtrees", "own", "block"]
        )


def removed_sets(batch: pa.RecordBatch):
    """The set of each row's ``removed``, made once for rows of one host that follow each other."""
    last, found = None, frozenset()
    for host, removed in zip(batch.column("host").to_pylist(), batch.column("removed"), strict=True):
        if host != last:
            last, found = host, frozenset(removed.as_py() or ())
        yield found


def witness_rows(batches):
    """(host, content, subtrees): the recurring subtrees of contents of which at least half the words stand in no such subtree."""
    for batch in batches:
        hosts, contents, lists = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("host", "content", "loose", "subtrees", "own", "block")]
        for host, content, loose, subtrees, own, block, recurring in zip(*columns, removed_sets(batch), strict=True):
            held = [(s, n, b) for s, n, b in zip(subtrees, own, block, strict=True) if s in recurring]
            if 2 * sum(n for _, n, _ in held) <= loose + sum(own):
                hosts.append(host)
                contents.append(content)
                lists.append([s for s, _, b in held if b])
        yield pa.record_batch(
            [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["host", "content", "subtrees"]
        )


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, subtree): the subtrees that recur on many contents of a host."""
    # Read twice below, so written once.
    read = stored(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(subtree_rows, READING), "readings")
    # One row per host, content and subtree; a subtree of null stands for the content itself.
    each = F.explode(F.concat(F.array(F.lit(None).cast("long")), "subtrees")).alias("subtree")
    marked = read.select("host", "content", each).distinct()
    # Read twice below, so written once; only what recurs is left.
    counts = stored(marked.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= TEMPLATE_LEAST), "subtrees")
    contents = counts.filter("subtree IS NULL").select(F.col("host").alias("_host"), F.col("n").alias("all"))
    found = counts.filter("subtree IS NOT NULL").join(contents, F.col("host") == F.col("_host"))
    needed = F.greatest(F.lit(RECUR_LEAST), RECUR_SHARE * F.col("all"))
    half = F.col("n") >= TEMPLATE_SHARE * F.col("all")
    frequent = stored(found.select("host", "subtree", "n", half.alias("half"), needed.alias("needed")).filter("half OR n >= needed"), "recurring")
    if frequent.filter("NOT half").isEmpty():
        return frequent.select("host", "subtree")
    read_with = with_templates(read, frequent.select("host", "subtree"), ["content", "subtrees"])
    own = read_with.filter("removed IS NOT NULL").mapInArrow(witness_rows, "host string, content long, subtrees array<long>")
    witnessed = own.select("host", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("witnesses"))
    judged = frequent.join(witnessed, ["host", "subtree"], "left").filter("half OR witnesses >= needed")
    return stored(judged.select("host", "subtree"), "templates")


def with_templates(rows: DataFrame, templates: DataFrame, spread: list[str]) -> DataFrame:
    """Rows with ``removed``, the template of their host or null.

    Templates of up to BROADCAST_TEMPLATES subtrees go to the pages. More are joined with them, and each host's pages are cut into
    SALTS parts by the columns of ``spread``, since one host may hold a large share of all pages.
    """
    listed = templates.groupBy(F.col("host").alias("_host")).agg(F.collect_list("subtree").alias("removed"))
    if templates.count() <= BROADCAST_TEMPLATES:
        return rows.join(F.broadcast(listed), rows["host"] == listed["_host"], "left").drop("_host")
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    cut = rows.withColumn("_part", part)
    dealt = listed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (cut["host"] == dealt["_host"]) & (cut["_part"] == dealt["_other"])
    return cut.join(dealt, same, "left").drop("_host", "_part", "_other")


def read_pages(batches):
    for piece in pieces(batches, "html"):
        texts = [Reader(removed).read(page or "") for page, removed in zip(piece.column("html").to_pylist(), removed_sets(piece), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = with_templates(rows, site_templates(pages), ["page_id", "url", "html"]).select("page_id", "url", "html", "host", "removed")
    return joined.mapInArrow(read_pages, "page_id long, url string, text string, n_chars long")
