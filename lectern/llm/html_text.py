"""Main text of web pages: site templates are the element subtrees that recur across a host's pages."""

from __future__ import annotations

import bz2
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Stash

# Names of HTML elements, by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object canvas audio video select".split())
ASIDE = frozenset("nav aside footer form head menu dialog button fieldset noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
# Words of class, id and role that break ties, and words that may stand beside them in a label.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie "
    "cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notification notifications pagination pager popup "
    "promo promoted promotion related replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "toolbar topbar widget widgets".split()
)
ASIDE_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related reply sponsored".split())
BESIDE = frozenset("area bar block bottom box container form group inner item items left link links list main outer panel post posts right section site top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A node of every page: it recurs where a host has pages enough to count.
ROOT = 0
MAIN, SUSPECT = 1, 2

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile("[0-9]+")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url) if url else None
    return found[1].lower() if found else None


def _labels(attrs: str) -> list[str]:
    return [x for a in _ATTR.finditer(attrs) for x in html.unescape(a[2] or a[3] or a[4] or "").lower().split()]


def _suspect(name: str, labels: list[str]) -> bool:
    """Whether a label says by all its words that this isn't article text; an article is set apart by few words only."""
    if name in ("html", "body", "main"):
        return False
    known = ASIDE_ARTICLE if name == "article" else ASIDE_WORDS
    for label in labels:
        words = [x for x in re.split(r"[^a-z0-9]+", label) if x]
        if not known.isdisjoint(words) and all(x in known or x in BESIDE for x in words):
            return True
    return False


def _signed(digest: int) -> int:
    return digest - (1 << 63)


class _Open:
    """An open element: its name, the hash of what it holds, and the hash of its path by names and labels.

    ``ruled``: no article text by the name of an element around it; ``suspects``: suspect elements around
    it, itself included; ``region``: 2 in an article, 1 in main, 1.5 for a heading of main before its
    article; ``wraps``: whether an article or main lies inside; ``plain``: no attributes and no block inside.
    """

    __slots__ = ("name", "hash", "digest", "shape", "ruled", "suspects", "region", "wraps", "main", "plain")

    def __init__(self, name: str, attrs: str, labels: list[str], up: _Open | None):
        self.name, self.digest, self.wraps, self.plain = name, 0, False, not attrs.strip("/ ")
        self.hash = xxhash.xxh3_64(f"{name} {' '.join(attrs.split())}".encode())
        self.shape = xxhash.xxh3_64_intdigest(f"{up.shape if up else ''}/{name} {' '.join(_DIGITS.sub('#', x) for x in labels)}".encode())
        self.ruled, self.suspects, self.region, self.main = (up.ruled, up.suspects, up.region, up.main) if up else (False, (), 0, False)


class Page:
    """``blocks`` of a page, furniture and all: text, whether it is main text by the page's structure, and the elements around it.

    One pass over the tags. The articles (else the main element, else the body) are the main region, with a
    heading of main that comes before the article. What lies in navigation, forms and the like by the name
    of its element, or in no main region though there is one, is no main text whatever counting says.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, list[_Open]]] = []
        self._stack: list[_Open] = []
        self._text: list[str] = []
        self._around: list[_Open] = []
        self._found = self._article = False  # whether an article or main element, and whether an article, has begun
        if source:
            self._parse(source)
        self._best = max((r for _, around in self.blocks if (r := self._region(around)) != 1.5 and not self._ruled(around)), default=0)

    @staticmethod
    def _region(around: list[_Open]) -> float:
        return around[-1].region if around else 0

    @staticmethod
    def _ruled(around: list[_Open]) -> bool:
        return bool(around) and around[-1].ruled

    def row(self, host: int = 0) -> tuple:
        """``page, sizes, hashes, nodes`` of the page, as in ``PARSED``; what is counted is told by ``host`` too.

        ``page`` is packed: a line of JSON that says of each block whether it is main text (MAIN), and of a
        suspect element (SUSPECT), and which of the page's ``nodes`` it lies in; then the main text, a line
        for each of its blocks, whose ``sizes`` and ``hashes`` stand apart. Nodes are the subtrees around blocks by
        all they hold. Outside the main region, and for suspect elements, they are also told by their path
        of names and labels, apart from any words, so that furniture whose words change recurs too;
        elements that wrap the main region aren't. A plain paragraph of an article or main element is text,
        however often it recurs, and no node. The first node is ROOT, the page itself.
        """
        texts, hashes, kinds, of, known = [], [], [], [], {ROOT ^ host: 0}
        for text, around in self.blocks:
            region = self._region(around)
            main = not self._ruled(around) and (region == self._best or region == 1.5 and self._best > 0)
            inner = [x for x in around if x.name not in ("html", "body", "article", "main") and not (x.plain and x.region)]
            suspects = around[-1].suspects if around else ()
            nodes = [x.digest for x in inner] + [x.shape for x in (suspects if main else inner) if not x.wraps]
            of.append([known.setdefault(x ^ host, len(known)) for x in nodes])
            kinds.append(main * (MAIN + SUSPECT * bool(suspects)))
            if main:
                texts.append(text)
                hashes.append(_signed(xxhash.xxh3_64_intdigest(text.encode()) ^ host))
        packed = "\n".join([json.dumps([kinds, of], separators=(",", ":")), *texts]).encode("utf-8", "surrogatepass")
        return bz2.compress(packed), [len(t) for t in texts], hashes, [_signed(x) for x in known]

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, self._around))
            self._text = []

    def _close(self, to: int) -> None:
        while len(self._stack) > to:
            x = self._stack.pop()
            if x.name in BLOCK:
                self._flush()
            x.digest = x.hash.intdigest()
            if self._stack:
                self._stack[-1].hash.update(x.digest.to_bytes(8, "little"))

    def _add(self, raw: str) -> None:
        if not self._stack:
            if raw.strip():
                self._stack.append(_Open("body", "", [], None))
            else:
                return
        top = self._stack[-1]
        text = html.unescape(raw)
        top.hash.update(" ".join(text.split()).encode())
        if top.name in ("ul", "ol", "table", "tr", "html") and not text.strip():
            return
        around = [x for x in self._stack if x.name in BLOCK]
        if (top.ruled and not (around and around[-1].ruled)) or (top.suspects and len(top.suspects) > len(around[-1].suspects if around else ())):
            return  # an element inside a line of text, such as a button, that is none by its name
        if not self._text:
            self._around = around
        self._text.append(text)

    def _parse(self, s: str) -> None:
        at, n, stack = 0, len(s), self._stack
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._add(s[at:])
                break
            if lt > at:
                self._add(s[at:lt])
            m = _TAG.match(s, lt) or _LOOSE.match(s, lt)
            if m is None:
                self._add("<")
                at = lt + 1
                continue
            at = m.end()
            if m.lastindex is None or m[2] is None:
                continue
            name, attrs = m[2].lower(), m[3]
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        self._close(i)
                        break
                else:
                    if name in BLOCK:
                        self._flush()
                continue
            if name == "br":
                if self._text:
                    self._text.append(" ")
                continue
            if name in BLOCK:
                self._flush()
            if name in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        self._close(i)
                        break
                    if stack[i].name in ("td", "th", "table", "button", "caption"):
                        break
            if name in CLOSES_SELF:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name or name in ("td", "th", "dt", "dd") and stack[i].name in ("td", "th", "dt", "dd"):
                        self._close(i)
                        break
                    if stack[i].name in CLOSES_SELF[name]:
                        break
            if name in RAW:
                if not attrs.endswith("/"):
                    end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(s, at)
                    at = end.end() if end else n
                continue
            if name in VOID:
                continue
            up = stack[-1] if stack else None
            labels = _labels(attrs) if attrs else []
            if name in BLOCK:
                for y in stack:
                    y.plain = False
            x = _Open(name, attrs, labels, up)
            if name in ("article", "main") or "main" in labels and 'role="main"' in attrs:
                if not self._found:
                    x.suspects = ()  # the first article lies in no aside: a wrapper's name misled
                if up and up.region == 2 and name == "article":
                    x.ruled = True  # an article in an article is a comment on it
                self._found, x.main = True, True
                for y in stack:
                    y.wraps = True
                x.region = 2 if name == "article" else max(x.region, 1)
                self._article = self._article or name == "article"
            elif name in HEADINGS and x.region == 1 and not self._article:
                x.region = 1.5
            x.ruled = x.ruled or name in ASIDE or name == "header" and not x.main
            if _suspect(name, labels):
                x.suspects = (*x.suspects, x)
            stack.append(x)
        self._close(0)
        self._flush()


PARSED = "page_id long, url string, known boolean, page binary, sizes array<int>, hashes array<long>, nodes array<long>"


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> rows of ``PARSED``; ``known`` is whether the address has a readable host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, source in zip(batch["page_id"].array, batch["url"].array, batch["html"].array):
                url = url if isinstance(url, str) else None
                host = host_of(url)
                page = Page(source if isinstance(source, str) else None)
                out.append((page_id, url, host is not None, *page.row(xxhash.xxh3_64_intdigest(host.encode()) if host else 0)))
            rows = pd.DataFrame(out, columns=[x.split()[0] for x in PARSED.split(", ")])
            rows["page_id"] = pd.array([None if x is None or x != x else int(x) for x in rows["page_id"]], "Int64")
            yield rows

    return pages.select("page_id", "url", "html").mapInPandas(run, PARSED)


def signed_pages(parsed: DataFrame, min_pages: int = 10) -> DataFrame:
    """``row, nodes, sig`` of each row with a known host; ``sig`` is a hash of the page's longest block of main text that is on fewer
    than ``min_pages`` pages of its host, or of all its blocks if there is none. Boilerplate signs no page, however long it is."""
    known = parsed.where("known")
    each = known.select("row", F.explode(F.array_distinct(F.arrays_zip(F.col("sizes").alias("n"), F.col("hashes").alias("h")))).alias("x")).select("row", "x.n", "x.h")
    frequent = each.groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select("h")
    rare = each.join(frequent, "h", "left_anti").groupBy("row").agg(F.max(F.struct("n", "h"))["h"].alias("rare"))
    return known.select("row", "nodes", F.xxhash64("hashes").alias("whole")).join(rare, "row", "left").select("row", "nodes", F.coalesce("rare", "whole").alias("sig"))


def host_templates(signed: DataFrame, min_pages: int = 10) -> DataFrame:
    """``node``: the subtrees in ``min_pages`` or more different pages of their host, however large it is.

    Pages with the same signature (``signed_pages``) count as one, so that an article isn't a template
    because its page was copied. Counted in Spark with partial sums before each shuffle; pages without a host don't count.
    """
    each = signed.select(F.explode("nodes").alias("node"), "sig").distinct()
    return each.groupBy("node").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages).select("node")


def _kept(page: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """The text that is left of each page, its characters, blocks and template blocks."""
    out = []
    for packed, lost in zip(page, gone):
        head, *lines = bz2.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
        kinds, nodes = json.loads(head)
        lost = set() if lost is None else set(lost)
        countable, template, said = 0 in lost, [not lost.isdisjoint(x) for x in nodes], iter(lines)
        text = "\n".join([line for k, t, line in ((k, t, next(said)) for k, t in zip(kinds, template) if k) if not t and (countable or not k & SUSPECT)])
        out.append((text, len(text), len(template), sum(template)))
    return pd.DataFrame(out, columns=["text", "n_chars", "n_blocks", "n_template_blocks"])


def extract_text(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_blocks, n_template_blocks``.

    The text is the blocks of main text, in page order, joined by \n; white space in a block is one space,
    character references are decoded. Blocks in a subtree that recurs on ``min_pages`` different pages of
    the host are templates (``n_template_blocks`` of all ``n_blocks``, furniture included) and left out.
    Subtrees are told by all they hold, and furniture also by its path of element names and labels alone.
    Plain paragraphs of an article or main element aren't subtrees in this sense: many pages may say the same.
    What counting can't see, as on hosts with few pages, is left out by the page's own structure: element
    names and the main region (see ``Page``). Words of class, id and role break ties only: an element in
    the main region that they name is furniture if its path recurs, or if the host is too small to tell.
    A null or empty page has the text ''. Pages without a readable host are told by structure alone.
    Repeated rows and null ids are pages like any other; columns beside page_id, url and html are ignored.
    """
    stash = Stash(pages.sparkSession, "html")
    parsed = stash.put(parse_pages(pages).withColumn("row", F.monotonically_increasing_id()))
    signed = stash.put(signed_pages(parsed, min_pages))
    templates = stash.put(host_templates(signed, min_pages))
    found = signed.select("row", F.posexplode("nodes").alias("i", "node")).join(templates, "node", "left_semi")
    gone = stash.put(found.groupBy("row").agg(F.collect_set("i").alias("gone")))
    stash.drop(signed)
    kind = T.StructType.fromDDL("text string, n_chars long, n_blocks int, n_template_blocks int")
    joined = parsed.select("row", "page_id", "url", "page").join(gone.hint("merge"), "row", "left")  # texts travel once, packed, at any size
    return joined.select("page_id", "url", F.pandas_udf(_kept, kind)("page", "gone").alias("x")).select("page_id", "url", "x.*")
