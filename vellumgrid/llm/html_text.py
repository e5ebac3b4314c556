"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds the contiguous stretch
with the greatest sum. Weights come from labelled pages, those that mark their article themselves: for each tag, for each kind of word
(its block and its element) and for each name of a container (its tag, classes, id and role), the log odds of standing inside of an
article and outside. A word in a container whose names stand outside scores like a tag, by the least of these weights, and is
left out of the text where the best stretch passes over it; so an advert within an article goes, and an article in plain containers stays.
Marks are labels only: extraction doesn't read them. Only what is never text (scripts, styles, forms and the like) is cut by its element.

Tags, kinds and names are counted in a table of fixed size by their hash, so none is too rare or too long to have a weight.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import slices, table

#: Fixed values of HTML: elements without content, elements whose content is not markup, and elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never article text.
NOT_TEXT = frozenset("head form menu dialog button select datalist fieldset label input script style noscript template textarea svg math iframe object canvas audio video map".split())
#: Names that mostly stand outside of an article. They only make labels and priors: words below one don't count as inside, and such a name is
#: taken to have stood outside PRIOR times before anything is counted.
OUTSIDE_TAGS = frozenset("header footer nav aside search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification"
    " popup overlay modal newsletter subscribe subscription signup login sidebar aside sidenav nav navbar navigation navi menu submenu breadcrumb breadcrumbs pagination pager"
    " footer header masthead comment comments commentlist disqus discussion replies reply respond reactions share sharing social related recommended recommendations widget"
    " widgets toolbar skip".split()
)
PRIOR = 200
ARTICLE = ("article", "main")
#: Elements whose name alone says something of what they hold.
SECTIONS = OUTSIDE_TAGS | {"section", *ARTICLE}
#: Tags that close an open element of the same kind.
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select body article main section div aside nav form header footer blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[?!][^>]*>|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
#: Behind the last > of a page: there neither a declaration nor a tag ends.
_TOKEN_AT_END = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
#: Decimal references: zeros that don't count, and values over the last code point.
_ZEROS, _TOO_GREAT = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
_TO_QUOTE = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_PARTS = re.compile(r"[a-z0-9]+")
#: Buckets of the table of weights, a power of 2.
BUCKETS = 1 << 17
LEAST_WEIGHT, MOST_WEIGHT, WORD_WEIGHT, HINTED_WEIGHT = 0.1, 3.0, 0.5, 0.05
#: Log odds under which a container's name speaks against its words.
OUTSIDE_ODDS = -1.0


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def unescaped(text: str) -> str:
    """Character references decoded; a number over the last code point, however long, is U+FFFD."""
    if "&#" in text:
        text = _TOO_GREAT.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def _attributes(text: str) -> dict[str, str]:
    """Lower-case values by lower-case name; the first of a name holds. An attribute without a value is empty."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _names(tag: str, attributes: dict[str, str]) -> list[str]:
    """What a container is called: t:<section tag>, c:<class>, i:<id>, r:<role>."""
    found = [f"c:{x}" for x in attributes.get("class", "").split()]
    found += [f"i:{x}" for x in attributes.get("id", "").split()]
    if attributes.get("role"):
        found.append(f"r:{attributes['role']}")
    if tag in SECTIONS:
        found.append(f"t:{tag}")
    return found


def _outside_names(names: list[str]) -> bool:
    return any(x[2:] in (OUTSIDE_ROLES if x[0] == "r" else OUTSIDE_TAGS if x[0] == "t" else OUTSIDE_NAMES) for x in names)


def _not_text(tag: str, attributes: dict[str, str]) -> bool:
    """Never text by its element, or not shown."""
    return tag in NOT_TEXT or attributes.get("aria-hidden") == "true" or attributes.get("hidden", "until-found") != "until-found"


@dataclass
class Piece:
    kind: str
    """<tag> or </tag>, or the block and the element of a text."""
    text: str | None
    """Decoded text; None for a tag."""
    block: int
    """Grows at each edge of a block."""
    counts: bool
    """Outside of elements that are never text."""
    article: bool
    """The label: inside of a marked article, and not in a container called after what isn't one."""
    names: tuple
    """Of all open containers, as a linked list (names of the innermost, the others)."""


class _Open:
    """An element that is open."""

    __slots__ = ("tag", "no", "article", "outside", "block", "names", "scope")

    def __init__(self, tag: str, no: bool, outside: bool, block: str, names: tuple, scope: int):
        self.tag, self.no, self.article, self.outside = tag, no, tag in ARTICLE, outside
        self.block, self.names, self.scope = block, names, scope


def _end_of_tag(page: str, at: int, quotes: bool, last: dict[str, int]) -> int:
    """Where a tag's > stands, from behind its name; -1 if it has none. A quote that nothing closes is a character like others."""
    if at > last[">"]:
        return -1
    if not quotes:
        return page.find(">", at)
    while True:
        at = _TO_QUOTE.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        at = at + 1 if at >= last[page[at]] else page.find(page[at], at + 1) + 1


def pieces(page: str) -> Iterator[Piece]:
    """The page in order, as tags and texts, in linear time.

    Stray closing tags are ignored, open elements end with what holds them, a lone `<` is text. After a tag whose quotes hold all that
    follows, quotes are characters like others.
    """
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of each open tag
    out = marked = outside = block = 0
    at, n, quotes = 0, len(page), True
    last = {q: page.rfind(q) for q in "\"'>"}

    def drop_to(k: int) -> None:
        nonlocal out, marked, outside
        while len(stack) > k:
            x = stack.pop()
            places[x.tag].pop()
            out, marked, outside = out - x.no, marked - x.article, outside - x.outside

    def piece(kind: str, text: str | None, counts: bool) -> Piece:
        return Piece(kind, text, block, counts, marked > 0 and not outside, stack[-1].names if stack else ())

    while at < n:
        m = (_TOKEN if at <= last[">"] else _TOKEN_AT_END).match(page, at)
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield piece(f"{stack[-1].block} {stack[-1].tag}" if stack else " ", unescaped(m[0]), not out)
            elif m[0].startswith("<![CDATA["):
                yield piece("cdata", m[0][9:].removesuffix("]]>"), not out)
            continue
        end = _end_of_tag(page, at, quotes, last)
        if end < 0 and quotes:
            quotes, end = False, _end_of_tag(page, at, False, last)
        if end < 0:
            yield piece(f"{stack[-1].block} {stack[-1].tag}" if stack else " ", unescaped(m[0]), not out)
            continue
        inside, at, tag = page[at:end], end + 1, tag.lower()
        if m[1]:
            if tag in BLOCK:
                block += 1
            hidden = bool(out)
            if places.get(tag):
                drop_to(places[tag][-1])
            yield piece(f"</{tag}>", None, not hidden)
            continue
        if tag in _CLOSES:
            nearest = max((places[x][-1] for x in _CLOSES[tag] if places.get(x)), default=-1)
            if nearest > (stack[-1].scope if stack else -1):
                drop_to(nearest)
        if tag in BLOCK:
            block += 1
        if tag == "br":
            yield piece("<br>", " ", not out)
            continue
        attributes = _attributes(inside)
        no = _not_text(tag, attributes)
        yield piece(f"<{tag}>", None, not (out or no))
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not inside.rstrip().endswith("/"):
            names = [] if tag in ("html", "body") else _names(tag, attributes)
            above = stack[-1] if stack else None
            place = len(stack)
            chain = (tuple(names), above.names if above else ()) if names else (above.names if above else ())
            stack.append(_Open(tag, no, _outside_names(names), tag if tag in BLOCK else above.block if above else "", chain, place if tag in _SCOPE else above.scope if above else -1))
            places.setdefault(tag, []).append(place)
            out, marked, outside = out + no, marked + (tag in ARTICLE), outside + stack[-1].outside


def _all_names(chain: tuple) -> Iterator[str]:
    while chain:
        yield from chain[0]
        chain = chain[1]


def tally(page: str) -> Counter:
    """(bucket, inside) of a labelled page's tags, and of the words of each kind and name; empty if the page marks no article."""
    seen: Counter = Counter()
    many: Counter = Counter()  # words of a chain of names, by the chain itself, since pages repeat few
    for p in pieces(page):
        if p.counts:
            n = 1 if p.text is None else len(p.text.split())
            seen[bucket(p.kind), p.article] += n
            if p.text is not None and n:
                many[p.names, p.article] += n
    if not any(inside for _, inside in seen if seen[_, inside]):
        return Counter()
    for (chain, inside), n in many.items():
        for name in set(_all_names(chain)):
            seen[bucket(name), inside] += n
    return +seen


def odds(inside: float, outside: float) -> float:
    return math.log((inside + 1) / (outside + 1))


def priors() -> dict[int, int]:
    """Words that names in the lists are taken to have had outside."""
    listed = [*(f"t:{x}" for x in OUTSIDE_TAGS), *(f"r:{x}" for x in OUTSIDE_ROLES), *(f"{k}:{x}" for k in "ci" for x in OUTSIDE_NAMES)]
    return {bucket(x): PRIOR for x in listed}


def table_of(counts: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Log odds of each bucket, from (inside, outside)."""
    prior = priors()
    return {k: odds(counts.get(k, (0, 0))[0], counts.get(k, (0, 0))[1] + prior.get(k, 0)) for k in {*counts, *prior}}


class Weights:
    """Scores of tags and words from log odds by bucket; chains of names are worked out once."""

    def __init__(self, by_bucket: dict[int, float]):
        self.odds, self.known = by_bucket, {}

    def of_kind(self, kind: str) -> float:
        if kind not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.odds.get(bucket(kind))
            if kind.startswith("<"):
                self.known[kind] = -LEAST_WEIGHT if found is None else -min(MOST_WEIGHT, max(LEAST_WEIGHT, -found))
            else:
                self.known[kind] = WORD_WEIGHT if found is None else min(MOST_WEIGHT, max(LEAST_WEIGHT, found))
        return self.known[kind]

    def hinted(self, chain: tuple) -> bool:
        """Whether the innermost container has a name without a weight of which a part is in the lists."""
        return bool(chain) and any(x[0] in "ci" and bucket(x) not in self.odds and not OUTSIDE_NAMES.isdisjoint(_PARTS.findall(x[2:])) for x in chain[0])

    def of_names(self, chain: tuple, seen: dict) -> float:
        """The least log odds of a container's names, 0 if none speaks against its words. seen: chains of this page by identity."""
        path = []
        while chain and id(chain) not in seen:
            path.append(chain)
            chain = chain[1]
        least = seen[id(chain)] if chain else 0.0
        for x in reversed(path):
            least = min([least, *(self.odds.get(bucket(name), 0.0) for name in x[0])])
            seen[id(x)] = least
        return least


def extract(page: str | None, weights: Weights | dict[int, float]) -> str:
    """The text of the best stretch: white space inside a block as one space, blocks joined by a newline."""
    w = weights if isinstance(weights, Weights) else Weights(weights)
    found = [p for p in pieces(page or "") if p.counts]
    chains: dict[int, float] = {}
    scores, ours = [], []
    for p in found:
        against = w.of_names(p.names, chains)
        outside = against < OUTSIDE_ODDS
        ours.append(not outside)
        if p.text is None:
            scores.append(w.of_kind(p.kind))
        else:
            each = max(-MOST_WEIGHT, against) if outside else HINTED_WEIGHT if w.hinted(p.names) else w.of_kind(p.kind)
            scores.append(each * len(p.text.split()))
    low, high = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for p, own in zip(found[low:high], ours[low:high]):
        if p.text is not None and own:
            blocks.setdefault(p.block, []).append(p.text)
    return "\n".join(x for parts in blocks.values() if (x := " ".join("".join(parts).split())))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the greatest sum above 0; the first of equals, without a start that adds nothing."""
    best = total = 0.0
    low = high = start = 0
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, low, high = total, start, k + 1
    return low, high


def learn(pages: DataFrame) -> dict[int, float]:
    """Log odds by bucket, counted over all labelled pages; the driver gets a table of fixed size."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # at most two entries a bucket
        for batch in batches:
            for part in slices(batch):
                for page in part.column(0).to_pylist():
                    seen.update(tally(page or ""))
        keys = list({k for k, _ in seen})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([seen[k, x] for k in keys], pa.int64()) for x in (True, False))], names=["bucket", "inside", "outside"])

    counted = pages.select(F.col("html").cast("string")).mapInArrow(kernel, "bucket int, inside long, outside long")
    summed = counted.groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).toArrow().to_pydict()
    return table_of({k: (a, b) for k, a, b in zip(summed["bucket"], summed["inside"], summed["outside"])})


def main_text(pages: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """All input columns with main_text: the article of `html`, empty if there is none.

    A null or empty page has an empty text; rows that repeat stay repeated and each counts for the weights; of stretches of equal sum
    the first is taken; only an input column named main_text is replaced. Broken markup is read as far as it goes, see `pieces`.
    weights: log odds by bucket, learned from these pages if None.
    """
    kept = [c for c in pages.columns if c != "main_text"]
    base = pages.select(*(F.col(f"`{c}`") for c in kept))
    chosen = learn(pages) if weights is None else weights
    shared = pages.sparkSession.sparkContext.broadcast(chosen)  # at most BUCKETS numbers

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts = [extract(x, w) for x in part.column(part.schema.get_field_index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "main_text"])

    return base.mapInArrow(kernel, base.withColumn("main_text", F.lit("")).schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see `main_text`."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
