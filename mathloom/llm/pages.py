"""Main-text extraction with site template removal.

Every element of a page is a subtree, known by a hash of its source. Spark counts,
for each host, the different pages that hold a subtree; subtrees that recur on many of
the host's pages are template and are deleted. Inside an article only different
articles count, and most of the host's must have the subtree. What remains of
the article, without elements whose tag, role or class says menu, notice, advert and
the like, is the text; on pages that mark no article, all that is no template.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import private, stage_table

#: Elements by what they do to the text.
RAW = frozenset("script style iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset head select option noscript template".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies
    consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social sidebar
    menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar related recommended comment comments
    commentlist respond reply replies disqus popup modal overlay widget pagination pager tags toolbar search paywall
    outbrain taboola""".split()
)
#: Names that inside an article belong to it as often as not: its own heading, labels and remarks.
OWN_NAMES = frozenset("header masthead topbar banner alert notice notices tags widget overlay modal search".split())
#: Start tags that end an open paragraph, and items that end their like.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
WALLS = frozenset("ul ol dl table article section div body".split())

# quotes count after = alone; no part is tried again, and none runs past the next <, so that a page takes time in proportion to its length
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>]*+))*+)>|<[!?][^<>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


#: Shares into which the pages of each host are dealt.
SALTS = 64


class Element:
    __slots__ = ("boiler", "end", "inside", "name", "main", "start", "tag", "within")

    def __init__(self, tag, start, attributes, parent):
        self.tag, self.start, self.end = tag, start, None
        named = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.main = tag in MAIN_TAGS or named.get("role") == "main"
        self.within = (parent.within or parent.main) if parent else False
        names = BOILER_NAMES - OWN_NAMES if self.within else BOILER_NAMES
        named_boiler = any(w in names for w in WORD.findall(f"{named.get('class', '')} {named.get('id', '')}")) and not (self.main or tag in ("html", "body"))
        hidden = "hidden" in attributes and ("hidden" in named or re.search(r"\shidden(\s|$)", attributes) is not None)
        self.boiler = tag in BOILER_TAGS or tag == "header" and not self.within or named.get("role") in BOILER_ROLES or named_boiler or hidden


def parse(page: str) -> tuple[list[Element], list[tuple[int, int, Element | None, bool]]]:
    """Elements in page order, and pieces: (start, end, innermost element, whether a block starts there)."""
    elements: list[Element] = []
    pieces: list[tuple[int, int, Element | None, bool]] = []
    stack: list[Element] = []
    at, fresh = 0, True

    def close(upto: int, where: int) -> None:
        nonlocal fresh
        while len(stack) > upto:
            done = stack.pop()
            done.end = where
            fresh = fresh or done.tag not in INLINE

    position = 0
    while m := TOKEN.search(page, position):
        position = m.end()
        if m.start() > at:
            pieces.append((at, m.start(), stack[-1] if stack else None, fresh))
            fresh = False
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k + 1, m.start())
                    close(k, m.end())
                    break
            continue
        if tag in VOID:
            fresh = fresh or tag not in INLINE
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            position = at = end.end() if end else len(page)
            fresh = fresh or tag not in INLINE
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in ENDS_LIKE.get(tag, ()) or stack[k].tag == "p" and tag in ENDS_P:
                close(k, m.start())
                break
            if stack[k].tag in WALLS:
                break
        element = Element(tag, m.start(), m[3], stack[-1] if stack else None)
        element.inside = stack[-1] if stack else None
        elements.append(element)
        if not m[3].endswith("/"):
            stack.append(element)
        else:
            element.end = m.end()
        fresh = fresh or tag not in INLINE
    if len(page) > at:
        pieces.append((at, len(page), stack[-1] if stack else None, fresh))
    close(0, len(page))
    return elements, pieces


def subtree_hash(page: str, element: Element) -> int:
    source = SPACES.sub(" ", page[element.start : element.end]).strip()
    return xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")) - (1 << 63)


def template_hashes(page: str, elements: list[Element]) -> tuple[set[int], set[int], int]:
    """Hashes of the subtrees outside and inside the article, and of the article."""
    outside = {subtree_hash(page, e) for e in elements if _can_be_template(e) and not e.within}
    inside = {subtree_hash(page, e) for e in elements if _can_be_template(e) and e.within}
    article = next((subtree_hash(page, e) for e in elements if e.main), 0) if inside else 0
    return outside, inside, article


def _can_be_template(element: Element) -> bool:
    """Whole pages, the article and words within a line are no template."""
    return element.tag not in INLINE and element.tag not in ("html", "body") and not element.main


def main_text(page: str, template: frozenset | set = frozenset(), inside: frozenset | set = frozenset()) -> str:
    """The text of the article; `template` and `inside` have the hashes of subtrees to delete outside and inside it."""
    elements, pieces = parse(page)
    dropped: set[int] = set()
    any_main = any(e.main and not _under(e, lambda x: x.boiler) for e in elements)
    for e in elements:
        gone = e.boiler or e.inside is not None and id(e.inside) in dropped
        known = inside if e.within else template
        if not gone and known and _can_be_template(e):
            gone = subtree_hash(page, e) in known
        if gone:
            dropped.add(id(e))
    blocks: list[list[str]] = []
    for start, end, owner, fresh in pieces:
        if fresh or not blocks:
            blocks.append([])
        if owner is None and any_main or owner is not None and (id(owner) in dropped or any_main and not (owner.main or owner.within)):
            continue
        blocks[-1].append(page[start:end])
    texts = (SPACES.sub(" ", entities.unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(t for t in texts if t)


def _under(element: Element, test) -> bool:
    while element is not None:
        if test(element):
            return True
        element = element.inside
    return False


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; an empty string if it has none or is null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_templates(pages: DataFrame, share: float = 0.02, least_pages: int = 5, inside_share: float = 0.5, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hashes, inside): the subtrees found on at least `least_pages` different pages of a host and on the share `share` of
    these; inside articles, in so many different articles and in the share `inside_share` of them.

    Pages that are equal count once. As a subtree has to be on that share of the
    pages, a host has at most 1 / share times the subtrees of a mean page.
    """
    placed = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html")).where("host <> ''")

    def subtrees(batches):
        for batch in batches:
            hosts, marks, hashes, within = [], [], [], []
            for host, mark, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = page.as_py() or ""
                outside, inside, article = template_hashes(text, parse(text)[0])
                hosts += [host] * (len(outside) + len(inside))
                marks += [mark] * len(outside) + [article] * len(inside)
                hashes += [*outside, *inside]
                within += [False] * len(outside) + [True] * len(inside)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(hashes, pa.int64()), pa.array(within, pa.bool_())], ["host", "page", "hash", "within"])

    held = placed.mapInArrow(subtrees, "host string, page bigint, hash bigint, within boolean").groupBy("host", "within", "hash", "page").agg(F.lit(1).alias("one"))
    counts = held.groupBy("host", "within", "hash").agg(F.count("*").alias("n"))
    sizes = placed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    most = F.when(F.col("within"), F.lit(inside_share)).otherwise(F.lit(share)) * F.col("pages")
    recurring = counts.where(F.col("n") >= least_pages).join(sizes, "host").where(F.col("n") >= most)
    return recurring.groupBy("host").agg(F.collect_list(F.when(~F.col("within"), F.col("hash"))).alias("hashes"), F.collect_list(F.when(F.col("within"), F.col("hash"))).alias("inside"))


def extract(pages: DataFrame, share: float = 0.02, least_pages: int = 5, inside_share: float = 0.5, url: str = "url", html: str = "html") -> DataFrame:
    """pages, without `html`, and the column main_text: the article's text of every row.

    Null and empty html give an empty text; pages without a host have no template;
    repeated rows count once for the template and come back as often as given; an
    empty table gives an empty one. A column of pages named main_text is replaced.
    """
    host, salt, hashes, inside, page = (private(pages, c) for c in ("__host", "__salt", "__hashes", "__inside", "__html"))
    templates = stage_table(site_templates(pages, share, least_pages, inside_share, url, html), "templates")
    spread = templates.select(F.col("host").alias(host), F.col("hashes").alias(hashes), F.col("inside").alias(inside), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    kept = [c for c in pages.columns if c not in (html, "main_text")]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    salted = pages.withColumn(host, host_of(F.col(url))).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, [host, salt], "left").select(*[F.col(f"`{c}`") for c in kept], F.col(hashes), F.col(inside), F.col(html).alias(page))

    def texts(batches):
        for batch in batches:
            out = []
            for hashes, within, text in zip(*(batch.column(len(kept) + k) for k in range(3))):
                out.append(main_text(text.as_py() or "", frozenset(hashes.as_py() or ()), frozenset(within.as_py() or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], [*kept, "main_text"])

    return joined.mapInArrow(texts, f"{fields}main_text string")
