"""Main text of web pages by site template removal.

A first pass hashes every block-level element's subtree on every page; Spark counts on how many
pages with different content each subtree stands per host, and on how many pages of the host
elements of the same shape stand in the same surroundings. Subtrees that recur on many pages, and
on a good part of those that have such an element at all, are the site's template: the count does
not get harsher as a host grows. They are deleted in a second pass, inside the article as well,
where prose needs a stricter proof. Markup that declares itself to be no content goes by that, and
what is left of the page outside its article goes last. Recurring subtrees are kept in sorted hash
arrays in the shared folder, which the workers map; no page is shuffled.
"""

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from docproof.llm.hash_table import Table, write_table
from docproof.llm.support import ship_package, stored
from docproof.llm.textscan import by_size

# A subtree is template if it stands on so many different pages of its host, however large the host is,
MANY_PAGES = 5
# and on this share of the host's pages that have an element of its shape in the same surroundings.
SHARE, PROSE_SHARE = 0.2, 0.5
# Prose inside an article needs more of both, and more than one address.
MANY_PAGES_INSIDE, SHARE_INSIDE = 10, 0.9

# How HTML treats these elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div dl fieldset figure footer form header li main nav ol section table tbody td th tr ul".split())
# What is never content: by element, by role, by a word of class or id.
NO_CONTENT = set("nav footer aside form button select dialog menu svg canvas audio video object head datalist".split()) | RAW
NO_CONTENT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NO_CONTENT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert comment comments disqus respond replies sidebar widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs footer share sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay paywall pagination pager skip masthead".split()
)
HEADER_WORDS, HEADER_QUALIFIERS = {"header", "banner"}, set("site top main global wrapper container bar inner sticky fixed".split())
# Articles that are no article of the page.
CARD_WORDS = set("card cards teaser teasers preview previews comment comments reply replies related recommended promo".split())
# Words that may stand beside these in one class or id; any other word gives it another meaning.
QUALIFIERS = set(
    "box block section list item items area wrapper wrap container inner outer bar banner content group panel top bottom left "
    "right main site page global primary secondary small large fixed sticky first last article post posts entry link links "
    "button buttons icon icons header text title col column row grid unit slot zone form area story stories news".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}


class Element:
    """An open or closed element: its place in the page, and what its markup says about it."""

    __slots__ = ("tag", "start", "end", "parent", "dropped", "main", "role", "path", "children")

    def __init__(self, tag, start, parent, dropped, main, role):
        self.tag, self.start, self.end, self.parent, self.dropped, self.main, self.role = tag, start, None, parent, dropped, main, role
        self.path = xxh64_intdigest(tag, parent.path) if parent else 0
        self.children = []
        if parent is not None and (not parent.children or parent.children[-1] != tag):
            parent.children.append(tag)


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-cased name; of repeated ones the first counts."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), (values[0] or values[1] or values[2]).lower())
    return found


def _says(attributes: dict[str, str], words: set[str], qualifiers: set[str] = QUALIFIERS) -> bool:
    """Whether a class or the id is made of these words, and at most of qualifiers beside them."""
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        own = set(_WORD.findall(token))
        if own & words and all(w in words or w in qualifiers or len(w) == 1 for w in own):
            return True
    return False


def _declared(tag: str, attributes: dict[str, str], inside_main: bool) -> bool:
    """Whether an element says itself that it is no part of the article."""
    if tag in NO_CONTENT or (tag == "header" and not inside_main):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes:
        return True
    role = attributes.get("role", "")
    if role in NO_CONTENT_ROLES and not (role == "banner" and inside_main):
        return True
    if tag in PROSE:
        return False
    return _says(attributes, NO_CONTENT_WORDS) or (not inside_main and _says(attributes, HEADER_WORDS, HEADER_QUALIFIERS))


def scan(html: str):
    """Elements of a page in opening order, and its text pieces (element, text, opens a block)."""
    root = Element("", 0, None, False, False, "")
    elements, pieces, here, at = [root], [], root, 0
    broken = True

    def close(target, end):
        nonlocal here, broken
        while here is not target.parent:
            here.end = end
            broken = broken or here.tag not in INLINE
            here = here.parent

    find = _TOKEN.search
    while at < len(html):
        token = find(html, at)
        until = token.start() if token else len(html)
        if until > at:
            pieces.append((here, html[at:until], broken))
            broken = False
        if token is None:
            break
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if tag is None:
            if token.group().startswith("<![CDATA["):
                pieces.append((here, token.group()[9:].removesuffix("]]>").replace("&", "&amp;"), broken))
                broken = False
            continue
        tag = tag.lower()
        if closing:
            target = here
            while target is not root and target.tag != tag:
                if target.tag in SCOPES and tag not in SCOPES:
                    target = root
                    break
                target = target.parent
            if target is not root:
                close(target, at)
            elif tag not in INLINE:
                broken = True
            continue
        block = tag not in INLINE
        if tag == "br" or tag == "wbr":
            if tag == "br":
                pieces.append((here, " ", False))
            continue
        if block:
            ends = CLOSES_ITSELF.get(tag, ())
            target, stop = here, None
            while target is not root and target.tag not in (SCOPES - set(ends)):
                if target.tag == "p" or target.tag in ends:
                    stop = target
                target = target.parent
            if stop is not None:
                close(stop, token.start())
            broken = True
        if tag in VOID:
            continue
        named = attributes_of(attributes) if attributes else {}
        role = "card" if tag == "article" and _says(named, CARD_WORDS) else "article" if tag == "article" else ""
        role = "main" if tag == "main" or named.get("role") == "main" else role
        one = Element(tag, token.start(), here, here.dropped or _declared(tag, named, here.main), here.main or role != "", role)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            at = one.end = found.end() if found else len(html)
            if one.dropped:
                elements.append(one)
            continue
        elements.append(one)
        here = one
    while here is not root:
        here.end = len(html)
        here = here.parent
    return elements, pieces


class Scope:
    """Which elements belong to the page's article.

    Inside the outermost main: its own text up to its articles, and these; but if its own paragraphs
    hold more than the articles, these are comments or teasers and only its own text counts.
    Without a main: the articles, or the whole page if there is none. Cards never count, nor articles
    inside an article that are no longer than what surrounds them.
    """

    def __init__(self, pieces):
        self.known = {}
        sizes, own, main = {}, {}, 0
        for element, text, _ in pieces:
            if element.dropped:
                continue
            n = len(text.strip())
            in_main, top, inner, in_card = self.place(element)
            if in_card or not n:
                continue
            if top is None:
                main += n if in_main and self.block(element) in ("p", "blockquote", "pre") else 0
                own[None] = own.get(None, 0) + (n if in_main else 0)
            else:
                sizes[top] = sizes.get(top, 0) + n
                own[inner] = own.get(inner, 0) + n
        mains = [a for a in sizes if self.place(a)[0]]
        self.mode = "main" if mains or own.get(None) else "article" if sizes else "page"
        self.articles = set(mains if self.mode == "main" else sizes)
        if self.mode == "main" and main > sum(sizes[a] for a in mains):
            self.articles = set()
        self.asides = {e for e in own if e is not None and e not in sizes and own[e] <= own.get(self.place(e)[1], 0)}
        self.passed = False

    def place(self, element):
        """(inside a main, outermost article, innermost article, inside a card) of an element."""
        chain = []
        while element is not None and element not in self.known:
            chain.append(element)
            element = element.parent
        found = (False, None, None, False) if element is None else self.known[element]
        for one in reversed(chain):
            in_main, top, inner, in_card = found
            if one.role == "article":
                top, inner = top or one, one
            found = self.known[one] = in_main or one.role == "main", top, inner, in_card or one.role == "card"
        return found

    @staticmethod
    def block(element) -> str:
        while element.tag in INLINE:
            element = element.parent
        return element.tag

    def holds(self, element) -> bool:
        """Asked piece by piece in page order: text of a main after its articles is no part of them."""
        in_main, top, inner, in_card = self.place(element)
        if in_card or inner in self.asides:
            return False
        if self.mode == "page":
            return True
        if top is not None:
            self.passed = self.passed or top in self.articles
            return top in self.articles
        return self.mode == "main" and in_main and not self.passed


def blocks(pieces, elements, gone: set[int]) -> list[str]:
    """Texts of the blocks that stay, in page order; ``gone`` holds ids of deleted elements."""
    state, out, current = {}, [], []

    def left(element):
        """Neither it nor anything around it is deleted."""
        known = state.get(id(element))
        if known is None:
            one = element
            while one is not None and not one.dropped and id(one) not in gone:
                one = one.parent
            state[id(element)] = known = one is None
        return known

    def flush():
        text = " ".join(unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    scope = Scope(pieces)
    for element, text, opens in pieces:
        if opens:
            flush()
        if left(element) and scope.holds(element):
            current.append(text)
    flush()
    return out


def candidates(elements: list[Element]) -> list[Element]:
    """Block-level elements that recurrence may delete: all but the page and its articles themselves."""
    return [
        e for e in elements[1:]
        if e.tag not in INLINE and e.tag not in ("html", "body", "head", "article", "main") and e.tag not in RAW and not e.dropped
    ]


def kind_of(element: Element) -> int:
    """How strict the proof must be: 0 for structure, 1 for prose, 2 for prose inside an article."""
    return 0 if element.tag not in PROSE else 2 if element.main else 1


def surroundings(host: str, found: list[Element]) -> np.ndarray:
    """One hash per element of its host, the elements around it, and its own shape."""
    seed = xxh64_intdigest(host)
    return np.array([xxh64_intdigest(f"{e.path}({','.join(e.children)})", seed) for e in found], np.uint64)


def subtree_keys(html: str, found: list[Element], places: np.ndarray) -> np.ndarray:
    """One hash per element of its whole markup and its surroundings."""
    return np.array([xxh64_intdigest(html[e.start : e.end], p) for e, p in zip(found, places.tolist(), strict=True)], np.uint64)


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.IGNORECASE)
    return found.group(1).lower() if found else ""


def main_text(html: str, host: str = "", template: Table | None = None) -> str:
    """The article of one page, block by block."""
    elements, pieces = scan(html)
    gone = set()
    if template is not None:
        found = candidates(elements)
        keys, place = np.unique(subtree_keys(html, found, surroundings(host, found)), return_inverse=True)
        gone = {id(e) for e, hit in zip(found, (template.get(keys) > 0)[place], strict=True) if hit}
    return "\n".join(blocks(pieces, elements, gone))


SEEN = ["key", "place", "kind", "content", "address"]


def _hashes():
    import pyarrow as pa
    def run(batches):
        for batch in (part for batch in batches for part in by_size(batch, 1)):
            columns = [[np.empty(0, np.uint64)] for _ in SEEN]
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                html = html or ""
                elements, pieces = scan(html)
                found = candidates(elements)
                places = surroundings(host_of(url), found)
                keys, first = np.unique(subtree_keys(html, found, places), return_index=True)
                content = xxh64_intdigest("\n".join(blocks(pieces, elements, set())))
                same = [np.full(len(keys), v, np.uint64) for v in (content, xxh64_intdigest(url or ""))]
                kinds = np.array([kind_of(e) for e in found], np.uint64)[first]
                for column, values in zip(columns, (keys, places[first], kinds, *same), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in columns], names=SEEN)

    return run


def template_subtrees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(key, value): hashes of subtrees that are their host's template, with their page counts.

    Pages of a host with the same article count as one page, so copies of a page make no template.
    Keys hold their host and surroundings, so a count never mixes hosts.
    """
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    seen = rows.mapInArrow(_hashes(), ", ".join(f"{c} long" for c in SEEN))
    seen = stored(seen.groupBy("key", "place", "kind", "content").agg(F.min("address").alias("low"), F.max("address").alias("high")), "subtrees")
    counted = seen.groupBy("key", "place", "kind").agg(
        F.count(F.lit(1)).alias("value"), (F.min("low") != F.max("high")).alias("addresses")
    )
    around = seen.select("place", "content").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("kind") == 0, SHARE).when(F.col("kind") == 1, PROSE_SHARE).otherwise(SHARE_INSIDE)
    many = F.when(F.col("kind") == 2, MANY_PAGES_INSIDE).otherwise(MANY_PAGES)
    often = counted.filter((F.col("value") >= many) & ((F.col("kind") < 2) | F.col("addresses")))
    return often.join(around, "place").filter(F.col("value") >= share * F.col("pages")).select("key", "value")


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from the whole html.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go
    by element, role, or a class or id that says nothing else; paragraphs and headings never go by a
    class. Everything else that recurs across the host goes by its hash, prose inside an article only
    if it stands on nearly all pages of its host. What is left outside the page's article goes, see
    ``Scope``.
    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by line feeds in page order. Unclosed elements and markup that is cut off are read
    as browsers read them. Null and empty html gives an empty text; a null url is a host of its own.
    Repeated rows come back as they are, an empty table gives an empty result, other columns are
    ignored.
    """
    import pyarrow as pa

    ship_package(pages.sparkSession)
    subtrees = stored(template_subtrees(pages, url, html), "templates")
    n = subtrees.count()
    folder, bits = write_table(subtrees, n, "templates")
    template = Table(folder, bits, n == 0)

    def run(batches):
        for batch in (part for batch in batches for part in by_size(batch, 2)):
            texts = [
                main_text(h or "", host_of(u), template)
                for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
