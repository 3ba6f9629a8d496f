"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block elements into flat blocks of text.  A block is described by its
words and the share of them inside links, by the same of the block before and after,
and by where it stands: inside an article, inside elements that HTML itself calls page
furniture, and inside a region whose class or id sounds like it, with the words of that
region and their share of the page, since wrappers of whole articles carry such names
too.  A decision tree, grown on the small labelled table of ``html_training``, says which
blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsloom.llm.html_training import pages as labelled_pages

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag; possessive, so that a failure costs one pass.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_LINK_TAGS = re.compile(r"<(/?)a(?=[\s/>])", re.I)
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select button title canvas audio video datalist".split())
#: Elements that end a block; all others stand inside a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("hr br img input link meta area base col embed source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Parts of a class or id that may name page furniture.
FURNITURE_NAMES = frozenset("""promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs
header masthead topbar footer foot bottom sidebar sidebars side aside widget widgets related recommended trending popular cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
signup login search form share sharing social toolbar pagination pager skip copyright legal disclaimer""".split())
#: Parts that name adverts and reader comments, which may hold more words than the article.
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement adverting advertising adbox sponsor sponsored sponsors comment comments commentlist reply replies respond discussion disqus".split())
#: Parts after which a name says what a wrapper has or lacks.
_MODIFIERS = frozenset("with has no without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table menu".split())
#: Items and the open elements that they end.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Nested elements followed; deeper ones count as siblings, as in browsers.
DEEPEST = 512
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "named", "region_words", "region_share", "heading", "item"]
SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_main int"


class Block:
    __slots__ = ("text", "words", "links", "furniture", "article", "named", "region", "region_words", "region_share", "heading", "item", "label")


class Region:
    """An element named as page furniture; ``level`` is 2 for adverts and comments."""

    __slots__ = ("parent", "level", "words", "articles", "main")

    def __init__(self, parent: Region | None, level: int) -> None:
        self.parent, self.level, self.words, self.articles, self.main = parent, level, 0, 0, False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in FURNITURE_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _level(tag: str, attributes: dict[str, str]) -> int:
    """How much an element's class and id sound like furniture: 0 not, 1 somewhat, 2 adverts and comments."""
    if tag in ("html", "body", "main"):
        return 0
    level = int(tag == "form")
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = _PARTS.split(_CAMEL.sub("-", token).lower())
        if tag == "article" and len(parts) > 1:
            continue
        for before, part in zip(["", *parts], parts):
            if before not in _MODIFIERS:
                level = max(level, 2 * (part in FOREIGN_NAMES), int(part in FURNITURE_NAMES and tag != "article"))
    return level


def _whole_links(page: str) -> set[int]:
    """Places of link tags that are closed before the next one opens; others link nothing."""
    tags = [(m.start(), m.group(1)) for m in _LINK_TAGS.finditer(page)]
    return {at for (at, closing), (_, after) in zip(tags, tags[1:]) if not closing and after}


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in its order, in time linear in its length.

    Broken markup is read as browsers do, roughly: a lone ``<`` is text, a tag that never
    ends swallows the rest, and once a quote stays open to the end of the page, tags from
    there on end at their first ``>``.
    """
    out: list[Block] = []
    regions: list[Region] = []
    #: Open block elements: name, furniture around, article around, region around, label.
    stack: list[tuple[str, int, int, Region | None, str | None]] = [("", 0, 0, None, None)]
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    links = _whole_links(page)
    in_link, quotes, articles = False, True, 0
    at, n = 0, len(page)

    def cut(i: int) -> None:
        for element in stack[i:]:
            is_open[element[0]] -= 1
        del stack[i:]

    def say(piece: str) -> None:
        text.append(piece)
        if in_link:
            linked.append(piece)

    def close() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                block = Block()
                name, block.furniture, block.article, block.region, block.label = stack[-1]
                block.text, block.words = whole, whole.count(" ") + 1
                block.links = min(1.0, len(html.unescape("".join(linked)).split()) / block.words)
                block.heading, block.item = int(name in _HEADINGS), int(name in ("li", "td", "th", "dt", "dd"))
                out.append(block)
        linked.clear()

    while at < n:
        end = page.find("<", at)
        if end < 0:
            end = n
        if end > at:
            say(page[at:end])
        if end == n:
            break
        start = at = end
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            say(html.escape(page[at + 9 : end if end >= 0 else n]))
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        found = _NAME.match(page, at)
        if not found:
            say("<")
            at += 1
            continue
        closing, tag = found.group(1), found.group(2).lower()
        rest = _REST.match(page, found.end()) if quotes else None
        if rest:
            at, rest = rest.end(), rest.group(1)
        else:
            quotes = False
            end = page.find(">", found.end())
            if end < 0:
                break
            at, rest = end + 1, page[found.end() : end]
        if tag in SKIPPED:
            if not closing and not rest.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                at = shut.end() if shut else n
            say(" ")
            continue
        if tag == "a":
            in_link = not closing and start in links and "href" in rest.lower()
            if in_link:
                linked.append(" ")
        elif tag == "br":
            say("\n")
        if tag not in BLOCKS:
            continue
        close()
        if closing:
            if is_open[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if stack[-1][0] == "p" or (stack[-1][0] in _HEADINGS and tag in _HEADINGS):
            cut(len(stack) - 1)
        if tag in _ENDS and any(is_open[name] for name in _ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _LISTS:
                    break
                if stack[i][0] in _ENDS[tag]:
                    cut(i)
                    break
        if tag in VOID:
            continue
        if len(stack) > DEEPEST:
            cut(len(stack) - 1)
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        _, furniture, article, region, label = stack[-1]
        level = _level(tag, attributes)
        furniture += tag in FURNITURE_TAGS or (tag == "header" and not article) or (tag not in ("html", "body", "main") and _hidden(attributes))
        articles += tag == "article" and not level
        if region:
            region.articles += tag == "article" and not level
            region.main |= tag == "main"
        if level:
            region = Region(region, level)
            regions.append(region)
        article += tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
        stack.append((tag, furniture, article, region, attributes.get("data-label", label)))
        is_open[tag] += 1
    close()
    for region in reversed(regions):
        if region.parent:
            region.parent.articles += region.articles
            region.parent.main |= region.main
    for region in regions:
        # A region around the page's one article is a wrapper, whatever its name.
        region.main |= articles == region.articles == 1
        if region.main:
            region.level = 0
        if region.parent:
            region.level = max(region.level, region.parent.level)
    # Words that could be main text: unlinked ones outside furniture, adverts and comments.
    total = 1
    for block in out:
        block.named = block.region.level if block.region else 0
        if not block.furniture and block.links <= 0.5 and block.named < 2:
            total += block.words
            if block.region:
                block.region.words += block.words
    for region in reversed(regions):
        if region.parent:
            region.parent.words += region.words
    for block in out:
        region = block.region
        while region and region.parent and region.main:
            region = region.parent
        block.region_words, block.region_share = (region.words, region.words / total) if region and block.named else (0, 0.0)
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` per block; beyond the page's ends lie blocks without words."""
    words, links = np.array([b.words for b in found], float), np.array([b.links for b in found], float)
    before, after = (lambda x: np.append(0.0, x[:-1])), (lambda x: np.append(x[1:], 0.0))
    rest = [np.array([getattr(b, name) for b in found], float) for name in FEATURES[6:]]
    return np.stack([words, links, before(words), before(links), after(words), after(links), np.minimum(rest[0], 1), np.minimum(rest[1], 1), *rest[2:]], axis=1)


class Tree:
    """A binary decision tree grown by the least Gini impurity; equal splits go to the first feature and least value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 2) -> None:
        self.share = float(y.mean())
        self.feature = None
        if depth and len(y) >= 2 * least and 0 < self.share < 1:
            best = (2 * self.share * (1 - self.share) - 1e-9, None, None)
            sizes = np.arange(1, len(y))
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                values, ones = x[order, f], np.cumsum(y[order])
                left, right = ones[:-1] / sizes, (ones[-1] - ones[:-1]) / sizes[::-1]
                impurity = (2 * left * (1 - left) * sizes + 2 * right * (1 - right) * sizes[::-1]) / len(y)
                impurity[(values[1:] == values[:-1]) | (sizes < least) | (sizes[::-1] < least)] = np.inf
                i = int(np.argmin(impurity))
                best = min(best, (float(impurity[i]), f, float(values[i] + values[i + 1]) / 2), key=lambda b: b[0])
            if best[1] is not None:
                self.feature, self.cut = best[1:]
                left = x[:, self.feature] <= self.cut
                self.left, self.right = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The share of main text among the training blocks of each row's leaf."""
        if self.feature is None:
            return np.full(len(x), self.share)
        out = np.empty(len(x))
        left = x[:, self.feature] <= self.cut
        out[left], out[~left] = self.left.shares(x[left]), self.right.shares(x[~left])
        return out


def trained() -> Tree:
    """The tree grown on the labelled pages, whose blocks carry ``data-label``."""
    rows, labels = [], []
    for page in labelled_pages():
        found = blocks(page)
        rows.append(features(found))
        labels += [b.label == "main" for b in found]
    return Tree(np.concatenate(rows), np.array(labels, float))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` per row: the main blocks in page order, joined by line breaks.

    Inside a block, references are decoded and white space becomes one space.  A null or
    empty page, and one without main text, has an empty text.  Repeated rows each have a
    row; other columns are ignored.  Pages are read whole, one by one, without a shuffle.
    """
    tree = trained()  # a few dozen numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [blocks(page or "") for page in part.column("html").to_pylist()]
                rows = [features(f) for f in found if f]
                main = iter((tree.shares(np.concatenate(rows)) >= 0.5).tolist() if rows else [])
                kept = [[b.text for b in f if next(main)] for f in found]
                texts = ["\n".join(k) for k in kept]
                columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int32()), pa.array([len(k) for k in kept], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(task, SCHEMA)
