"""Main text of web pages: flat blocks judged by a decision tree.

Method. The html is cut into flat text blocks at every tag that isn't inline;
scripts, styles, heads, forms' controls and comments are left out. A block's
features are its words, its link density (words in links / words), both of these
of the block before and after, whether it ends as a sentence does, and places:
inside a paragraph, a heading, an article or main element, and how surely inside a
boilerplate element (2 by its tag: menu, footer, sidebar, form; 1 only by a class,
id or role that names one). A small decision tree (CART, Gini) over these is
trained from the labelled pages below each time it is made, and it alone decides
which blocks are main text; a third of those pages have no article element, and
some have articles that are teasers.

Character references are decoded, white space inside a block becomes one space,
the ends are trimmed, empty blocks go, and blocks are joined in page order by two
line feeds. Nothing else is dropped or capped. Unclosed elements end with the
element around them; those left out (buttons, videos and the like) also at the next
block-level tag, and a head at its first tag or text that belongs to the body.
Only scripts, styles and other raw text without an end tag go to the end of the
page, as in HTML. A link lasts over the blocks inside it, to its end tag or the end
of the element that it stands in. Where a quotation mark in a tag is never closed,
that tag ends at its first ``>``, and quotation marks in the tags after it don't count.

Scale: a narrow map over whole pages, nothing moves. Pages are scanned once, in
time linear in their length. Memory follows the largest page. The tree is a few
hundred bytes.

Nulls and odd rows: a null or empty html gives the empty text, as does a page
without main text. Repeated rows are treated each. Bytes that aren't UTF-8 become
replacement characters. Very long pages are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import texts_of

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "sentence", "paragraph", "heading", "article", "boilerplate")

# Pages labelled by hand. A block of main text begins with the mark; ``~9`` stands for nine words.
MARK = "\N{PILCROW SIGN}"
LABELLED = (
    # A news site: menu, advert, article, sidebar, footer.
    "<nav><ul><li><a>~1</a><li><a>~2</a><li><a>~1</a></ul></nav><div class=ad>~7.</div><article><h1>¶~8.</h1><p>¶~41.<p>¶~3.<p>¶~120.<p>¶~1.<p>¶~66.</article><footer>~5. ~2 <a>~2</a></footer>",
    "<nav><a>~1</a></nav><div class=ad>~22.</div><article><h1>¶~12</h1><p>¶~12 ~30.<p>¶~2.<p>¶~1.<p>¶~9.<p>¶~2.</article><footer>~12.</footer>",
    "<nav><a>~1</a> <a>~1</a></nav><div class=ad>~4</div><article><h1>¶~2</h1><p>¶~1.</article><footer>~40.</footer>",
    "<header><h1><a>~2</a></h1><p>~6.</p></header><main><h1>¶~6</h1><p>¶~35 <a>~4</a>.<p>¶~90.<h2>¶~3</h2><p>¶~55.<ul><li>¶~6<li>¶~4 <a>~2</a><li>¶~11.</ul><blockquote><p>¶~18.</blockquote></main><aside><h3>~2</h3><p>~25.<p><a>~6</a></aside><footer><p>~14.</footer>",
    # An article with a notice, an advert, a form, shares, related teasers and readers' comments inside.
    "<article><h1>¶~7</h1><div class=share><a>~1</a> <a>~1</a></div><p>¶~52.<div class='notice'><p>~14.</div><p>¶~8.<div class=ad-slot>~9.</div><p>¶~33 <a>~3</a> ~9.<form><p>~12.<label>~2</label></form><p>¶~21.<div class=related-posts><h3>~2</h3><p><a>~7</a><p><a>~6</a></div><section id=comments><h2>~2</h2><p>~40.<p>~3.<p>~65.</section></article>",
    "<article class=post><header><h1>¶~5</h1><p>¶~4 <a>~2</a></header><p>¶~70.<figure><figcaption>¶~9.</figcaption></figure><p>¶~44.<aside><p>~30.</aside><p>¶~15.<p>¶<a>~5</a></article><div class=sidebar><p>~28.<ul><li><a>~3</a><li><a>~4</a></ul></div>",
    # Teasers marked up as articles beside the one that is read.
    "<article><h1>¶~9</h1><p>¶~48.<p>¶~88.</article><section><article><h3><a>~7</a></h3></article><article><h3><a>~6</a></h3></article><article><h3><a>~9</a></h3></article></section><footer>~6</footer>",
    "<main><article><h2><a>~8</a></h2></article><article><h2><a>~6</a></h2></article><article><h2><a>~5</a></h2></article></main><footer>~9.</footer>",
    "<article><div><a>~3</a></div><div><a>~1</a></div><div><a>~2</a></div><h1>¶~6</h1><p>¶~31.<p>¶~46.<div><a>~5</a></div><div><a>~4</a></div></article>",
    # Documentation: lists, tables and code in the main element.
    "<nav><ul><li><a>~2</a><li><a>~2</a></ul></nav><main><h1>¶~3</h1><p>¶~19.<pre>¶~25</pre><table><tr><th>¶~1<th>¶~1<tr><td>¶~1<td>¶~6<tr><td>¶~2<td>¶~8</table><h2>¶~2</h2><ol><li>¶~5<li>¶~13.</ol><p>¶~7:</p><pre>¶~3</pre></main><footer>~11</footer>",
    # No article element: plain divisions.
    "<div><a>~1</a></div><div><a>~1</a></div><div><a>~2</a></div><h1>¶~7</h1><p>¶~45.<p>¶~80.<p>¶~6.<p>¶~62.<p>¶~1.<div><a>~2</a></div><div>~4</div>",
    "<div class=menu><a>~1</a> <a>~1</a></div><div class=content><h2>¶~4</h2><p>¶~39.<p>¶~5.<p>¶~2.<p>¶~71 <a>~2</a> ~5.<p>¶<a>~4</a> ~3.</div><div class=sidebar><p>~33.</div><div class=footer>~12.</div>",
    "<div>~3</div><div><a>~2</a> <a>~1</a> <a>~1</a></div><div>¶~85.</div><div>¶~60.</div><div>¶~34.</div><div><a>~3</a></div><div>~2</div>",
    "<div><a>~1</a> <a>~1</a></div><div class=ad>~6.</div><div><h1>¶~8</h1><p>¶~24.<p>¶~3.<p>¶~110.<p>¶~1.</div><div>~3 <a>~2</a></div>",
    "<ul><li><a>~1</a><li><a>~1</a><li><a>~2</a></ul><div class=advert>~8.</div><div><h1>¶~6.</h1><p>¶~2.<p>¶~57.<p>¶~29.</div><footer>~4 ~3.</footer>",
    "<ul><li><a>~2</a><li><a>~1</a></ul><h1>¶~5</h1><p>¶~40.<ul><li>¶~12.<li>¶~15 <a>~2</a>.<li>¶~9.</ul><p>¶~37.<div>~5</div><div><a>~2</a> <a>~3</a></div>",
    # Front pages and lists of links: no main text.
    "<div><h3><a>~6</a></h3></div><div><h3><a>~8</a></h3></div><div><a>~3</a></div><div>~4</div><div>~2 <a>~1</a></div><footer>~15.</footer>",
    "<ul><li><a>~4</a><li><a>~6</a><li><a>~5</a> ~1<li><a>~20</a></ul><div>~3</div><div><a>~1</a></div>",
    "<nav>~2</nav>", "<form><p>~9.<p>~20.</form>", "<div><a>~30</a></div><div><a>~42</a></div>", "<article><p>¶~3", "<p>¶~50.", "<main><p>¶~6.<p>¶~2", "<article>¶~1",
)

# Fixed HTML facts.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics".split())
RAW = frozenset("script style iframe textarea title".split())
QUIET = frozenset("noscript template svg object canvas audio video select button annotation annotation-xml".split())
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
# Tags that end an unclosed element of ``QUIET``.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside rail widget "
    "comment comments reply replies respond disqus notice notices notification cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended toolbar pagination pager search complementary contentinfo skip copyright disclaimer legal".split()
)
# Words that follow one of these in a name, like ``comment-list``.
PARTS = frozenset("area areas bar block body box boxes button buttons col column container content entry feed fixed footer form group header holder inner item items left line link links list module outer panel post posts right row section slot text title top unit wrap wrapper zone".split())
PARAGRAPHS = frozenset("p pre blockquote figcaption".split())
# Of the hints: names of readers' comments (which are articles too at times), and of headers (an article may have its own).
READERS = frozenset("comment comments reply replies".split())
HEADERS = frozenset("header masthead".split())
# Parts of names that tell of something elsewhere, like ``with-sidebar``.
_NEGATED = frozenset("with has no without".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUIET = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})\b[^<>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)({'|'.join(sorted(QUIET, key=len, reverse=True))})(?=[\s/>])([^<>]*)>?",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def _names_boilerplate(token: str, hints: frozenset[str]) -> bool:
    """Whether a class, id or role names a boilerplate element, like ``site-footer`` or ``comment-list``, not like ``search-algorithms``."""
    parts = _PART.findall(token)
    return bool(parts) and not _NEGATED.intersection(parts) and (parts[-1] in hints or parts[0] in hints and all(x in PARTS or x in hints for x in parts[1:]))


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """2 for an element that is boilerplate by its tag, 1 by a name, else 0."""
    if name in BOILERPLATE:
        return 0 if name == "header" and in_article else 2
    if not attributes or name in ("body", "html", "p") or name in HEADINGS:
        return 0
    hints = READERS if name in ARTICLE else HINTS - HEADERS if in_article else HINTS
    tokens = (t for m in _NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split())
    return int(any(_names_boilerplate(t, hints) for t in tokens))


def _quiet_ends(html: str) -> dict[int, int]:
    """Where each element of ``QUIET`` that has an end tag begins and ends."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for m in _QUIET.finditer(html):
        if not m[3]:
            continue
        own = opened.setdefault(m[3].lower(), [])
        if not m[2]:
            if not m[4].endswith("/"):
                own.append(m.start())
        elif own:
            ends[own.pop()] = m.end()
    return ends


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags, comments and declarations with an empty name; send a place to go on there."""
    at, last, quotes = html.find("<"), html.rfind(">"), True
    while 0 <= at:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            found = (at, end, False, "", "")
        elif at > last:  # no tag can end
            at = html.find("<!--", at + 1)
            continue
        elif m := _NAME.match(html, at + 1):
            rest = _QUOTED.match(html, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else html.index(">", m.end()) + 1
            found = (at, end, m[0][0] == "/", m[0].lstrip("/").lower(), html[m.end() : end - 1])
        elif html.startswith(("<!", "<?"), at):
            end = html.index(">", at) + 1
            found = (at, end, False, "", "")
        else:
            at = html.find("<", at + 1)
            continue
        at = html.find("<", (yield found) or end)


class _Block:
    """Text with what holds where it stands."""

    def __init__(self, text: str, linked: str, place: tuple[int, bool, bool, bool]):
        self.text, self.words, self.linked = text, text.count(" ") + 1, len(linked.split())
        self.boilerplate, self.article, self.heading, self.paragraph = place


def blocks_of(html: str) -> list[_Block]:
    """The flat blocks that have text, in page order."""
    out: list[_Block] = []
    stack: list[tuple[str, tuple[int, bool, bool, bool]]] = []  # elements, and the place outside each
    opened: Counter[str] = Counter()
    place = (0, False, False, False)  # boilerplate, article, heading, paragraph
    link: int | None = None  # elements open where the link began
    quiet = head = False  # inside an unclosed element of QUIET; inside the head
    ends: dict[int, int] | None = None
    parts: list[tuple[str, bool]] = []

    def close_block() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            out.append(_Block(text, " ".join(t for t, in_link in parts if in_link), place))
        parts.clear()

    def add_text(text: str) -> None:
        nonlocal head
        if head and text.strip():
            head = False
        if text and not quiet and not head:
            parts.append((html_lib.unescape(text), link is not None))

    def leave(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal place, link
        place = stack[k][1]
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]
        if link is not None and len(stack) < link:
            link = None

    at, tags, skip = 0, _tags(html), None
    while True:
        try:
            start, end, closing, name, attributes = tags.send(skip)
        except StopIteration:
            break
        add_text(html[at:start])
        at, skip = end, None
        if not name:
            continue
        if name == "head":
            head = not closing and not attributes.endswith("/")
            continue
        if name not in IN_HEAD:
            head = False
        if name in MATH:
            if name in ("mtr", "mtd"):
                parts.append((" ", False))
            continue
        if name in INLINE:
            if name == "a":
                link = None if closing else len(stack)
            elif name == "br":
                parts.append((" ", False))
            continue
        if not closing and name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if found or not attributes.endswith("/"):
                at = skip = found.end() if found else len(html)
            continue
        if not closing and name in QUIET:
            if not attributes.endswith("/"):
                ends = _quiet_ends(html) if ends is None else ends
                quiet = quiet or start not in ends
                at = skip = max(at, ends.get(start, at))
            continue
        if quiet:
            if name not in BLOCKS and not (closing and opened[name]):
                continue
            quiet = False
        close_block()
        if closing:
            if opened[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name not in VOID:
            if stack and (name == "p" or name in HEADINGS or name == "li") and (stack[-1][0] in (name, "p") or name == "p" and stack[-1][0] in HEADINGS):
                leave(len(stack) - 1)  # these end an open one of their kind
            stack.append((name, place))
            opened[name] += 1
            boilerplate, article, _, paragraph = place
            place = (max(boilerplate, _boilerplate(name, attributes, article)), article or name in ARTICLE, name in HEADINGS, paragraph or name in PARAGRAPHS)
    add_text(html[at:])
    close_block()
    return out


_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"')\]\u00BB\u201D\u2019]*$")


def features_of(blocks: list[_Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked / b.words for b in blocks], float)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    places = np.array([(bool(_SENTENCE.search(b.text[-8:])), b.paragraph, b.heading, b.article, b.boilerplate) for b in blocks], float).reshape(-1, 5)
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), places])


def labelled_blocks(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(re.sub(r"~(\d+)", lambda m: " ".join(["word"] * int(m[1])), page))
        y += [b.text.startswith(MARK) for b in blocks]
        x.append(features_of(blocks))
    return np.concatenate(x), np.array(y)


class DecisionTree:
    """CART on Gini impurity: nodes (feature, limit, left, right, answer); rows go left if feature <= limit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, leaf: int = 1):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y.astype(bool), depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        me, share = len(self.nodes), y.mean()
        self.nodes.append((-1, 0.0, -1, -1, bool(share > 0.5)))
        if depth == 0 or share in (0, 1):
            return me
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= limit
                a, b = left.sum(), (~left).sum()
                if min(a, b) < leaf:
                    continue
                impurity = sum(k * p * (1 - p) for k, p in ((a, y[left].mean()), (b, y[~left].mean())))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, limit)
        if best is None:
            return me
        _, f, limit = best
        left = x[:, f] <= limit
        lower = self._grow(x[left], y[left], depth - 1, leaf)
        upper = self._grow(x[~left], y[~left], depth - 1, leaf)
        self.nodes[me] = (f, float(limit), lower, upper, bool(share > 0.5))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def go(k: int, rows: np.ndarray) -> None:
            f, limit, lower, upper, answer = self.nodes[k]
            if f < 0:
                out[rows] = answer
            elif len(rows):
                left = x[rows, f] <= limit
                go(lower, rows[left])
                go(upper, rows[~left])

        go(0, np.arange(len(x)))
        return out


def train(pages: tuple[str, ...] = LABELLED) -> DecisionTree:
    return DecisionTree(*labelled_blocks(pages))


def main_text(html: str | None, tree: DecisionTree) -> str:
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, tree.predict(features_of(blocks)), strict=True) if keep)


def _extract_map(tree: DecisionTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [main_text(h, tree) for h in texts_of(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, tree: DecisionTree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cut.mapInArrow(_extract_map(tree or train()), "page_id long, url string, text string, n_chars long")
