"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is how far the words of such blocks lay inside the article on pages that
label their own (by an article or main element), less a half: a block is told by its element, its share of linked words and
its length, so paragraphs score positive, and menus, teasers and short boxes negative. Tags score negative. On a page that
labels its article, words outside it are another feature. One linear scan finds the contiguous region of the highest sum, and its
blocks are the text.

What is never text of an article is left out before the scan, and inside the region: scripts, menus, forms, footers, headers of the page and
the like by their element, adverts, comments, notices and the like by a class that says nothing else, and classes that the labelled pages never
have inside an article. A class that says so only in part (``share-price-history``) goes if half of the element's words are links.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks

#: Pages that a fit uses at most (in expectation: they are taken by a hash of the id).
MAX_LABELLED = 4000
#: Words of weight that a feature takes from the feature it refines, and what each tag costs at least.
PRIOR, TAG_COST = 8.0, 0.02
#: Words that a class must have had on the labelled pages, all of them outside the articles, to be left out.
SUPPORT = 200
#: A block is long from so many words on.
LONG = 10

#: Elements by role.
RAW = "script style noscript template textarea title svg iframe object select canvas audio video".split()
LEFT_OUT = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "head", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas: their elements stand in a line of text.
INLINE |= set("math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NAMES = INLINE | LEFT_OUT | VOID | BLOCKS
#: Elements that hold text themselves: one goes only if all of its classes are marked, not if one of several is.
TEXTUAL = INLINE | set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd figure figcaption".split())
ITEMS = {"li", "td", "th", "tr", "dt", "dd"}
#: Words in a class, id or role that mark an element as no part of an article.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice notices notification popup promo promoted related replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that only tell where or what kind of box an element is; a class of marks and of these alone is marked.
PLACES = set(
    "area articles bar bottom box block btn button buttons column container content global group header icon icons inner item items left link links list main module page panel posts post "
    "primary region right row secondary section site slot stories story strip text title top unit wrap wrapper zone".split()
)
#: Words in a class that tell an article's own parts.
OWN = {"article", "entry", "post", "story"}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|([^<]+|<)",
    re.I | re.S,
)


def classes(attributes: str) -> list[str]:
    """The names in class, id and role, in lower case."""
    return " ".join(x or y or z for x, y, z in ATTRIBUTE.findall(attributes)).lower().split()


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[_\-\d]+", name) if p]


def marked(name: str) -> bool:
    """Whether a class says that an element is no text, and nothing else."""
    parts = _parts(name)
    return any(p in MARKS for p in parts) and all(p in MARKS or p in PLACES for p in parts)


class Element:
    """An element of a page, with what its whole content has: words, words in links, and the names of its children."""

    __slots__ = ("name", "above", "own", "hidden", "block", "link", "words", "linked", "below", "out", "article", "around")

    def __init__(self, name: str, above: "Element | None", attributes: str):
        self.name, self.above = name, above
        self.own = classes(attributes) if attributes and name not in ("html", "body") else []
        self.hidden = bool(attributes and HIDDEN.search(attributes))
        self.block = above.block if above and name in INLINE else name
        self.link = name == "a" or bool(above and above.link)
        self.words = self.linked = 0
        self.below: set[str] = set()
        self.out = self.article = False
        self.around: tuple = ()


def parsed(page: str) -> tuple[list[Element], list[tuple[str, str, Element]]]:
    """The elements of a page in order, and its tags and texts: ("tag", name, the element around it) and ("text", text, its element).

    Paragraphs and items end where HTML lets them, and end tags without a start are not there.
    """
    root = Element("body", None, "")
    elements, events, stack, open_names = [root], [], [root], {}

    def close(name: str) -> None:
        while len(stack) > 1:
            top = stack.pop().name
            open_names[top] -= 1
            if top == name:
                return

    for m in TOKEN.finditer(page):
        slash, name, attributes, text = m.group(2, 3, 4, 5)
        if text is not None:
            at, n = stack[-1], len(text.split())
            at.words += n
            at.linked += n * at.link
            events.append(("text", text, at))
        elif name is not None:
            name = name.lower()
            if name not in NAMES:
                name = "div" if "-" in name else "span"
            if slash:
                if open_names.get(name):
                    close(name)
                events.append(("tag", name, stack[-1]))
                continue
            if name not in INLINE and name not in VOID and open_names.get("p"):
                close("p")
            if name in ITEMS and stack[-1].name == name:
                close(name)
            events.append(("tag", name, stack[-1]))
            if name not in VOID:
                new = Element(name, stack[-1], attributes)
                stack[-1].below.add(name)
                elements.append(new)
                stack.append(new)
                open_names[name] = open_names.get(name, 0) + 1
    for e in reversed(elements[1:]):  # children come after their parents
        e.above.words += e.words
        e.above.linked += e.linked
    return elements, events


def article_of(elements: list[Element]) -> Element | None:
    """The one outermost article element of a page, or else its one main element; none where a page does not label its article so."""
    for name in ("article", "main"):
        found = []
        for e in elements:
            above = e.above
            if e.name == name:
                while above and above.name != name:
                    above = above.above
                if not above:
                    found.append(e)
        if len(found) == 1:
            return found[0]
    return None


def _page_header(e: Element) -> bool:
    """Whether a header is the page's and not an article's own: not in an article or beside paragraphs, and not called an article's by its class."""
    if e.above.article or e.above.name in ("article", "main") or any(p in OWN for c in e.own for p in _parts(c)):
        return False
    return e.above.above is None or e.above.name in ("body", "html") or "p" not in e.above.below and bool(e.above.below & {"nav", "aside", "footer"} or not e.above.words)


def judged(elements: list[Element], dropped: frozenset = frozenset()) -> Element | None:
    """Sets out, article and around of all elements; returns the page's article element. dropped are classes that are left out besides the marked ones."""
    article = article_of(elements)
    holds, up = set(), article
    while up:
        holds.add(up)
        up = up.above
    for e in elements[1:]:
        above = e.above
        e.article = above.article or e is article
        e.around = above.around + tuple(e.own)
        out = above.out or e.hidden
        if not out and e not in holds:
            few = 2 * e.words <= elements[0].words  # a form around most of the page is no form to fill in
            out = e.name in LEFT_OUT and (few or e.name not in ("form", "fieldset", "label")) or e.name == "header" and _page_header(e)
            if not out and e.own:
                full = [marked(c) or c in dropped for c in e.own]
                part = any(p in MARKS for c in e.own for p in _parts(c))
                out = (all(full) if e.name in TEXTUAL else any(full)) or part and e.words > 0 and 2 * e.linked >= e.words
        e.out = out
    return article


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def runs(events: list[tuple[str, str, Element]], told: bool) -> list[tuple[str, str, tuple, Element]]:
    """(kind, text, features, element) of a judged page in order; features, from the coarse to the fine, are those of the block that the text stands in.

    kind is "tag" for a tag between blocks, "text" for words, and "out" for words and tags that are left out. A block is linked
    where half of its words are links; a heading is, too, if the block that it stands over is.
    """
    found: list[list] = []  # [kind, text, element, number of the block]
    blocks: list[list] = [[0, 0, ""]]  # words, linked words, element
    for kind, text, e in events:
        if kind == "text":
            n = len(text.split())
            blocks[-1][0] += n
            blocks[-1][1] += n * e.link
            blocks[-1][2] = blocks[-1][2] or n and e.block
            found.append(["out" if e.out else "text", text, e, len(blocks) - 1])
        elif text == "br" or text not in INLINE:
            if blocks[-1][0]:
                blocks.append([0, 0, ""])
            found.append(["out" if e.out else "tag", text, e, -1])
    dense = below = 0
    told_by = []
    for n, linked, name in reversed(blocks):
        dense = 0 if not linked else 1 if 2 * linked < n else 2
        dense = 2 if name in HEADINGS and below == 2 else dense
        below = dense if n else below
        told_by.append(f"|{dense}|{'long' if n >= LONG else 'short'}")
    told_by.reverse()
    out = []
    for kind, text, e, k in found:
        side = ("+in" if e.article else "+out") if told and kind != "out" else ""
        features = ("<" + text + side,) if k < 0 else ("*" + told_by[k] + side, e.block + told_by[k] + side)
        out.append((kind, text, features, e))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous scores of the highest sum, the first of equals; empty if none is above 0. One linear scan."""
    best = total = 0.0
    start = first = last = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def root_share(feature: str) -> float:
    """The share of words inside articles that is assumed for a coarse feature before any page is seen."""
    if feature.endswith("+in"):
        return 0.95
    if feature.endswith("+out"):
        return 0.05
    _, dense, size = feature.split("|")
    return 0.2 if dense == "2" else 0.75 if size == "long" else 0.6


def word_score(features: tuple, weights: dict[str, float]) -> float:
    """A word's score: that of its finest feature that is known."""
    for f in reversed(features):
        if f in weights:
            return weights[f]
    return root_share(features[0]) - 0.5


def extract(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by newlines; empty if no words score."""
    elements, events = parsed(page)
    told = judged(elements, frozenset(k[1:] for k in weights if k[0] == ".")) is not None
    pieces, scores = [], []
    for kind, text, features, _ in runs(events, told):
        if kind == "tag":
            scores.append(min(weights.get(features[0], -TAG_COST), -TAG_COST))
        elif kind == "text":
            scores.append(len(text.split()) * word_score(features, weights))
        else:
            continue
        pieces.append((kind, text))
    first, last = best_region(scores)
    blocks, held = [], []
    for kind, text in pieces[first:last]:
        if kind == "text":
            held.append(text)
        elif text == "br":
            held.append(" ")
        else:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


COUNTED = pa.schema([("feature", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])


def _counted(batches, dropped: frozenset | None):
    """Words by class, or, where the classes to be left out are known, words by feature and tags with and without their side, inside and outside labelled articles."""
    seen: dict[str, list[int]] = {}

    def note(feature: str, side: int, n: int) -> None:
        seen.setdefault(feature, [0, 0])[side] += n

    for batch in batches:
        for page in batch.column(0).to_pylist():
            elements, events = parsed(page or "")
            if judged(elements, dropped or frozenset()) is None:
                continue
            for kind, text, features, e in runs(events, False):
                side, tag = 0 if e.article else 1, features[0][0] == "<"
                n = 1 if tag else len(text.split())
                if dropped is None:
                    for name in set(e.around) if not tag else ():
                        note("." + name, side, n)
                    continue
                # What a class or an element has left out tells about links, but not about all blocks of that kind.
                if kind == "out" and not features[0].startswith(("*|1", "*|2")):
                    continue
                for f in features:
                    note(f, side, n)
                    if kind != "out":
                        note(f + ("+in", "+out")[side], side, n)
    yield from chunks(((f, a, b) for f, (a, b) in seen.items()), COUNTED)


def fit(pages: DataFrame, bound: int = MAX_LABELLED, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights by feature from about ``bound`` pages, and the classes that are never inside an article.

    A word's weight is its feature's share of words inside articles, less a half; a fine feature leans on the coarse one where it has been seen
    little. Linked words that are left out count, too. Null pages teach nothing and repeated rows count each. A page is read whole,
    whatever its length. Pages without one outermost article or main element are not labelled; without any that is, only the shares
    that are assumed before hold.
    """
    n = pages.count()
    draw = F.pmod(F.xxhash64(id_col, F.lit("draw")), F.lit(1_000_000))
    sample = pages.filter(draw < F.lit(round(1e6 * min(1.0, bound / max(n, 1))))).select(html_col)

    def counted(dropped: frozenset | None) -> DataFrame:
        each = sample.mapInArrow(lambda batches: _counted(batches, dropped), "feature string, inside long, outside long")
        return each.groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))

    # Both results are bounded by the sample: classes with so many words, then elements and sides.
    names = [r.feature for r in counted(None).filter(f"a = 0 and b >= {SUPPORT}").collect()]
    rows = {r.feature: (r.a, r.b) for r in counted(frozenset(n[1:] for n in names)).collect()}
    return weighed(rows) | {n: -0.5 for n in names}


def weighed(rows: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of features from their counts inside and outside."""
    shares: dict[str, float] = {}
    for f in sorted(rows, key=lambda f: f[0] != "*"):  # coarse ones first
        a, b = rows[f]
        coarse = "*" + f[f.index("|") :] if f[0] != "<" else ""
        before = 0.5 if f[0] == "<" else root_share(f) if f[0] == "*" else shares.get(coarse, root_share(coarse))
        shares[f] = (a + PRIOR * before) / (a + b + PRIOR)
    return {f: -TAG_COST - (1 - s) * 0.2 if f[0] == "<" else s - 0.5 for f, s in shares.items()}


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each whole page. A null or empty page, and one without words, gives the empty text; repeated rows are read each."""

    def run(batches):
        def rows():
            for batch in batches:
                for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                    text = extract(page or "", weights)
                    yield page_id, url, text, len(text)

        yield from chunks(rows(), EXTRACTED, 512)

    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
