"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once as a flat list of blocks, without building a tree of elements: block-level tags and ``hr`` part blocks, inline tags
and ``br`` (white space) don't.  Scripts, styles, templates, comments and the head give no text; formulas (``math``) do.  Each block has its words, the share
of its words within links, the same of the block before and after it, whether it lies in the main element or has a mark of
boilerplate (in ``nav``, ``footer``, ``aside``, ``form``, a page's ``header``, or an element whose class, id or role says advert,
menu, notice, comments and the like), whether it is a heading, and whether a paragraph, quotation or heading holds it.  In a page without
``article`` or ``main`` an element whose class or id says content or article body is the main element.  A decision tree (CART, Gini) trained on the labelled blocks of
``html_table`` decides.  Malformed pages are read as far as they go: unclosed tags end with their parent, stray ends are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table, texts
from .html_table import PAGES

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>""", re.S)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "canvas", "video", "audio")}
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "search"))
_MAIN = frozenset(("article", "main"))
#: A new one of these ends an open one of the second set, up to the nearest of the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label|data-component)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_CUE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|toc|footer|foot|masthead|topbar|site-?header|page-?header|global-?header|contentinfo|complementary|search"
    r"|sidebars?|side-?bar|aside|widgets?|related|recommend(?:ed|ations?)?|more-?(?:stories|articles|posts)|read-?next|trending|popular|teasers?|cookies?|consent|gdpr|notices?|alerts?|disclaimer|paywall|subscribe|subscription|newsletters?|signup|sign-?up|login|log-?in|modal|popup|pop-?up|overlay|toast"
    r"|comments?|commentlist|comment-?(?:list|section|form)|disqus|respond|replies|reply|discussion|reader-?comments?|shar(?:e|ing)|social|follow-?us|tags?|tag-?list|byline-?links|copyright|legal|imprint|pullquote|skip-?link|screen-?reader(?:-text)?)(?:$|[^a-z])"
)
_CONTENT = re.compile(r"(?:^|[^a-z])(?:(?:article|post|entry|story|main|page|blog|news|text|item)-?(?:body|content|text|main)|content|contents|main|article|articlebody|post|entry|story|hentry|prose|markdown-body)(?:$|[^a-z])")
#: Names that tell a state or a topic and not what an element is: has-sidebar, comments-open, ad-free, tag-python.
_STATE = re.compile(r"(?:(?:has|no|not|with|without|is|hide|show)-.*|(?:tag|category|type|format|status)-(?!(?:lists?|links?|clouds?)$).*|.*-(?:open|opened|closed|enabled|disabled|free))\Z")
#: Names of the wrapper of an article's text, which no other name makes boilerplate.
_WRAPPER = re.compile(r"(?:(?:article|post|entry|story|main|page|blog|news)-?(?:body|content|text|main)|content|main|article|hentry|prose|markdown-body)\Z")
_PARAGRAPH = frozenset(("p", "pre", "blockquote", *_HEADING))
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _named(rest: str) -> list[tuple[str, str]]:
    return [(k.lower(), _CAMEL.sub("-", a or b or c).replace("_", "-").lower()) for k, a, b, c in _NAMED.findall(rest)]


def _names(rest: str) -> list[str]:
    return [x for _, x in _named(rest)]


def _marked(tag: str, rest: str, inside_main: bool, inside_article: bool = False) -> bool:
    """Whether an element is boilerplate by its tag, its names, or being hidden.

    Class and id count name by name, without those of states and topics; they don't mark the wrapper of an article's text,
    nor an article that is in no other article.
    """
    if tag in _BOILER_TAGS or tag == "header" and not inside_main:
        return True
    if not rest or tag in ("body", "html", "main"):
        return False
    if _HIDDEN.search(rest):
        return True
    named = _named(rest)
    if any(k not in ("class", "id") and _CUE.search(x) for k, x in named):
        return True
    own = [y for k, x in named if k in ("class", "id") for y in x.split()]
    if tag == "article" and not inside_article or any(map(_WRAPPER.match, own)):
        return False
    return any(_CUE.search(x) and not _STATE.match(x) for x in own)


class Block:
    __slots__ = ("boiler", "content", "heading", "linked", "main", "paragraph", "text", "words")

    def __init__(self, parts: list[str], linked: int, main: bool, content: bool, boiler: bool, heading: bool, paragraph: bool):
        self.text = " ".join("".join(parts).split())
        self.words, self.linked = self.text.count(" ") + 1 if self.text else 0, linked
        self.main, self.content, self.boiler, self.heading, self.paragraph = main, content, boiler, heading, paragraph


def blocks(page: str | None) -> list[Block]:
    """The blocks with text of a page, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, main, content, boilerplate: of the open elements that matter
    parts: list[str] = []
    linked, link, main, content, boiler, heading, paragraph, head = 0, 0, 0, 0, 0, 0, 0, False
    open_: Counter[str] = Counter()
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            made = Block(parts, linked, main > 0, content > 0, boiler > 0, heading > 0, paragraph > 0)
            if made.text:
                out.append(made)
            parts.clear()
        linked = 0

    def words(text: str) -> None:
        nonlocal linked
        if head or not text:
            return
        text = _html.unescape(text) if "&" in text else text
        parts.append(text)
        if link:
            linked += len(text.split())

    def pop(k: int) -> None:
        nonlocal link, main, content, boiler, heading, paragraph
        while len(stack) > k:
            tag, is_main, is_content, is_boiler = stack.pop()
            open_[tag] -= 1
            main, content, boiler = main - is_main, content - is_content, boiler - is_boiler
            link -= tag == "a"
            heading -= tag in _HEADING
            paragraph -= tag in _PARAGRAPH

    at, size = 0, len(page)
    last = page.rfind(">") + 1  # beyond it there are no tags
    while at < size:
        m = _TOKEN.search(page, at, last)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if tag in _BLOCK:
                flush()
            if tag == "head":
                head = False
            for k in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end doesn't end a block
            continue
        if tag in _RAW:
            if not rest.endswith("/") and tag not in unended and (e := _RAW[tag].search(page, at)):
                at = e.end()
                continue
            unended.add(tag)
            if not rest.endswith("/") and tag in ("script", "style", "title", "textarea"):
                at = size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag == "head":
                head = True
            elif head and tag != "head":
                head = False
            # a paragraph ends before another block; links and headings don't go on beyond it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("p", *_HEADING) and tag != "hr":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
            if tag in _CLOSES and any(open_[x] for x in _CLOSES[tag][0]):
                own, stop = _CLOSES[tag]
                first = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in own:
                        first = k
                    elif first is not None:
                        break
                if first is not None:
                    pop(first)
        elif tag == "a":
            for k in range(len(stack) - 1, -1, -1):  # links don't nest
                if stack[k][0] == "a":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCK and tag != "a":
            continue
        if tag in _BLOCK or tag == "a" or rest:
            is_main = tag in _MAIN
            is_boiler = _marked(tag, rest, main > 0, open_["article"] > 0)
            is_content = not is_boiler and tag in ("div", "section", "td") and any(map(_CONTENT.search, _names(rest)))
            stack.append((tag, is_main, is_content, is_boiler))
            open_[tag] += 1
            main, content, boiler = main + is_main, content + is_content, boiler + is_boiler
            link += tag == "a"
            heading += tag in _HEADING
            paragraph += tag in _PARAGRAPH
    flush()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "page_has_main", "boiler", "heading", "paragraph")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    inside = [b.main for b in found]
    if not any(b.main and not b.boiler for b in found):
        inside = [b.content for b in found]
    has = float(any(i and not b.boiler for i, b in zip(inside, found)))
    own = [(float(b.words), min(1.0, b.linked / b.words)) for b in found]
    ends = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*ends[k + 1], *ends[k], *ends[k + 2], float(inside[k]), has, float(b.boiler), float(b.heading), float(b.paragraph)) for k, b in enumerate(found)]


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple | float:
    """A binary tree by the least Gini impurity: (feature, threshold, low, high), or the share of main text in a leaf."""
    if depth == 0 or len(y) < 2 * least or _gini(y) == 0:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            if least <= low.sum() <= len(y) - least:
                cost = (low.sum() * _gini(y[low]) + (~low).sum() * _gini(y[~low])) / len(y)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), low)
    if best is None or best[0] >= _gini(y) - 1e-9:
        return float(y.mean())
    _, f, t, low = best
    return f, t, train(x[low], y[low], depth - 1, least), train(x[~low], y[~low], depth - 1, least)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training table."""
    x, y = [], []
    for page in PAGES:
        found = blocks(page)
        for b, f in zip(found, features(found)):
            if b.text[0] not in "+-":
                raise ValueError(f"no label: {b.text}")
            x.append(f)
            y.append(b.text[0] == "+")
    return np.array(x), np.array(y, float)


def varied(x: np.ndarray, y: np.ndarray, copies: int = 40, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The rows with copies of other sizes where the frame alone decides: marks of boilerplate, blocks beside the main element,
    blocks within it that aren't links, and paragraphs of pages without a frame."""
    rng = np.random.default_rng(seed)
    main, has, boiler = x[:, 6] > 0, x[:, 7] > 0, x[:, 8] > 0
    framed = (boiler & (y == 0)) | (has & ~main & (y == 0)) | (main & ~boiler & (x[:, 1] < 0.5) & (y == 1))
    framed |= ~has & ~boiler & (x[:, 10] > 0) & (x[:, 1] < 0.5) & (y == 1)
    more = np.repeat(x[framed], copies, axis=0)
    for words, links in ((0, 1), (2, 3), (4, 5)):
        more[:, words] = np.round(np.exp(rng.uniform(0, 6, len(more))))
        if words:
            more[:, links] = rng.choice([0.0, 0.0, 0.3, 1.0], len(more))
    return np.concatenate([x, more]), np.concatenate([y, np.repeat(y[framed], copies)])


@lru_cache(maxsize=1)
def tree() -> tuple | float:
    return train(*varied(*labelled()), depth=10, least=3)


def is_main(f: tuple[float, ...]) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if f[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    found = blocks(page)
    return "\n".join(b.text for b, f in zip(found, features(found)) if is_main(f))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row; null and empty pages have an empty text.  Repeated rows each get a row."""

    def run(batch):
        made = [main_text(x) for x in texts(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", "html")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
