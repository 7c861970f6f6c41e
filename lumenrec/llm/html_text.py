"""Main text of web pages: flat text blocks, classified by a decision tree on words and links of a block and its neighbours.

A page becomes a list of text blocks without nesting. Of each block the tree sees
its words and link density, those of the blocks before and after it, whether it
is a heading or a paragraph, whether it stands in an article or main element or
outside of the page's, and whether an element around it is furniture (by its tag,
by a word of its class, id or role, or because it is not shown). An article
outranks such words around it, so that the name of a wrapper drops nothing. The
tree is grown from the labelled blocks of small pages that LAYOUT lays out by
rule: semantic pages, where the elements decide, and pages of plain div and p
elements, where words and link densities do.

Markup is read in one pass: every search ends where the next one begins, or finds
nothing and is not made again, so the time is linear in the page's length.

Odd input: null and empty html give the empty text; broken markup never fails:
unknown and unclosed tags are passed over, a tag or comment that is not ended takes
the rest of the page; rows of equal page_id are pages each for itself; an empty
table gives an empty result; other columns are ignored.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Elements and names of HTML pages.
RAW = set("script style title textarea".split())
UNTEXT = set("noscript template iframe object svg math canvas select audio video".split())
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block and are not nested.
FLAT = HEADINGS | {"p", "hr"}
FURNITURE_TAGS = set("nav footer aside form menu button dialog search fieldset head".split())
FURNITURE_NAMES = set("nav navbar navigation menu sidebar footer ad ads advert advertisement adsense banner sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe login share related recommended breadcrumb breadcrumbs pagination".split())
#: Outside of articles only: an article's header holds its title.
HEADER_NAMES = set("header masthead topbar toolbar".split())
#: Articles in these are no articles.
COMMENT_NAMES = set("comment comments disqus reply replies".split())

COLUMNS = "words links words_before links_before words_after links_after heading paragraph article furniture".split()

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE).findall
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE).search
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE) for tag in RAW | UNTEXT}


def markup(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag in lower case or "", closing, attributes) along a page; what is no text is left out."""
    at = 0
    unended: set[str] = set()
    while True:
        mark = page.find("<", at)
        if mark < 0 or mark + 1 >= len(page):
            yield page[at:], "", False, ""
            return
        text, after = page[at:mark], page[mark + 1]
        if after in "!?":
            comment = page.startswith("<!--", mark)
            end = page.find("-->" if comment else ">", mark + (4 if comment else 2))
            yield text, "", False, ""
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        closing = after == "/"
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            yield page[at : mark + 1], "", False, ""  # a plain <
            at = mark + 1
            continue
        rest = _ATTRIBUTES.match(page, name.end())
        if not rest:
            yield text, "", False, ""
            return
        at, tag = rest.end(), name[0].lower()
        yield text, tag, closing, rest[1]
        if tag in _END and not closing and tag not in unended:
            end = _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                return
            else:
                unended.add(tag)


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool, bool]]:
    """(text, link density, heading, paragraph, in article, furniture) of the page's text blocks, in page order."""
    out: list[tuple[str, float, bool, bool, bool, bool]] = []
    # open elements: tag, in article, not shown or furniture by tag, furniture by name
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    opened: Counter = Counter()
    texts: list[tuple[str, bool]] = []
    flat, dropped, linked = "", False, False  # the flat element around the text, and whether it is furniture itself

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(t for t, _ in texts)).split())
            if text:
                links = sum(len(t.split()) for t, in_link in texts if in_link)
                words = sum(len(t.split()) for t, _ in texts)
                _, article, hard, named = stack[-1]
                out.append((text, links / max(words, 1), flat in HEADINGS, flat == "p", article, dropped or hard or named))
            texts.clear()

    for text, tag, closing, attributes in markup(page):
        if text:
            texts.append((text, linked))
        if tag == "a":
            linked = not closing
        elif tag == "br":
            texts.append((" ", linked))
        elif tag in BLOCKS:
            flush()
            linked = dropped = False
            if tag in ("html", "body"):
                flat = ""
                continue
            flat = tag if tag in FLAT and not closing else ""
            if closing:
                if opened[tag]:
                    last = ""
                    while last != tag:
                        last = stack.pop()[0]
                        opened[last] -= 1
                continue
            _, article, hard, named = stack[-1]
            names = {w for x in _NAMED(attributes) for w in re.split(r"[^a-z]+", x.lower())} if attributes else set()
            main = tag in ("article", "main") or "main" in names and tag not in FURNITURE_TAGS and not names & FURNITURE_NAMES
            unseen = bool(attributes and _UNSEEN(attributes)) or bool(names & COMMENT_NAMES)
            own = not main and (bool(names & FURNITURE_NAMES) or not article and bool(names & HEADER_NAMES))
            if tag in FLAT:
                dropped = unseen or own
                continue
            hard = hard or unseen or tag in FURNITURE_TAGS or tag == "header" and not article
            stack.append((tag, article or main, hard, own or named and not main))
            opened[tag] += 1
    flush()
    return out


# --- the tree ---------------------------------------------------------------


def features(found: list[tuple[str, float, bool, bool, bool, bool]]) -> np.ndarray:
    """COLUMNS of each block."""
    out = np.zeros((len(found), len(COLUMNS)))
    if found:
        out[:, 0] = [len(b[0].split()) for b in found]
        out[:, 1] = [b[1] for b in found]
        out[1:, 2:4] = out[:-1, :2]
        out[:-1, 4:6] = out[1:, :2]
        out[:, 6:] = [b[2:] for b in found]
        if (out[:, 8] > out[:, 9]).any():  # on a page with an article what stands outside of it
            out[out[:, 8] == 0, 8] = -1
    return out


#: Parts of a labelled page in order: (part, its least and most blocks, words of a block, share of linked words, how often it is there, main text).
LAYOUT = [
    ("menu", (3, 8), (1, 3), (1.0, 1.0), 0.9, False),
    ("notice", (1, 1), (4, 30), (0.0, 0.3), 0.4, False),
    ("site", (1, 2), (1, 12), (0.0, 0.6), 0.4, False),
    ("title", (1, 1), (2, 14), (0.0, 0.0), 0.9, True),
    ("byline", (1, 1), (2, 6), (0.0, 0.6), 0.3, True),
    ("text", (1, 4), (25, 160), (0.0, 0.25), 1.0, True),
    ("short", (1, 2), (2, 14), (0.0, 0.1), 0.7, True),
    ("text", (1, 4), (20, 120), (0.0, 0.25), 0.8, True),
    ("link", (1, 1), (3, 8), (1.0, 1.0), 0.5, True),
    ("text", (1, 2), (20, 90), (0.0, 0.25), 0.5, True),
    ("advert", (1, 1), (5, 40), (0.0, 0.5), 0.4, False),
    ("share", (1, 3), (1, 4), (0.8, 1.0), 0.4, False),
    ("heading", (1, 1), (1, 8), (0.0, 0.0), 0.5, True),
    ("text", (1, 3), (10, 100), (0.0, 0.25), 0.7, True),
    ("comments", (1, 4), (3, 60), (0.0, 0.1), 0.3, False),
    ("links", (2, 7), (2, 9), (0.8, 1.0), 0.6, False),
    ("footer", (1, 2), (2, 14), (0.3, 0.8), 0.8, False),
]


def labelled_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page that follows LAYOUT, and for each of its blocks whether it is main text."""
    semantic, kept, out, article = rng.random() < 0.5, [], [], False
    where = {"menu": "nav", "footer": "footer", "links": "aside", "notice": 'div class="notice"', "advert": 'div class="ad"', "comments": 'section id="comments"', "share": 'div class="share"'}
    for part, count, words, links, share, main in LAYOUT:
        plain = part in ("site", "notice", "advert", "comments", "share", "link") and not semantic  # nothing but a name tells these
        if plain or rng.random() > share:
            continue
        if semantic and (part in ("title", "byline", "text")) and not article:
            out.append("<article>")
            article = True
        if article and part in ("links", "footer"):
            out.append("</article>")
            article = False
        around = where.get(part, "") if semantic else ("div" if part in where else "")
        out.append(f"<{around}>" if around else "")
        for _ in range(rng.integers(*count, endpoint=True)):
            n = int(rng.integers(*words, endpoint=True))
            k = round(rng.uniform(*links) * n)
            tag = {"title": "h1", "heading": "h2", "menu": "li", "links": "li"}.get(part) or ("p" if rng.random() < (0.8 if main else 0.3 if semantic else 0) else "li" if part == "link" else "div")
            out.append(f"<{tag}><a>{'word ' * k}</a>{'word ' * (n - k)}</{tag}>")
            kept.append(main)
        out.append(f"</{around.split()[0]}>" if around else "")
    return "".join(out), kept


def labelled_table(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """COLUMNS and labels of the blocks of some labelled pages."""
    rng = np.random.default_rng(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    return np.concatenate([features(blocks(page)) for page, _ in made]), np.concatenate([kept for _, kept in made])


class Tree:
    """A decision tree grown by Gini impurity, with at least LEAF blocks in a leaf."""

    LEAF = 4

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.answer, self.split = float(y.mean()), None
        if 0 < self.answer < 1:
            best = min((found for k in range(x.shape[1]) if (found := self._best(x[:, k], y, k))), default=None)
            if best:
                _, k, v = best
                low = x[:, k] <= v
                self.split = (k, v, Tree(x[low], y[low]), Tree(x[~low], y[~low]))

    def _best(self, column: np.ndarray, y: np.ndarray, k: int) -> tuple[float, int, float] | None:
        order = np.argsort(column, kind="stable")
        c, t = column[order], np.cumsum(y[order])
        n = np.arange(1, len(c))
        good = (c[1:] > c[:-1]) & (n >= self.LEAF) & (len(c) - n >= self.LEAF)
        if not good.any():
            return None
        a, b, m = t[:-1] / n, (t[-1] - t[:-1]) / (len(c) - n), len(c) - n
        impurity = np.where(good, n * a * (1 - a) + m * b * (1 - b), np.inf)
        i = int(impurity.argmin())
        return float(impurity[i]), k, float(c[i] + c[i + 1]) / 2

    def __call__(self, row: list[float]) -> float:
        node = self
        while node.split:
            k, v, low, high = node.split
            node = low if row[k] <= v else high
        return node.answer


#: Labelled pages that the tree is grown from; they have several hundred blocks.
PAGES = 80
MODEL = Tree(*labelled_table(PAGES, 1))


def main_text(page: str | None) -> str:
    """The blocks that are main text, two line ends between them."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, row in zip(found, features(found).tolist()) if MODEL(row) >= 0.5)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
