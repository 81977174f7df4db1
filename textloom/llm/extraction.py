"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures.

A page is read tag by tag into blocks of text between block-level tags. Each block has its word count, link density, the same
of the blocks before and after it, and what kind of element it is in. A decision tree, grown on the labelled blocks of EXAMPLES,
tells article from the rest. A page is one string in one task; pages are judged one by one, so nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Names from the HTML standard. Elements that end a block, whose text is never shown as text, and that have no end tag.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that are no part of an article wherever they are, and those that hold one.
APART = frozenset("nav aside footer form menu button select option label dialog head search fieldset".split())
HOME = frozenset("article main".split())
#: Words in class, id and role values that name what is not the article, and those that name the article.
AWAY = frozenset("ad ads advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar sitemap skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking warning widget alert alertdialog contentinfo complementary search".split())
TOWARDS = frozenset("article articlebody body content entry main post postbody prose story storybody text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/<>]*+)((?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|[!?/][^<>]*+>)""", re.S)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words of AWAY that name a heading's box inside an article.
_OVER = frozenset(("header", "banner"))
_CELLS = frozenset("li td th dt dd".split())
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What the tree sees of a block.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "home", "apart", "away", "towards", "heading", "item", "page_home", "stops")


def blocks(page: str) -> list[tuple[str, int, int, tuple]]:
    """(text, words, words in links, kind) of each block with text, in page order. White space in a block is one space.

    kind: in an article or main element; in an element apart; names away and towards; heading; list item or table cell.
    Unclosed elements end where an enclosing one does; what is never closed, comments too, runs to the end of the page.
    """
    out, parts, stack, nothing = [], [], [], (False,) * 6
    at, linked = 0, 0
    open_now: Counter = Counter()

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            out.append((text, n, min(linked, n), stack[-1][1] if stack else nothing))
        linked = 0

    def add(raw):
        nonlocal linked
        if raw and not open_now["hidden"]:
            text = entities.unescape(raw)
            parts.append(text)
            if open_now["a"]:
                linked += len(text.split())

    def close(to):
        """Close elements down to the place ``to`` of the stack."""
        while len(stack) > to:
            name = stack[-1][0]
            if name in BLOCK:
                flush()
            stack.pop()
            open_now[name] -= 1
            open_now["hidden"] -= name in HIDDEN

    def innermost(names, until):
        """Place of the innermost open element of ``names``, unless one of ``until`` is around nearer; -1 if none."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in until:
                break
        return -1

    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if name in BLOCK:
                flush()
            to = innermost((name,), ("article", "main", "body") if name in BLOCK else BLOCK) if open_now[name] else -1
            if name in ("article", "main", "body", "html") and open_now[name]:
                to = innermost((name,), ())
            if to >= 0:
                close(to)
            continue
        attributes = m[4] if m[3] else m[7]
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            upto = page.find(">", end.start()) if end else -1
            at = upto + 1 if upto >= 0 else len(page)
            continue
        if stack and stack[-1][0] == "head" and name not in _IN_HEAD:
            close(len(stack) - 1)
        if name in BLOCK:
            flush()
            to = innermost({"p"} | _CLOSED_BY.get(name, set()), BLOCK)
            if to >= 0:
                close(to)
        elif name == "br":
            parts.append(" ")
        elif name == "a" and open_now["a"] and (to := innermost(("a",), BLOCK)) >= 0:
            close(to)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        home, apart, away, towards, heading, cell = stack[-1][1] if stack else nothing
        named = set(_WORD.findall(" ".join("".join(v) for v in _NAMES.findall(attributes)).lower())) if attributes and name not in ("html", "body") else set()
        if home or towards or not TOWARDS.isdisjoint(named):
            named -= _OVER
        hint = not AWAY.isdisjoint(named) or bool(attributes and _HIDDEN.search(attributes))
        closer = not hint and not TOWARDS.isdisjoint(named)
        apart = apart or name in APART or name == "header" and not home
        stack.append((name, (home or name in HOME, apart, away or hint, towards or closer, heading or name in HEADINGS, cell or name in _CELLS)))
        open_now[name] += 1
        open_now["hidden"] += name in HIDDEN
    add(page[at:])
    close(0)
    flush()
    return out


def figures(found: list[tuple[str, int, int, tuple]]) -> np.ndarray:
    """One row of FEATURES for each block of a page; before the first and after the last block there are no words."""
    n = len(found)
    words = np.array([0, *(w for _, w, _, _ in found), 0], float)
    links = np.array([0, *(a / w for _, w, a, _ in found), 0], float)
    kind = np.array([k for *_, k in found], float).reshape(n, 6)
    home, apart, away, towards, heading, cell = kind.T
    any_home = np.full(n, float((home * (1 - apart) * (1 - away)).any()))
    stops = np.array([t.rstrip("\"'”’»)").endswith((".", "!", "?", "…", "。")) for t, *_ in found], float)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], home, apart, away, towards, heading, cell, any_home, stops])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple:
    """A decision tree: (feature, threshold, tree where at most it, tree where more), or at a leaf the share of y.

    Each split is the one of least Gini impurity; ties go to the first feature, then the smallest threshold, which lies
    halfway between two values.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        by = np.argsort(x[:, f], kind="stable")
        v, t = x[by, f], np.cumsum(y[by])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        left = cut + 1.0
        right = len(y) - left
        a, b = t[cut], t[-1] - t[cut]
        loss = a * (left - a) / left + b * (right - b) / right
        k = int(np.argmin(loss))
        if best is None or loss[k] < best[0] - 1e-12:
            best = (float(loss[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best is None:
        return (share,)
    _, f, at = best
    low = x[:, f] <= at
    return (f, at, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def shares(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf's share for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, at, low, high = tree
    out, left = np.empty(len(x)), x[:, f] <= at
    out[left], out[~left] = shares(low, x[left]), shares(high, x[~left])
    return out


#: The labelled table: a block a line, a page a paragraph. Elements around the block from the outermost in, with a class after
#: a point; words and words in links, with a point if a sentence ends there; + article, - other.
EXAMPLES = """
nav>ul>li 1/1 -
nav>ul>li 1/1 -
div.ad 8/0. -
article>h1 10/0 +
article>p 60/0. +
article>p 1/0. +
article>p 35/2. +
article>p 2/0. +
footer 9/0. -

header>div 3/3 -
nav 6/6 -
article>header>h1 7/0 +
article>header>p 4/0 +
article>div>p 80/4. +
article>div>h2 4/0 +
article>div>p 25/0. +
article>div>ul>li 6/0 +
article>div>ul>li 9/1. +
article>div>blockquote 20/0. +
article>div.sharing>ul>li 1/1 -
article>section.comments>h3 2/0 -
article>section.comments>p 40/0. -
article>section.comments>p 5/0. -
aside>p 45/0. -
aside>h3 3/0 -
footer>p 20/6. -

div.cookie>p 30/1. -
div.cookie>button 1/0 -
header>p 5/0 -
main>h1 6/0 +
main>p 3/0. +
main>p 110/9. +
main>form>label 2/0 -
main>form>p 12/0. -
main>table>tr>td 4/0 +
main>table>tr>td 2/0 +
main>p 15/0. +
main>aside>p 22/0. -
main>div.related>ul>li 7/7 -
main>div.related>ul>li 6/6 -
footer>ul>li 2/2 -

div.menu>ul>li 1/1 -
div.menu>ul>li 2/2 -
div.content>h1 8/0 +
div.content>p 55/3. +
div.content>p 4/0. +
div.content>h2 3/0 +
div.content>p 70/0. +
div.content>div.advert 18/0. -
div.content>p 12/0. +
div.sidebar>h3 2/0 -
div.sidebar>p 33/2. -
div.comments>div 28/0. -
div.comments>div 3/0. -
div 7/0. -

ul>li 1/1 -
ul>li 2/2 -
ul>li 1/1 -
h1 8/0 +
p 40/0. +
p 65/5. +
p 6/0. +
p 30/0. +
h2 4/0 +
p 52/0. +
div>a 2/2 -
div>a 3/3 -
div 6/0 -

div>div 3/3 -
div>div 12/11 -
div>div 5/0 -
div>div>p 45/1. +
div>div>p 9/0. +
div>div>p 75/0. +
div>div>ul>li 11/0. +
div>div>ul>li 8/0. +
div>div>p 38/2. +
div>p 9/2. -
div>ul>li 3/3 -

table>tr>td 2/2 -
table>tr>td 2/2 -
table>tr>td>p 50/0. +
table>tr>td>p 22/1. +
table>tr>td 3/0 -

article.comment>p 30/0. -
article.comment>p 6/0. -
div.notice>p 25/0. -
div.banner>p 10/2. -
main>article>p 44/0. +
main>article>p 2/0. +
main>article>p 1/0 +
main>article>pre 18/0 +
main>article>div.newsletter>p 16/0. -
main>article>div 14/0. +
main>article>footer>p 10/1. -
main>nav>a 1/1 -
main>section.comments>ol>li 25/0. -
div.modal>p 60/0. -

body>p 90/0. +

body>div 30/0. +
body>div 28/0. +

nav>a 1/1 -
article>h1 1/0 +
article>p 1/0. +
div 40/0. -
p 12/0. -
footer 5/0. -

nav>a 4/4 -
div.ad 60/0. -
article>h1 3/0 +
article>p 20/20. +
article>p 7/7 +
article>ul>li 3/3 -
article>ul>li 5/5 -
article>p 400/0. +
footer 30/0. -

article>h1 4/0 +
article>p 30/0. +
article>p 10/3. +
article>p 3/1. +
article>p 3/0. +

main>p 12/0. +
main>p 25/9. +
main>p 6/4. +
main>ul>li 4/4 -
main>ul>li 3/3 -
main>div 5/0 +

article>p 2/0 +

article>h1 9/0 +
article>p 15/5. +
article>p 40/0. +
article>ul>li 12/5. +
article>ul>li 10/3. +
article>p 1/0. +
div 11/0. -

nav>a 1/1 -
h1 6/0 +
p 30/9. +
p 18/5. +
p 7/2. +
p 44/12. +
p 26/0. +
footer>p 12/0. -

div>a 2/2 -
h1 5/0 +
p 18/0. +
p 1/0. +
p 25/0. +
p 16/0. +
p 2/0. +
p 14/1. +
div 2/0 -

div 4/4 -
h1 3/0 +
p 12/0. +
p 3/0. +
p 9/0. +
h2 2/0 +
p 17/4. +
div 5/0 -

ul>li 1/1 -
ul>li 1/1 -
h1 4/0 +
p 2/0. +
p 13/0. +
p 1/0. +
ul>li 2/2 -
div 3/0 -

div 2/2 -
div 25/20 -
h1 5/0 +
div 120/3. +
div 10/0 +
div 95/6. +
div 4/4 -
div 14/14 -
"""

#: Rows made by a rule: what these elements hold is other, and what an article's paragraphs hold is article, whatever its size.
_OTHERS = ("nav>ul>li", "aside>p", "footer>p", "form>p", "div.ad", "article>div.comments>p")
_OWN = ("article>p", "main>p", "article>h2")
_SIZES = ("1/0", "1/0.", "4/0.", "12/0", "25/3.", "60/0.", "200/9.")
_LINKED = ("1/1.", "4/4.", "12/12.", "40/40.")


def _made() -> list[str]:
    """Pages of the rule: the article's blocks between those of one kind that is other."""
    pages = []
    for other in _OTHERS:
        around = [f"{other} {size} -" for size in (*_SIZES, *_LINKED)]
        pages.append("\n".join([*around, *(f"{own} {size} +" for own in _OWN for size in _SIZES), *around]))
    return pages


def _example(line: str) -> tuple[str, int]:
    path, size, label = line.split()
    words, linked = map(int, size.rstrip(".").split("/"))
    elements = [e.partition(".") for e in path.split(">")]
    text = " ".join(["w"] * (words - linked)) + (f" <a>{' '.join(['w'] * linked)}</a>" if linked else "") + ("." if size.endswith(".") else "")
    around = "".join(f'<{n} class="{c}">' if c else f"<{n}>" for n, _, c in elements)
    return around + text + "".join(f"</{n}>" for n, _, _ in reversed(elements)), int(label == "+")


@cache
def trained() -> tuple:
    """The tree grown on EXAMPLES and the rule's rows, read by the same functions as pages."""
    xs, ys = [], []
    for page in [*EXAMPLES.strip().split("\n\n"), *_made()]:
        lines = [_example(line) for line in page.splitlines()]
        xs.append(figures(blocks("".join(h for h, _ in lines))))
        ys += [y for _, y in lines]
    return grow(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None, tree: tuple) -> str:
    """The blocks of a page that the tree takes for the article, in page order, joined by line feeds; empty if none."""
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n".join(t for (t, *_), share in zip(found, shares(tree, figures(found)).tolist()) if share >= 0.5)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with ``text``, the main text of the whole html (instead of a column of that name), and ``n_chars``, its code points."""
    tree = trained()
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    rows = pages.select(*kept, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches):
        for batch in batches:
            made = [main_text(h, tree) for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string())], [*kept, "text"])

    return rows.mapInArrow(run, schema + ", text string").withColumn("n_chars", F.length("text").cast("long"))


def op13_html_blocks(spark, sf_dir):
    """page_id, url, text, n_chars of every page.

    Null, empty and blockless pages have an empty text. Rows are judged one by one: repeated rows give repeated results, and
    nothing ties. An empty table gives no rows. Extra columns are not read.
    """
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
