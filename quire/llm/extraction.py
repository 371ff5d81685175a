"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import pick, table

#: A path is content if its fused score is at least this share of the page's highest.
SHARE = 0.12
#: Part of an ancestor's score that a path inherits for each step down.
INHERIT = 0.8
#: The part for a step out of one of these, which may be a branch of its own amid an article; headings inherit as ever.
CROSS = 0.05
BRANCHES = frozenset("div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weight of the paths inside elements that a name, role or class marks as anything but the article's text, and the step that sets them apart from others.
MARKED = 0.02
APART = "~"
#: Weight of the paths inside article marks, if most of the text over the threshold is outside of them, or of those outside, if most is inside.
OTHER_SIDE = 0.3
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|$)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", re.I)
PIECE = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a new one of the same list closes, up to the nearest of the others.
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "td", "th", "li", "body", "aside", "footer", "header", "nav", "form", "blockquote", "main", "dd", "button"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An element that a class or id marks isn't set apart, all the same, if this share of the page's text is in it: where the name says nothing else, and where it has other words too.
MOST = {"word": 0.75, "weak": 0.25}
#: Elements, roles and words of a class or id that mark what isn't an article's text.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select option fieldset head object svg canvas audio video map datalist input label legend".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars rail footer foot masthead topbar comment comments commentlist respond replies disqus cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations pagination pager search searchbox toolbar widget widgets copyright legal disclaimer skip tags".split())
OTHER_ARTICLES = frozenset("ad ads advert sponsored promo comment comments reply related teaser".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Words of readers' comments, which are never the article; words that turn the next one round; words that say nothing.
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus".split())
TURNING = frozenset("no non not has have with without hide hidden".split())
GENERIC = frozenset("site page main block box section list item items wrap wrapper container bar area text content contents body top bottom left right global primary secondary inner outer col column row module panel group header head title link links icon button buttons js id region the and of for".split())
STOPS = re.compile(r"[.,;:!?…。、，！？；：]")


def boilerplate(tag: str, attributes: str, inside: bool) -> str:
    """What marks an element as anything but the article: "kind" (its name or role, or it is hidden), "comment" or "word" (its class or id says that), "weak" (a word of those among others) or nothing. ``inside``: it is within one."""
    if tag in BOILER_TAGS or tag == "header" and not inside:
        return "kind"
    if not attributes:
        return ""
    mark = ""
    for name, a, b, c in NAMES.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "kind"
        if name not in ("class", "id") or tag in ("html", "body", "main"):
            continue
        telling = OTHER_ARTICLES if tag == "article" else BOILER_WORDS
        for token in value.split():
            words = PIECE.findall(token)
            hits = [w for before, w in zip(["", *words], words) if (w in telling or not inside and w in ("header", "head")) and before not in TURNING]
            if hits and all(w in telling or w in GENERIC for w in words):
                mark = "comment" if not COMMENT_WORDS.isdisjoint(hits) else mark if mark == "comment" else "word"
            elif hits:
                mark = mark or "weak"
    return mark


def nodes(page: str) -> list[tuple[tuple[str, ...], int, str]]:
    """(tag path, block, text) of every text node but scripts, styles and the like, in page order.

    A path's steps are elements with their classes; inline elements but links are no part of it. Paths inside elements that are marked as anything but the article begin with ``APART``. A block is a run of text between the borders of block elements
    or line breaks. Elements that were not closed end where HTML's rules end them, or with their parent.

    An element that only a word of its class or id marks isn't set apart if it holds most of the page's text (a quarter, if the name has other words too), or the article or main
    element with the most text, if that isn't little beside what stays in any case. Comments always are.
    """
    found: list[tuple[tuple[str, ...], int, str, tuple[int, ...] | None]] = []
    stack: list[str] = []
    steps: list[str] = []  # of the same elements, with their classes
    path: tuple[str, ...] = ()
    skip_from = 0  # depth at which boilerplate began
    block, at, size = 0, 0, len(page)
    articles = 0
    worded: list[tuple[int, int]] = []  # depth and number of the open elements that a word marks
    open_articles: list[tuple[int, int]] = []
    within: tuple[int, ...] = ()  # numbers of the open ones
    sizes: list[int] = []  # text in each marked element
    kinds: list[str] = []
    article_sizes: list[list] = []  # text in each article or main element, and the marked ones around it
    total = 0

    def text(raw: str) -> None:
        nonlocal total
        if raw and skip_from:
            found.append((path, block, html.unescape(raw), None))
        elif raw:
            raw = html.unescape(raw)
            found.append((path, block, raw, within))
            n = len(" ".join(raw.split()))
            total += n
            for i in within:
                sizes[i] += n
            for _, i in open_articles:
                article_sizes[i][0] += n

    def pop_to(depth: int) -> None:
        nonlocal path, skip_from, articles, block, within
        for tag in stack[depth:]:
            articles -= tag in ARTICLE_TAGS
            if tag not in INLINE:
                block += 1
        del stack[depth:], steps[depth:]
        if skip_from > depth:
            skip_from = 0
        while open_articles and open_articles[-1][0] > depth:
            open_articles.pop()
        if worded and worded[-1][0] > depth:
            while worded and worded[-1][0] > depth:
                worded.pop()
            within = tuple(i for _, i in worded)
        path = tuple(p for t, p in zip(stack, steps) if t not in INLINE or t == "a")

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(html.escape(m[1]))
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if tag == "br":
                block += 1
            elif tag in stack:
                depth = len(stack) - 1 - stack[::-1].index(tag)
                if tag not in INLINE or not any(t not in INLINE for t in stack[depth:]):
                    pop_to(depth)
            elif tag == "p":
                block += 1
            continue
        if tag in ENDS_P and tag != "p" and "p" in stack:
            depth = len(stack) - 1 - stack[::-1].index("p")
            if not any(t in CLOSES["p"][1] for t in stack[depth:]):
                pop_to(depth)
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in own:
                    pop_to(depth)
                    if tag not in ("tr",):
                        break
                elif stack[depth] in stop:
                    break
        if tag in VOID:
            if tag not in INLINE:
                block += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in INLINE:
                block += 1
            continue
        if (m[4] or "").rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(tag)
        kind = CLASS.search(m[4]) if m[4] and tag not in INLINE and tag not in ARTICLE_TAGS else None
        steps.append(f"{tag}.{kind[1]}" if kind else tag)
        articles += tag in ARTICLE_TAGS
        if tag not in INLINE:
            block += 1
        mark = "" if skip_from else boilerplate(tag, m[4] or "", articles > 0)
        if mark == "kind":
            skip_from = len(stack)
        elif mark:
            worded.append((len(stack), len(sizes)))
            within += (len(sizes),)
            sizes.append(0)
            kinds.append(mark)
        elif tag in ARTICLE_TAGS and not skip_from:
            open_articles.append((len(stack), len(article_sizes)))
            article_sizes.append([0, within])
        path = tuple(p for t, p in zip(stack, steps) if t not in INLINE or t == "a")
    stay = {i for i, (n, kind) in enumerate(zip(sizes, kinds)) if kind in MOST and n >= MOST[kind] * total}
    most, around = max(article_sizes, key=lambda a: a[0], default=(0, ()))
    if around and all(kinds[i] in MOST for i in around) and 2 * most >= sum(len(" ".join(raw.split())) for _, _, raw, marks in found if marks is not None and stay.issuperset(marks)):
        stay.update(around)
    own = lambda marks: marks is not None and stay.issuperset(marks)
    return [(path if own(marks) else (APART, *path), block, raw) for path, block, raw, marks in found]


def scores(found: list[tuple[tuple[str, ...], int, str]]) -> dict[tuple[str, ...], float]:
    """The fused score of each path: its text and its punctuation per block, both smoothed down the tree of paths.

    A path's ratio is what its nodes hold on the average. Its smoothed ratio is the larger of its own and
    a part of its parent path's, for which a parent's ratio is what all nodes below it hold per child path; so short nodes
    amid long ones (a heading in an article) keep up, and those of a short branch (a footer, a box of links) don't. The
    two smoothed ratios are fused by their geometric mean.
    """
    length: dict[tuple[str, ...], list[float]] = {}
    seen: set[tuple[tuple[str, ...], int]] = set()
    for path, block, text in found:
        words = len(" ".join(text.split()))
        if words:
            own = length.setdefault(path, [0.0, 0.0, 0.0])
            own[0] += words
            own[1] += len(STOPS.findall(text))
            own[2] += (path, block) not in seen
            seen.add((path, block))
    below: dict[tuple[str, ...], list[float]] = {}
    for path, (chars, stops, n) in length.items():
        for depth in range(len(path) + 1):
            own = below.setdefault(path[:depth], [0.0, 0.0, 0.0])
            own[0] += chars
            own[1] += stops
            own[2] += n
    fused: dict[tuple[str, ...], float] = {}
    for path, (chars, stops, n) in length.items():
        linked = 0.2 if "a" in path else 1.0
        text, point, part = chars / n, (stops + 0.1) / n, 1.0
        for up in range(1, len(path)):
            above = below[path[: len(path) - up]]
            if len(path) - up <= 1 or path[len(path) - up - 1].partition(".")[0] in ("html", "body"):
                break
            part *= CROSS if path[len(path) - up].partition(".")[0] in BRANCHES and path[-1].partition(".")[0] not in HEADINGS else INHERIT
            text = max(text, part * above[0] / above[2])
            point = max(point, part * (above[1] + 0.1) / above[2])
        fused[path] = linked * math.sqrt(text * point) * (MARKED if path[:1] == (APART,) else 1.0)
    return fused


def threshold(score: dict[tuple[str, ...], float]) -> float:
    """The least score of content: a share of the highest that isn't set apart; where all is, of the highest before it was weighed."""
    plain = [own for path, own in score.items() if path[:1] != (APART,)]
    return SHARE * (max(plain) if plain else max(score.values(), default=0.0) / MARKED)


def main_text(page: str | None) -> str:
    """The main text of a page; see ``extract``."""
    found = nodes(page or "")
    score = scores(found)
    least = threshold(score)
    marked = {path: not ARTICLE_TAGS.isdisjoint(path) for path in score}
    inside = outside = 0
    for path, _, text in found:
        if score.get(path, 0.0) >= least > 0:
            size = len(" ".join(text.split()))
            inside, outside = inside + size * marked[path], outside + size * (not marked[path])
    score = {path: own if marked[path] == (inside >= outside) else OTHER_SIDE * own for path, own in score.items()}
    least = threshold(score)
    best: dict[int, float] = {}  # a block stays whole, so a link amid text stays with it; what is set apart in it doesn't
    for path, block, _ in found:
        if path[:1] != (APART,):
            best[block] = max(best.get(block, 0.0), score.get(path, 0.0))
    parts: list[str] = []
    last = None
    for path, block, text in found:
        if (score.get(path, 0.0) if path[:1] == (APART,) else best[block]) >= least > 0:
            parts += ([" "] if block != last else []) + [text]
            last = block
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's text, each run of white space one space.

    Text length and punctuation are aggregated per root-to-leaf tag path, smoothed down the tree of paths, fused and
    held against a share of the page's highest. Names, roles and classes weigh paths and decide nothing alone: those inside menus, forms,
    adverts, comments and so on count for a fiftieth, and the paths on the side of the article marks that has less of the text for a third.

    Null or empty html, or none with text: an empty text. Broken markup and very long pages are read to their end. Null or
    repeated ids: each row is returned. Empty table: no rows. Other columns don't matter.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
