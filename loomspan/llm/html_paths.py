"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. A page's nodes are grouped by
path: length of text and punctuation per block, and share of link text. These ratios are
smoothed along the page, fused with what the tags themselves say (an article, an
advert), and paths above a threshold are the content. Headings, lists, tables and
quotations stand or fall with the container that they are in, by the mean ratio of all
paths in it: a short heading or list item is content where the paragraphs around it are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, table

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTE = re.compile("[>\"']")
#: elements whose text is not markup, and is no content
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in "script style noscript template textarea iframe svg math title select object canvas".split()}
#: elements open at once; what is nested deeper stands beside its parent, as in browsers
DEEPEST = 512
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")
SPACES = re.compile(r"[ \t\n\r\f\v]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: tags that neither begin a block nor say anything of the content around them
INLINE = frozenset("b i em strong u s small big sub sup font span mark abbr cite code kbd samp var q tt bdi bdo ins del dfn time data label a".split())
BLOCKED = frozenset("head nav footer aside form button menu dialog fieldset".split())
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets footer header masthead toolbar share sharing social related recommended "
    "comment comments discussion discuss disqus feedback guestbook reply replies respond responses login signup search pagination pager complementary contentinfo skip".split()
)
#: words that begin a sign, as in commentlist
STEMS = ("comment", "advert", "sponsor", "breadcrumb", "newsletter", "cookie", "sidebar", "navbar")
#: words that may stand beside a sign in one class name; a name with other words (related-work, header-image) is no sign
FRAME = frozenset(
    "area bar bars block blocks body bottom box boxes button buttons card cards col column container content feed form fixed google global group inner items item left link links list "
    "lists main more module outer overlay page panel policy post posts article articles stories news reader readers region right row section site slot small strip sub sticky text thread "
    "title top unit user users wrap wrapper primary secondary tertiary js c u l is has".split()
)
#: signs that don't count inside an article, where they frame its title
TITLES = frozenset("header masthead".split())
CONTAINER = frozenset("article main".split())
#: tags that are decided with the element around them
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd table caption thead tbody tfoot tr th td blockquote pre figure figcaption address details summary".split())
#: attributes of elements that are not shown
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: an open tag that a new one ends
ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "option": {"option"}}
PARAGRAPH = frozenset(["p"])
#: of the page's mean score that a container must reach
SHARE = 0.5
SCOPES = frozenset("ul ol dl table div article section main body blockquote".split())


def is_sign(name: str, inside: bool) -> bool:
    """Whether a class name, id or role says that an element is no content."""
    words = WORD.findall(name)
    signs = [w for w in words if (w in SIGNS and not (inside and w in TITLES)) or w.startswith(STEMS)]
    return bool(signs) and all(w in signs or w in FRAME or w in TITLES or not w.isalpha() for w in words)


class Node:
    """An open element: its path and that of its container, whether it hides text, has a sign against it, holds an article."""

    __slots__ = ("tag", "path", "home", "hidden", "signed", "inside")

    def __init__(self, tag: str, attributes: str, above: Node | None, paths: dict[tuple[int, str], int]):
        self.tag, names, roles = tag, [], ""
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                names += value.split()
                roles += f" {value}" if name.lower() in ("role", "itemprop") else ""
        up_inside, up_hidden, up_signed = (above.inside, above.hidden, above.signed) if above else (False, False, False)
        own = tag in CONTAINER or " main" in roles or "articlebody" in roles
        signed = any(is_sign(x, up_inside) for x in names)
        self.signed = up_signed or signed and tag not in ("html", "body") and not own
        # the header of an article has its title; that of a page is not content
        self.hidden = up_hidden or tag in BLOCKED or tag == "header" and not up_inside or bool(attributes and UNSEEN.search(attributes))
        self.inside = (up_inside or own) and not self.hidden and not self.signed
        # paths are numbered, as they can be as long as a page
        self.path = above.path if above and tag in INLINE else paths.setdefault((above.path if above else 0, tag), len(paths) + 1)
        self.home = above.home if above and (tag in INLINE or tag in LEAF) else self.path


def tokens(page: str):
    """(begin, end, closes, tag, attributes) of each tag of ``page`` in order. Comments, declarations and elements with
    raw text are tokens with an empty tag, CDATA one with the tag ``[``. Every character is looked at a few times at most:
    once a search has reached the end of the page in vain, it isn't tried again."""
    at, quoted = 0, True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            yield lt, at, False, "", ""
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = len(page) if end < 0 else end + 3
            yield lt, at, False, "[", page[lt + 9 : at].removesuffix("]]>")
            continue
        m = TAG.match(page, lt)
        if not m and not page.startswith(("<!", "<?"), lt):
            at = lt + 1
            continue
        first = page.find(">", lt)
        if first < 0:  # no tag ends from here on
            if page.startswith("</", lt):
                yield lt, len(page), True, "", ""
            return
        if not m:
            at = first + 1
            yield lt, at, False, "", ""
            continue
        end, i = first, m.end()
        while quoted:
            q = QUOTE.search(page, i)
            if q and q[0] == ">":
                end = q.start()
                break
            close = page.find(q[0], q.end()) if q else -1
            if close < 0:
                quoted = False  # quotes of this page can't be trusted from here on: tags end at their first ">"
            i = close + 1
        tag, closes, attributes = m[1].lower(), page[lt + 1] == "/", page[m.end() : end]
        at = end + 1
        if tag in RAW and not closes:
            if not (tag in ("svg", "math") and attributes.endswith("/")):
                over = RAW[tag].search(page, at)
                at = over.end() if over else len(page)
            yield lt, at, False, "", ""
        else:
            yield lt, at, closes, tag, attributes


def text_nodes(page: str):
    """(path, block number, text, under a link) for each shown text node, in page order. A path is the number of
    its block-level tags from the root, whether they are inside an article, whether there is a sign against them, and the
    number of its container's path."""
    paths: dict[tuple[int, str], int] = {}
    stack = [Node("html", "", None, paths)]
    open_ = Counter()
    block, at, link = 0, 0, 0

    def spoken(text: str):
        top = stack[-1]
        return ((top.path, top.inside, top.signed, top.home), block, html.unescape(text), link > 0) if text and not top.hidden else None

    def close(depth: int):
        nonlocal link
        for node in stack[depth:]:
            open_[node.tag] -= 1
            link -= node.tag == "a"
        del stack[depth:]

    for begin, end, closes, tag, attributes in tokens(page):
        if found := spoken(page[at:begin]):
            yield found
        at = end
        if tag == "[":
            if found := spoken(attributes.replace("&", "&amp;")):
                yield found
            continue
        if not tag:
            continue
        if tag == "br":
            if found := spoken(" "):
                yield found
            continue
        inline = tag in INLINE
        if not inline:
            block += 1
        if closes:
            if open_[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                    if inline and stack[depth].tag not in INLINE:
                        break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        if not inline:
            ends = ENDS.get(tag, PARAGRAPH)
            if any(open_[x] for x in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ends:
                        close(depth)
                    elif stack[depth].tag in SCOPES:
                        break
        if len(stack) >= DEEPEST:
            close(len(stack) - 1)
        stack.append(Node(tag, attributes, stack[-1], paths))
        open_[tag] += 1
        link += tag == "a"
    if found := spoken(page[at:]):
        yield found


def path_scores(nodes: list) -> tuple[dict[tuple, float], dict[tuple, float], dict[tuple, float]]:
    """Of each path its score, its length and the share of it under links. A path's ratios are its text length and its
    punctuation per block; they are smoothed over the neighbouring blocks, and fused as their geometric mean."""
    length, linked, marks = defaultdict(float), defaultdict(float), defaultdict(float)
    blocks: dict[tuple, None] = {}
    for path, block, text, link in nodes:
        size = len(text.strip())
        if size:
            blocks[block, path] = None
            length[path] += size
            marks[path] += len(PUNCTUATION.findall(text))
            linked[path] += size * link
    rows = [path for _, path in blocks]
    count = Counter(rows)
    ratio = [(length[p] / count[p], marks[p] / count[p]) for p in rows]
    kernel = [math.exp(-d * d / 2) for d in range(-2, 3)]
    smooth = defaultdict(float)
    for i, path in enumerate(rows):
        near = [(kernel[j - i + 2], ratio[j]) for j in range(max(0, i - 2), min(len(rows), i + 3))]
        total = sum(k for k, _ in near)
        a, b = (sum(k * r[x] for k, r in near) / total for x in (0, 1))
        own = ratio[i]
        smooth[path] += math.sqrt((a + own[0]) * (b + own[1] + 0.1)) / 2
    return {p: smooth[p] / count[p] for p in smooth}, length, {p: linked[p] / length[p] for p in smooth}


def content_paths(nodes: list, share: float = SHARE, inside: float = 4.0, outside: float = 0.375, signed: float = 0.125, most_linked: float = 0.75, least: float = 0.02) -> set[tuple]:
    """The paths that carry content: those of containers whose mean score, by length and less the share of link text, times the
    weights of what the tags say (``inside`` an article, ``outside`` of one that has ``least`` of the text without a sign, ``signed``
    by a class or role) reaches ``share`` of the mean over the page's paths without a sign. Paths of links (over ``most_linked`` of the
    text), menus and lists of further reading, are no part of their container and count by themselves."""
    score, length, linked = path_scores(nodes)
    if not score:
        return set()
    menus = {p for p in score if linked[p] > most_linked}
    value = {p: score[p] * (1 - linked[p]) for p in score}
    plain = [p for p in score if not p[2]] or list(score)
    article = sum(length[p] for p in score if p[1]) >= least * sum(length[p] for p in plain)  # a card is no article
    weight = {p: (inside if p[1] else outside if article else 1.0) * (signed if p[2] else 1.0) for p in score}
    bar = share * sum(value[p] * length[p] for p in plain) / sum(length[p] for p in plain)
    totals: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for p in score:
        part = totals[p if p in menus else p[1:]]
        part[0] += value[p] * length[p]
        part[1] += length[p]
    mean = {k: a / b for k, (a, b) in totals.items()}
    return {p for p in score if (v := mean[p if p in menus else p[1:]]) > 0 and v * weight[p] >= bar}


def main_text(page: str) -> str:
    nodes = list(text_nodes(page))
    kept = content_paths(nodes)
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in nodes:
        if path in kept:
            blocks.setdefault(block, []).append(text)
    lines = (SPACES.sub(" ", "".join(x)).strip(" ") for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches):
    for batch in batches:
        for part, data, off in pieces(batch, 1):
            raw = data.tobytes()
            texts = [main_text(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: its id, URL, main text and n_chars.

    Blocks are what stands between block-level tags; white space in them is one space
    (a line break tag too), character references are decoded, blocks are joined by one
    line break. Null and empty pages, and those without content, have an empty text.
    Unclosed and misnested tags are read as browsers do, roughly. Other columns are
    ignored; repeated rows give equal texts; an empty table gives none.
    """
    kind = dict(pages.dtypes)[id_col]
    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("body"), F.col(url_col).alias("url")).mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op10_html_extraction(spark, sf_dir):
    """The main text of every row of ``pages``. Null and empty pages have an empty text; repeated rows get equal rows."""
    return extract(table(spark, sf_dir, "pages"))
