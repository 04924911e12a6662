"""Main text of web pages, by scoring the containers of their trees.

Each page is read on its own, so nothing is shuffled; a task holds one page's tree at a time.

1. Tags become a tree as browsers build it: blocks close open paragraphs, list items and cells
   close their like, end tags without a start are ignored, and nothing nests deeper than ``DEPTH``.
   Between borders of blocks, text is a block; ``br`` is white space, several in a row are a border.
2. What is not the article goes, with all it holds: by element (``DROPPED``, ``ASIDE``), by role, by
   the words of class and id (``CHROME``; ``REPLIES`` for reader comments), if hidden, and lists that
   are nothing but short links. Words of a class don't count against what holds an article or
   most of the text, nor does a header inside an article.
3. Each block passes points, for its length and commas, to the container it stands in, half to the
   next and less to those further up. Articles and classes that speak of content get more. A
   container's score is discounted by the share of its characters that are links.
4. The best container stands for its outermost article, or for ``main``. Without either, siblings
   are kept that score at least a fifth as much, headings, and paragraphs that read like prose.

Blocks that are kept are whole, in page order: references decoded, white space of any kind turned
into one space, trimmed; empty ones are left out.

Defined cases: null html is the empty page; a page without text has the empty text; plain text
without tags is one block; a tag or comment that never ends takes the rest of the page; null ids and
urls are kept; rows that repeat are each returned; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: How deep elements nest; browsers have such a bound too.
DEPTH = 512
#: Shares: of the text that a class may speak against, of links in a menu, of the best score that siblings need.
MOST, MENU, SIBLING = 0.5, 0.9, 0.2
#: How many containers upward get points.
LEVELS = 6

# Names of HTML, and the words that sites use for what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADING | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center dd details div dl fieldset figure form html li main ol section table tbody td th tr ul".split())
LIST = frozenset("ul ol dl menu dir".split())
#: End tags and implied ends don't reach out of these.
SCOPE = frozenset("html table td th caption template button object".split())
TABLE_PART = frozenset("table tbody td tfoot th thead tr caption".split())
#: What a start tag closes, and the elements that keep it from looking further.
CLOSES = {
    "li": (frozenset(["li"]), LIST | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"]) | SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table", "html"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table", "html"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "html"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table", "html"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table", "html"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table", "html"])),
}
DROPPED = RAW | frozenset("head nav noscript template svg math canvas object select button label dialog menu search audio video".split())
ASIDE = frozenset("aside footer form header".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
REPLIES = frozenset("comment comments commentlist disqus replies reply respond".split())
CHROME = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "paywall popup promo promotion promotions recommended related share sharebar sharing sidebar sidebars signup skip social "
    "sponsor sponsored submenu subscribe subscription toolbar topbar trending widget widgets".split()
)
CONTENT = frozenset("article blog body content entry hentry main post story text".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|([^\s"'>/=]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, start and end."""
    at, size = 0, len(page)
    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            yield "text", page[at:], ""
            return
        if sign > at:
            yield "text", page[at:sign], ""
        after = page[sign + 1 : sign + 2]
        if after.isascii() and after.isalpha() or after == "/" and page[sign + 2 : sign + 3].isalpha():
            found = TAG.match(page, sign)
            if not found:
                if not page[sign + 2 : sign + 3].isascii():
                    yield "text", "<", ""
                    at = sign + 1
                    continue
                return
            name, at = found[2].lower(), found.end()
            yield ("end" if found[1] else "start"), name, found[3]
            if name in RAW and not found[1]:
                close = END_OF[name].search(page, at)
                if not close:
                    return
                at = close.start()
        elif after in ("!", "?", "/"):
            if page.startswith("<!--", sign):
                short = page.startswith(("<!-->", "<!--->"), sign)
                close = page.find(">" if short else "-->", sign + 4 if not short else sign)
                at = close + (1 if short else 3)
            else:
                close = page.find(">", sign)
                at = close + 1
            if close < 0:
                return
        else:
            yield "text", "<", ""
            at = sign + 1


class Tree:
    """Elements in page order, and the text between borders of blocks."""

    def __init__(self, page: str):
        self.name, self.parent, self.attributes = ["html"], [-1], [""]
        self.pieces: list[tuple[int, int, bool, str]] = []
        self.owner: list[int] = []
        self.links = [0]
        stack, opened = [0], Counter(html=1)
        border, link, breaks = True, -1, 0

        def close(depth: int) -> None:
            nonlocal border, link
            while len(stack) > depth:
                name = self.name[stack.pop()]
                opened[name] -= 1
                border = border or name in BLOCK
            if link >= depth:
                link = -1

        def close_nearest(names: frozenset[str], until: frozenset[str]) -> None:
            if any(opened[n] for n in names):
                for k in range(len(stack) - 1, 0, -1):
                    name = self.name[stack[k]]
                    if name in names:
                        return close(k)
                    if name in until:
                        return

        for kind, name, rest in _events(page):
            if kind == "text":
                text = unescape(name) if "&" in name else name
                if breaks and text.strip():
                    border, breaks = border or breaks > 1, 0
                if opened["head"] and text.strip():
                    close_nearest(frozenset(["head"]), frozenset())
                if border and text.strip():
                    k = len(stack) - 1
                    while k and self.name[stack[k]] not in BLOCK:
                        k -= 1
                    self.owner.append(stack[k])
                    border = False
                if not border:
                    self.pieces.append((len(self.owner) - 1, stack[-1], link >= 0, text))
            elif kind == "end":
                if name == "a":
                    link = -1
                if name in ("body", "html") or not opened[name]:
                    continue
                until = frozenset(["table", "html"]) if name in TABLE_PART - {"table"} else SCOPE
                if name not in BLOCK:
                    until = until | BLOCK
                elif name == "table":
                    until = frozenset(["html"])
                close_nearest(frozenset([name]), until - {name})
            else:
                if name in ("html", "body") and opened[name]:
                    continue
                if opened["head"] and name not in HEAD:
                    close_nearest(frozenset(["head"]), frozenset())
                if name == "br":
                    breaks += 1
                    if not border:
                        self.pieces.append((len(self.owner) - 1, stack[-1], False, " "))
                    continue
                if name in BLOCK:
                    border, breaks = True, 0
                    if opened["p"] and name not in ("html", "body", "option", "legend", "caption"):
                        close_nearest(frozenset(["p"]), SCOPE)
                    if name in HEADING and self.name[stack[-1]] in HEADING:
                        close(len(stack) - 1)
                if name in CLOSES:
                    close_nearest(*CLOSES[name])
                if name in VOID:
                    continue
                if len(stack) >= DEPTH:
                    close(DEPTH - 1)
                self.name.append(name)
                self.parent.append(stack[-1])
                self.attributes.append(rest)
                self.links.append(0)
                if name == "a":
                    link = len(stack) if "href" in rest.lower() else -1
                    self.links[-1] = int(link >= 0)
                stack.append(len(self.name) - 1)
                opened[name] += 1


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value, bare in ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), value.strip("\"'"))
    return found


class Page:
    """A page's tree with what is dropped and how containers score."""

    def __init__(self, page: str):
        tree = self.tree = Tree(page)
        n = len(tree.name)
        self.words: list[frozenset[str]] = []
        self.role = [""] * n
        own = [False] * n
        reply, chrome = [False] * n, [False] * n
        for i, (name, text) in enumerate(zip(tree.name, tree.attributes)):
            found = _attributes(text) if text.strip() and name != "a" else {}
            words = frozenset(w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
            self.words.append(words)
            self.role[i] = found.get("role", "").lower() or {"main": "main", "article": "article"}.get(name, "")
            reply[i] = bool(words & REPLIES) and name not in ("html", "body")
            chrome[i] = (bool(words & CHROME) or self.role[i] in ROLES) and name not in ("html", "body", "main", "article")
            own[i] = (
                name in DROPPED
                or "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or bool(HIDDEN.search(found.get("style", "")))
            )
        for i in range(1, n):
            reply[i] = reply[i] or (reply[tree.parent[i]] and self.role[i] != "main")
        article = [self.role[i] in ("main", "article") and not reply[i] for i in range(n)]
        holds, title = list(article), [x == "h1" for x in tree.name]
        for i in range(n - 1, 0, -1):
            holds[tree.parent[i]] |= holds[i]
            title[tree.parent[i]] |= title[i]
        inside = list(article)
        for i in range(1, n):
            inside[i] = inside[i] or inside[tree.parent[i]]
        # Before classes are heard: characters and links of what is left.
        replies = [bool(self.words[i] & REPLIES) and i > 0 and tree.name[i] != "body" for i in range(n)]
        for i in range(1, n):
            if replies[i] and not (holds[i] or title[i] and tree.name[i] != "article"):
                own[i] = True
            elif tree.name[i] in ASIDE:
                kept = holds[i] or (tree.name[i] == "form" and title[i]) or (tree.name[i] == "header" and inside[i])
                own[i] = own[i] or not kept
        self.dropped = self._down(own)
        size, links, count = self._sizes()
        whole = max(size[0], 1)
        for i in range(1, n):
            if chrome[i] and not holds[i]:
                heading = self.words[i] & {"header"} and title[i] and inside[i]
                own[i] = own[i] or not (size[i] > MOST * whole or heading)
            if tree.name[i] in LIST and count[i] >= 2 and links[i] >= MENU * size[i] and links[i] < 25 * count[i]:
                own[i] = True
        self.dropped = self._down(own)
        self.size, self.links, _ = self._sizes()

    def _down(self, own: list[bool]) -> list[bool]:
        out = list(own)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.tree.parent[i]]
        return out

    def _sizes(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, characters of links, and links that each element holds."""
        tree, n = self.tree, len(self.tree.name)
        size, links = [0] * n, [0] * n
        for _, at, link, text in tree.pieces:
            if not self.dropped[at]:
                length = len(text.strip())
                size[at] += length
                links[at] += length * link
        count = [0 if self.dropped[i] else tree.links[i] for i in range(n)]
        for i in range(n - 1, 0, -1):
            up = tree.parent[i]
            size[up] += size[i]
            links[up] += links[i]
            count[up] += count[i]
        return size, links, count

    def blocks(self) -> list[tuple[int, str, int]]:
        """(owner, text, characters of links) of the blocks that are not dropped, in page order."""
        tree = self.tree
        texts: list[list[str]] = [[] for _ in tree.owner]
        links = [0] * len(tree.owner)
        for block, at, link, text in tree.pieces:
            if not self.dropped[at]:
                texts[block].append(text)
                links[block] += len(text.strip()) * link
        joined = [" ".join("".join(t).split()) for t in texts]
        return [(o, t, k) for o, t, k in zip(tree.owner, joined, links) if t]

    def scores(self, blocks: list[tuple[int, str, int]]) -> list[float]:
        tree = self.tree
        points = [0.0] * len(tree.name)
        for owner, text, _ in blocks:
            worth = len(text) / 25 if len(text) < 25 else 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
            at = owner if tree.name[owner] in CONTAINER - {"li", "td", "th", "dd", "blockquote"} else tree.parent[owner]
            for level in range(LEVELS):
                if at < 0:
                    break
                points[at] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
                at = tree.parent[at]
        out = []
        for i, p in enumerate(points):
            if p:
                p += 25 if self.role[i] in ("main", "article") else 0
                p += 25 if self.words[i] & CONTENT and tree.name[i] not in ("html", "body") else 0
                p -= 3 if tree.name[i] in LIST else 0
            out.append(p * (1 - self.links[i] / max(self.size[i], 1)))
        return out

    def text(self) -> str:
        """The blocks of the best container and of siblings that belong to it, a line each."""
        tree, blocks = self.tree, self.blocks()
        if not blocks:
            return ""
        score = self.scores(blocks)
        best = max(range(len(score)), key=lambda i: (score[i], -i))
        up, article, main = best, -1, -1
        while up >= 0:
            article = up if self.role[up] == "article" else article
            main = up if self.role[up] == "main" else main
            up = tree.parent[up]
        keep = [False] * len(tree.name)
        if article >= 0 or main >= 0:
            keep[article if article >= 0 else main] = True
        else:
            keep[best] = True
            for i in range(best and 1, len(tree.name)):
                if i and tree.parent[i] == tree.parent[best]:
                    keep[i] = keep[i] or score[i] >= SIBLING * score[best] or tree.name[i] in HEADING
        keep = self._down(keep)
        around = tree.parent[best]

        def prose(owner: int, text: str, links: int) -> bool:
            if owner != around and (tree.parent[owner] != around or tree.name[owner] not in ("p", "pre")):
                return False
            if len(text) > 80:
                return links < 0.25 * len(text)
            return not links and text.endswith((".", "!", "?", "。"))

        free = article < 0 and main < 0
        return "\n".join(t for o, t, k in blocks if keep[o] or free and prose(o, t, k))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text."""
    rest = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([Page(h.as_py()).text() for h in part.column("html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], schema=kind)

    return rest.mapInArrow(rows, "page_id long, url string, text string")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
