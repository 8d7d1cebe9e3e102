"""Main text of web pages by scoring the element tree.

A page is read into a tree as browsers do with broken markup: end tags may be missing, stray ones are
ignored, scripts and comments end where their own marks say. A stretch of text between block borders is a
paragraph; it has points for its length and commas, less its share of link text. Its container gets the
points, each container above half of what the one below has. The best container is kept, or the article
or main element around it, with those siblings that look like parts of it. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are left out wherever they stand, told by their
tag, role, class or id, or as lists and boxes made of links.

Defined results: character references are decoded once; all white space inside a block, a line break tag
too, is one blank; a table cell, list item or heading is a block of its own; a null or empty page, or one
without text, has the empty text. Pages are independent of one another: nothing is shuffled, no page is
cut, and the time is linear in its length however deep or broken it is. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import small_batches
from tablewright.llm.text_arrays import give_back

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
HEAD = set("base link meta noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
# Elements that can hold an article; text passes its points to the nearest of them.
CONTAINERS = set("article body center details div fieldset form html main section td".split())
# Elements of which an end tag inside closes nothing outside.
WALLS = ("table", "td", "th", "caption", "button", "object", "template")
# Start tag: the open elements that it closes, and those beyond which it does not look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)), "a": (("a",), ()),
}
# Never part of an article.
NO_TEXT = RAW | set(
    "applet audio button canvas datalist dialog embed head legend map menu meter nav noscript object option "
    "progress rp search select svg template video".split()
)
# Left out unless the page has its article in them.
BESIDE = set("aside fieldset footer form".split())
ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
# Words of class and id names that tell what is not the article; the second list counts in classes only.
ASIDE_WORDS = set(
    "ad ads adbox adslot adunit adsense adv advert adverts advertisement advertisements advertising anuncio anuncios "
    "anzeige anzeigen banner breadcrumb breadcrumbs comentarios comment commentaires commentlist comments consent cookie "
    "cookies copyright disqus foot footer gdpr kommentar kommentare login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion publicidad publicite "
    "recommended recommendations respond share sharing sidebar sidenav signup skyscraper social sponsor sponsored "
    "subscribe subscription taboola outbrain toolbar topbar topnav werbung widget".split()
)
CLASS_WORDS = ASIDE_WORDS | set("alert aside discussion form hidden legal related replies reply responses search side".split())
ASIDE_PARTS = re.compile(
    r"(?:cookie|consent|advert|sidebar|newsletter|breadcrumb|footer|comments|navbar|sponsor|popup)\w+"
    r"|\w+(?:sidebar|footer|navbar|menu|comments|commentlist|banner|advert)"
)
HEADER_WORDS = {"header", "pageheader", "siteheader", "topheader"}
ARTICLE_WORDS = {"article", "articlebody", "entry", "post", "story"}
NOT_BEFORE = {"has", "no", "not", "with", "without"}
NAME_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")
START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
COMMAS = re.compile("[,،、，]")
SENTENCE_END = (".", "!", "?", "…", "。")
ASIDE, HEADER, NEVER = 1, 2, 3


class Page:
    """The tree of a page: per element its tag, parent, mark (why it may go), look (tag and class) and
    whether its names say that it is an article.

    ``runs`` holds, in page order, the block that a stretch of text stands in and its pieces: the innermost
    element that matters, the text as written, and whether it is link text.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.mark, self.look, self.named = ["html"], [-1], [0], [("html", "")], [False]
        self.runs: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.pieces: list[tuple[int, str, bool]] = []
        self.stack: list[tuple[str, int, int]] = [("html", 0, 0)]  # tag, element, block around its text
        self.open: dict[str, list[int]] = defaultdict(list)
        self.seen = {"html"}
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        at, done, no_comment_end, endless = 0, 0, False, set()
        while (at := html.find("<", at)) >= 0:
            plain = PLAIN.match(html, at)
            if plain or (start := START.match(html, at)):
                self.text(html[done:at])
                close, name = (plain or start).groups()
                name = name.lower()
                if plain:
                    done, given = plain.end(), {}
                else:
                    done, given = self.attributes(html, start.end())
                if close:
                    self.end(name)
                else:
                    self.start(name, given)
                    if name in RAW and name not in endless:
                        ends = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, done)
                        if not ends and name not in ("script", "style"):
                            endless.add(name)
                        else:
                            done = ends.start() if ends else len(html)
                at = done
            elif html.startswith("<!--", at):
                self.text(html[done:at])
                stop = -1 if no_comment_end else html.find("-->", at + 2)
                no_comment_end = stop < 0
                done = at = stop + 3 if stop >= 0 else max(html.find(">", at) + 1, at + 4)
            elif html.startswith(("<!", "<?", "</"), at):
                self.text(html[done:at])
                stop = html.find(">", at)
                done = at = stop + 1 if stop >= 0 else len(html)
            else:
                at += 1
        self.text(html[done:])

    def attributes(self, html: str, at: int) -> tuple[int, dict[str, str]]:
        """The end of a start tag and its attributes; a quote that never closes ends with the tag."""
        given: dict[str, str] = {}
        while found := ATTRIBUTE.match(html, at):
            name, at = found.group(1).lower(), found.end()
            if "=" not in found.group():
                given.setdefault(name, "")
                continue
            quote = html[at : at + 1]
            if quote in ('"', "'") and self.last_quote[quote] > at:
                stop = html.find(quote, at + 1)
                value, at = html[at + 1 : stop], stop + 1
            else:
                found = VALUE.match(html, at)
                value, at = found.group().strip("\"'"), found.end()
            given.setdefault(name, unescape(value) if "&" in value else value)
        stop = html.find(">", at)
        return (stop + 1 if stop >= 0 else len(html)), given

    def text(self, text: str) -> None:
        if not text:
            return
        tag, element, _ = self.stack[-1]
        if tag == "head" and not text.isspace():
            self.pop(len(self.stack) - 1)
            tag, element, _ = self.stack[-1]
        if tag not in NO_TEXT:
            self.pieces.append((element, text, bool(self.open["a"])))

    def flush(self) -> None:
        if self.pieces:
            self.runs.append((self.stack[-1][2], self.pieces))
            self.pieces = []

    def wall(self) -> int:
        return max((self.open[w][-1] for w in WALLS if self.open[w]), default=0)

    def pop(self, depth: int) -> None:
        """Close the elements from ``depth`` of the stack on."""
        while len(self.stack) > depth:
            tag = self.stack[-1][0]
            if tag in BLOCKS:
                self.flush()
            self.stack.pop()
            if self.open[tag] and self.open[tag][-1] == len(self.stack):
                self.open[tag].pop()

    def start(self, name: str, given: dict[str, str]) -> None:
        if name in ("html", "head", "body") and name in self.seen:
            return
        if self.open["head"] and name not in HEAD:
            self.pop(self.open["head"][-1])
        self.seen.add(name)
        if name in BLOCKS and self.open["p"] and self.open["p"][-1] >= self.wall():
            self.pop(self.open["p"][-1])
        if name in HEADINGS and self.stack[-1][0] in HEADINGS:
            self.pop(len(self.stack) - 1)
        if name in CLOSES:
            closed, beyond = CLOSES[name]
            border = max((self.open[b][-1] for b in beyond if self.open[b]), default=-1)
            inside = [self.open[c][-1] for c in closed if self.open[c] and self.open[c][-1] > border]
            if name == "a" and inside:
                self.end("a")
            elif inside:
                self.pop(min(inside))
        if name == "br":
            self.text(" ")
        if name in BLOCKS:
            self.flush()
        if name in VOID or (name == "a" and "href" not in given):
            return
        _, element, block = self.stack[-1]
        if name in BLOCKS or name in NO_TEXT or given:
            self.tag.append(name)
            self.parent.append(element)
            self.mark.append(mark(name, given))
            self.look.append((name, given.get("class", "")))
            self.named.append(bool(given) and named_article(given))
            element = len(self.tag) - 1
        self.open[name].append(len(self.stack))
        self.stack.append((name, element, element if name in BLOCKS else block))

    def end(self, name: str) -> None:
        if name in ("body", "html") or not self.open[name]:
            if name == "br":
                self.text(" ")
            return
        depth = self.open[name][-1]
        if name not in WALLS and depth < self.wall() and name not in ("table", "tr", "tbody", "thead", "tfoot"):
            return
        if name not in BLOCKS and self.stack[-1][2] != self.stack[depth][2]:
            # A block is still open inside: the inline element ends, the block goes on.
            self.open[name].pop()
            return
        self.pop(depth)


def mark(name: str, given: dict[str, str]) -> int:
    """Whether an element is no part of an article by its tag (NEVER), or by tag, role or names."""
    if name in NO_TEXT:
        return NEVER
    if not given:
        return ASIDE if name in BESIDE else HEADER if name == "header" else 0
    style = given.get("style", "").replace(" ", "").lower()
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return NEVER
    if name in BESIDE or given.get("role", "").lower() in ROLES or given.get("itemprop") == "comment":
        return ASIDE
    if name in ("html", "body", "main"):
        return 0
    for attribute, words in (("class", CLASS_WORDS), ("id", ASIDE_WORDS)):
        if attribute == "id" and name in HEADINGS:
            continue
        for one in given.get(attribute, "").split():
            parts = [w.lower() for w in NAME_WORD.findall(one)]
            if NOT_BEFORE & set(parts):
                continue
            if any(w in words or ASIDE_PARTS.fullmatch(w) for w in parts):
                return ASIDE
            if HEADER_WORDS & set(parts):
                return 0 if ARTICLE_WORDS & set(parts) else HEADER
    return HEADER if name == "header" else 0


def named_article(given: dict[str, str]) -> bool:
    if given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody":
        return True
    words = {w.lower() for w in NAME_WORD.findall(given.get("class", "") + " " + given.get("id", ""))}
    return bool(words & ARTICLE_WORDS)


def link_share(chars: int, of_links: int) -> float:
    return of_links / chars if chars else 0.0


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    gone = marked_out(page)
    # Each run's text without what is left out, and its element's sums.
    texts, chars, linked, links, own = [], [0] * n, [0] * n, [0] * n, [0.0] * n
    for block, pieces in page.runs:
        kept = [(unescape(t) if "&" in t else t, a) for e, t, a in pieces if not gone[e]]
        text = " ".join("".join(t for t, _ in kept).split())
        texts.append(text)
        if text:
            of_links = [len(" ".join(t.split())) for t, a in kept if a]
            size, link = len(text), min(len(text), sum(of_links))
            chars[block] += size
            linked[block] += link
            links[block] += len(of_links)
            own[block] += (size / 100 + len(COMMAS.findall(text))) * (1 - link / size)
    total, score, passed = own[:], own[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        up = parent[i]
        chars[up], linked[up], links[up] = chars[up] + chars[i], linked[up] + linked[i], links[up] + links[i]
        total[up] += total[i]
        score[i] += passed[i]
        # Only containers halve what they hand on.
        passed[up] += score[i] / 2 if tag[i] in CONTAINERS else score[i]
    score[0] += passed[0]
    best = max((i for i in range(n) if tag[i] in CONTAINERS and not gone[i]), key=lambda i: score[i], default=0)
    kept = kept_elements(page, best, gone, score, total, chars, linked)
    for i in range(1, n):
        if gone[i]:
            kept[i] = False
        elif kept[parent[i]]:
            # A list or box made of links is a menu, wherever it stands.
            kept[i] = not (links[i] > 1 and tag[i] in BLOCKS and linked[i] > (0.8 if tag[i] == "p" else 0.5) * chars[i])
    return "\n".join(t for (block, _), t in zip(page.runs, texts) if t and kept[block])


def marked_out(page: Page) -> list[bool]:
    """Per element whether it is left out for what it or one above it is.

    Where the article itself stands in such an element (an advert that is never closed, a form around the
    page), the element stays: if no article or main element stands outside, those that hold one; without
    any, if less text stands outside, those that hold a level-one heading; else forms.
    """
    tag, parent, mark_of, n = page.tag, page.parent, page.mark, len(page.tag)
    inside = [False] * n  # within an article or main element
    for i in range(1, n):
        up = parent[i]
        inside[i] = inside[up] or (tag[up] in ("article", "main") and mark_of[up] == 0)
    titled = [False] * n
    for i in range(n - 1, 0, -1):
        if tag[i] in ("h1", "h2", "h3") or titled[i]:
            titled[parent[i]] = True
    own = [m != 0 and not (m == HEADER and inside[i] and titled[i]) for i, m in enumerate(mark_of)]
    gone = own[:]
    for i in range(1, n):
        gone[i] = own[i] or gone[parent[i]]
    sizes = [0] * n
    for _, pieces in page.runs:
        for element, text, _ in pieces:
            sizes[element] += len(text.strip())
    outside = sum(size for size, out in zip(sizes, gone) if not out)
    for wanted in (("article", "main"), ("h1",), ("form",)):
        if any(tag[i] in wanted and not gone[i] for i in range(n)):
            return gone
        holds = [t in wanted and (wanted == ("form",) or not own[i]) for i, t in enumerate(tag)]
        if any(holds) and (wanted[0] == "article" or outside < sum(sizes) - outside):
            for i in range(n - 1, 0, -1):
                holds[parent[i]] = holds[parent[i]] or holds[i]
            for i in range(1, n):
                gone[i] = gone[parent[i]] or (own[i] and (mark_of[i] == NEVER or not holds[i]))
            return gone
    return gone


def kept_elements(page: Page, best: int, gone: list[bool], score, total, chars, linked) -> list[bool]:
    """True for the container and its kept siblings."""
    tag, parent = page.tag, page.parent
    kept, last = [False] * len(tag), {block: pieces[-1][1] for block, pieces in page.runs}
    above = [best]
    while parent[above[-1]] >= 0:
        above.append(parent[above[-1]])
    wished = (lambda i: tag[i] == "article", lambda i: tag[i] == "main", lambda i: page.named[i])
    top = next((i for wish in wished for i in above if wish(i)), best)
    kept[top] = True
    if top == 0 or tag[top] in ("body", "main"):
        return kept
    strict = tag[top] == "article"
    for i in range(1, len(tag)):
        if parent[i] != parent[top] or i == top or gone[i] or not chars[i]:
            continue
        share = link_share(chars[i], linked[i])
        if tag[i] in HEADINGS:
            kept[i] = i < top and share < 0.5 and (not strict or tag[i] == "h1")
        elif strict and tag[i] != "article":
            continue
        elif tag[i] in CONTAINERS:
            alike = page.look[i] == page.look[top] and not strict
            kept[i] = share < 0.25 and (alike or total[i] >= 0.2 * score[top])
        else:
            sentence = last.get(i, "").rstrip().endswith(SENTENCE_END)
            kept[i] = share < 0.25 and chars[i] > 80 or share == 0 and sentence
    return kept


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
        columns = [*[batch.column(i) for i in range(batch.num_columns - 1)], texts]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text"])
    give_back()


def extract_main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keys`` and ``text``, one row per page."""
    small_batches(pages.sparkSession)

    def name(column: str):
        return F.col("`" + column.replace("`", "``") + "`")

    rows = pages.select(*[name(k).alias(f"key{i}") for i, k in enumerate(keys)], name(html).alias("html"))
    fields = ", ".join(f"key{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keys)))
    found = rows.mapInArrow(_extract, f"{fields}, text string")
    return found.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "text")
