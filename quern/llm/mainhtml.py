"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text inside them, less links, and the page votes for the generalised path of the
innermost one that holds most of its score: tags with their classes, digits and positions taken out. Spark sums the votes
of each path over the pages of a host, and every page is extracted again from the containers with its host's winning
path; a page in which that path holds little uses its own choice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.urlfilter import host_of

# Fixed values of HTML: elements by how they are treated.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "select"}
#: Of these the content is plain text up to the end tag, and all of the page without one.
PLAIN = {"script", "style", "textarea", "title", "iframe"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head"} | RAW
#: Dropped elements that stand inside a line: the block around them goes on after them.
INLINE = {"button"} | RAW - {"title"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
} | DROPPED - INLINE
CONTAINERS = {"article", "body", "div", "main", "section", "td"}
#: A start tag closes open elements of these names, as HTML leaves their end tags out, up to a barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
P_BARRIERS = CONTAINERS | {"table", "ul", "ol", "blockquote"} | INLINE
#: Words of classes, ids and roles that mark what is not part of an article: of any element, and of boxes around others.
_AD = r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|popup|newsletter"
_BOX = (
    r"notice|modal|overlay|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|aside|footer\w*|header\w*|masthead|toolbar|"
    r"comment|comments|commentlist|disqus|pagination|pager|login|signup"
)
#: Words that may also name a part of the article itself: what they mark within one is judged by its text.
_EITHER = r"subscribe|share|sharing|social|related|recommend\w*|respond|reply|replies|widget\w*|tags|search|skip"
NOISE, BOX_NOISE, EITHER = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])") for words in (_AD, f"{_AD}|{_BOX}", _EITHER))
#: Of a part that such a word marks within an article, fewer words than this, or half of its characters in links, are no text.
BOX_WORDS = 8
#: Elements of an article's own text, whose classes are judged by the shorter list.
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "b", "i", "em", "strong", "code", "a"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none")
_SPACE = re.compile(r"\s+")
#: The share of a page's score that its chosen container holds; a host's path that holds less than the other is not used.
SHARE, LEAST_SHARE = 0.8, 0.5
#: A block of so many words, few of them in links, is text: what stands beside the chosen container with such a block stays.
TEXT_WORDS = 10
#: Up to so many hosts, their winning paths are broadcast; beyond, pages are joined by host and one of so many salts.
BROADCAST_HOSTS, SALTS = 200_000, 32


@lru_cache(64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


class Page:
    """Blocks (text, link characters, container number) of a page outside dropped parts, and its containers.

    Time and memory are linear in the page: open elements are found by name, and a container's path is a hash of its
    parent's and its own name.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.names, self.keys, self.parents = ["html"], [0], [-1]
        self.boxes: list[int] = []  # of each block the marked part of an article around it, or -1
        self._parse(html)
        self._judge()

    def _judge(self) -> None:
        """Drops the blocks of marked parts that are links or a few words."""
        sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
        for (block, links, _), box in zip(self.blocks, self.boxes, strict=True):
            if box >= 0:
                sums[box] = [x + y for x, y in zip(sums[box], (len(block), links, block.count(" ") + 1), strict=True)]
        gone = {box for box, (chars, links, words) in sums.items() if 2 * links >= chars or words < BOX_WORDS}
        if gone:
            self.blocks = [b for b, box in zip(self.blocks, self.boxes, strict=True) if box not in gone]

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool, int, bool]] = []  # tag, container, dropped, in a link, marked part, in an article
        where: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
        text: list[str] = []
        unclosed: set[str] = set()  # quotes that don't occur any more
        links = at = marked = 0

        def close_block():
            nonlocal links
            if text:
                block = _SPACE.sub(" ", "".join(text)).strip()
                if block:
                    self.blocks.append((block, links, stack[-1][1] if stack else 0))
                    self.boxes.append(stack[-1][4] if stack else -1)
                text.clear()
            links = 0

        def pop_to(i: int):
            if any(x[0] in BLOCKS for x in stack[i:]) and not (i and stack[i - 1][2]):  # within a dropped part nothing ends
                close_block()
            for x in stack[i:]:
                where[x[0]].pop()
            del stack[i:]

        def last(tags) -> int:
            return max((where[t][-1] for t in tags if where[t]), default=-1)

        def say(raw: str):
            nonlocal links
            if raw and not (stack and stack[-1][2]):
                got = unescape(raw)
                text.append(got)
                if stack and stack[-1][3]:
                    links += len(got.strip())

        def tag_end(i: int) -> int:
            """After the tag's ``>``, which a quoted value may hold; a quote without an end is an ordinary character."""
            while m := _STOP.search(html, i):
                i = m.end()
                quote = html[i - 1]
                if quote == ">":
                    return i
                if quote not in unclosed:
                    end = html.find(quote, i)
                    if end < 0:
                        unclosed.add(quote)
                    else:
                        i = end + 1
            return len(html)

        def after(mark: str, i: int) -> int:
            end = html.find(mark, i)
            return len(html) if end < 0 else end + len(mark)

        while m := _OPEN.search(html, at):
            say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0] == "<![CDATA[":
                    at = after("]]>", m.end())
                    say(html[m.end() : at].removesuffix("]]>").replace("&", "&amp;"))
                else:
                    at = after("-->" if m[0] == "<!--" else ">", at)
                continue
            tag, at = m[2].lower(), tag_end(at)
            if m[1]:
                if where[tag]:
                    pop_to(where[tag][-1])
                elif tag == "p" and not (stack and stack[-1][2]):
                    close_block()
                continue
            said = html[m.end() : at].removesuffix(">")
            if tag in BLOCKS:
                if where["p"] and where["p"][-1] > last(P_BARRIERS):  # a block ends an open paragraph
                    pop_to(where["p"][-1])
                if not (stack and stack[-1][2]):
                    close_block()
            if tag in CLOSES:
                barrier = last(BARRIERS.get(tag, ()))
                begun = [where[t][k] for t in CLOSES[tag] if (k := bisect_right(where[t], barrier)) < len(where[t])]
                if begun:
                    pop_to(min(begun))
            _, container, dropped, linked, box, article = stack[-1] if stack else ("", 0, False, False, -1, False)
            marks = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(said)} if said else {}
            if not dropped:
                named = f"{marks.get('class', '')} {marks.get('id', '')}"
                noise = NOISE if tag in TEXT_TAGS else BOX_NOISE
                whole = tag in ("html", "body", "article", "main")
                noisy = not whole and noise.search(named)
                if not whole and not noisy and EITHER.search(named):
                    if not article:
                        noisy = True
                    elif box < 0:
                        box, marked = marked, marked + 1
                article |= tag in ("article", "main")
                hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or _HIDDEN.search(marks.get("style", ""))
                dropped = bool(tag in DROPPED or noisy or hidden or marks.get("role") in (ROLES - {"search"} if article else ROLES))
            if tag in VOID or said.endswith("/") and tag not in BLOCKS:
                if tag in ("br", "hr", "wbr", "img"):
                    say("" if tag == "wbr" else " ")
                continue
            if tag in PLAIN:
                end = _end_tag(tag).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in CONTAINERS and not dropped:
                name = generalised(tag, marks.get("class", ""))
                self.names.append(name)
                self.keys.append(xxhash.xxh64_intdigest(f"{self.keys[container]}>{name}") - (1 << 63))
                self.parents.append(container)
                container = len(self.keys) - 1
            where[tag].append(len(stack))
            stack.append((tag, container, dropped, linked or tag == "a" and "href" in marks, box, article))
        say(html[at:])
        close_block()

    def scores(self) -> list[int]:
        """Of each container the characters of the blocks within it, less twice those in links."""
        out = [0] * len(self.keys)
        for block, links, c in self.blocks:
            out[c] += max(0, len(block) - 2 * links)
        for c in range(len(out) - 1, 0, -1):
            out[self.parents[c]] += out[c]
        return out

    def best(self, scores: list[int]) -> int | None:
        """The innermost container with SHARE of the score, or the article around it, so that one in several parts is whole."""
        if not scores[0]:
            return None
        # the share is over a half, so all that have it are nested, and inner ones are numbered later
        best = c = max(c for c, s in enumerate(scores) if s >= SHARE * scores[0])
        while c > 0:
            if self.names[c].partition(".")[0] in ("article", "main"):
                return c
            c = self.parents[c]
        # without one: up to the outermost container that adds text to it
        texts = {c for block, links, c in self.blocks if 2 * links < len(block) and block.count(" ") + 1 >= TEXT_WORDS}
        known = {best}  # within best
        for c in texts:
            passed = []
            while c not in known:
                if c > best:  # inner ones are numbered later
                    passed.append(c)
                    c = self.parents[c]
                else:
                    best = self.parents[best]
                    known.add(best)
            known.update(passed)
        return best

    def path(self, container: int) -> str:
        out = []
        while container >= 0:
            out.append(self.names[container])
            container = self.parents[container]
        return ">".join(reversed(out))

    def text(self, key: int | None = None) -> tuple[str, str | None]:
        """Blocks in page order of the containers with the path's key and all within them, and the path; of the page's
        best container where they hold too little."""
        scores = self.scores()
        chosen = [c for c, k in enumerate(self.keys) if k == key] if key is not None else []
        outer = [c for c in chosen if self.keys[self.parents[c]] != key]
        if not chosen or sum(scores[c] for c in outer) < LEAST_SHARE * scores[0]:
            best = self.best(scores)
            if best is None:
                return "\n\n".join(b for b, links, _ in self.blocks if 2 * links < len(b)), None
            chosen = [best]
        inside = [False] * len(self.keys)
        for c in chosen:
            inside[c] = True
        for c in range(1, len(inside)):
            inside[c] |= inside[self.parents[c]]
        return "\n\n".join(b for b, _, c in self.blocks if inside[c]), self.path(chosen[0])


def generalised(tag: str, classes: str) -> str:
    """A tag with its sorted classes, without those that hold a digit, as these tell pages of one template apart."""
    kept = sorted({c for c in classes.split() if not any(x.isdigit() for x in c)})
    return ".".join([tag, *kept])


def votes(pages: DataFrame) -> DataFrame:
    """Rows (host, key, votes, pages): a page gives the path of its best container that one's share of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, share = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                scores = page.scores()
                if (best := page.best(scores)) is not None:
                    hosts.append(host), keys.append(page.keys[best]), share.append(round(scores[best] / scores[0] * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(share, pa.int64())], names=["host", "key", "share"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, key long, share long")
    return rows.groupBy("host", "key").agg(F.sum("share").alias("votes"), F.count("*").alias("pages"))


def winners(voted: DataFrame) -> DataFrame:
    """The path with the most votes of each host, ties by its key: rows (host, key, votes)."""
    best = F.max(F.struct("votes", "key")).alias("best")
    return voted.groupBy("host").agg(best).select("host", F.col("best.key").alias("key"), F.col("best.votes").alias("votes"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Rows (page_id, url, text, n_chars, path), one per row of pages (page_id, url, html).

    A null html is empty and has an empty text; a null url belongs to the host of urls without one. n_chars counts code
    points. Pages of any length and depth are read whole, in linear time and memory. Repeated rows stay, an empty table
    gives no row, and other columns are not read. The winning paths are a written table with a row per host: up to
    broadcast_hosts it is broadcast and no html is shuffled; beyond, pages are dealt by host and a salt.
    """
    best = Scratch(pages.sparkSession, "hosts").keep(winners(votes(pages)).select(F.col("host").alias("__host"), F.col("key").alias("__key")))
    rows = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("__of"), "html")
    same = F.col("__of") == F.col("__host")
    if best.count() <= broadcast_hosts:
        best = F.broadcast(best)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        best = best.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        same &= F.col("__salt") == F.col("__part")
    joined = rows.join(best, same, "left").select("page_id", "url", "__key", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h or "").text(k) for k, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts, paths = [t for t, _ in found], [p for _, p in found]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n, pa.array(paths, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
