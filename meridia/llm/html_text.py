"""Main text of web pages by composite text density.

Every block of a page's tree gets its characters for each tag, adjusted for links; every block also gets the sum of its
children's densities. The block of the greatest sum is the core of the article; the least density on the path from it to
the body is the threshold above which the best blocks of other subtrees join it. Density sees all that a reader sees but
readers' comments and controls: menus, headers, footers, sidebars and notices are told from the article by it. What stands inside
the picked blocks and is known by element, role or a whole class name as none of the article goes afterwards; no element is taken in
by its name.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Names of the HTML standard, and words by which page authors name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("script style noscript template iframe svg canvas object head title nav footer aside form button select textarea dialog menu input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense adsbygoogle adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert alerts warning announcement popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation topnav sidenav mainnav menu submenu menubar dropdown breadcrumb breadcrumbs side sidebar aside rail widget widgets header footer colophon masthead topbar share sharing social comment comments commentlist commentform reply replies respond disqus discussion responses feedback talkback related recommended recommendations pagination pager login search skip copyright disclaimer hidden".split()
)
#: The words that tell boilerplate inside an article, a main or the chosen text too, where the others may name a part of the story.
CLEAR_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense adsbygoogle adslot sponsor sponsored sponsors promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup paywall "
    "nav navbar navigation topnav sidenav mainnav menu submenu menubar dropdown breadcrumb breadcrumbs sidebar widget widgets share sharing comment comments commentlist commentform disqus pagination pager login".split()
)
#: Words that say nothing by themselves; a name of such and the words above only is one of theirs ("share-buttons"), others are not ("menu-items").
PLAIN_WORDS = frozenset("box bar button buttons wrap wrapper container inner outer area block section top bottom left right list lists link links post posts entry holder slot unit zone form thread fixed sticky primary secondary global site mobile desktop small large main".split())
#: Names of what readers write, and elements that no reader sees or that are controls: the only ones that density does not see.
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus".split())
UNSEEN = frozenset("script style noscript template iframe svg canvas object head title button select textarea dialog input".split())
#: Elements that hold running text, unlike those that lay out a page.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th summary".split())
#: Elements that an opening tag closes, unless one of the limits is nearer.
SAME_LEVEL = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SAME_LEVEL = {k: (a.split(), b.split()) for k, (a, b) in SAME_LEVEL.items()}
P_LEVEL = (["p"], ["table", "td", "th", "button", "object"])
BARRIERS = ("table", "article", "section", "main")
#: Elements whose class or id names a part of a page; on others, such as p, the words that are not clear tell nothing.
CONTAINERS = frozenset("div section ul ol dl table tr td header figure article main center details fieldset".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""[\s/]*([^\s/>=]?[^\s/>=]*)(\s*=\s*)?""")
BARE = re.compile(r"[^\s>]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAMES = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))


def noise_level(tag: str, attrs: list[tuple[str, str]]) -> int:
    """3: unseen or readers' comments; 2: boilerplate wherever it stands; 1: by a word that may also name a part of a story; 0: none."""
    level = 3 if tag in UNSEEN else 2 * (tag in NOISE_TAGS)
    for name, value in attrs:
        if name in ("class", "id"):
            for one in value.split():
                told = {w.lower() for w in WORD.findall(one)}
                if name == "class" and one.lower() == "hidden":
                    return 3
                if one.lower() == "adsbygoogle":
                    level = max(level, 2)
                # A word of a longer name, such as "modal-verbs", tells nothing, and none does on running text.
                elif tag in CONTAINERS and told <= NOISE_WORDS | PLAIN_WORDS and told & NOISE_WORDS:
                    level = max(level, 3 if told & COMMENT_WORDS else 2 if told & CLEAR_WORDS else 1)
        elif name == "role":
            level = max(level, 2 * (value.lower() in NOISE_ROLES))
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return 3
        elif name == "hidden" or value.lower() == "true":
            return 3
    return level


def density(chars: int, tags: int, links: int, link_tags: int, body: float) -> float:
    """Composite density: characters for each tag, times a logarithm that falls with the share of links in both; body is
    the share of linked characters in the whole page. A block of links alone has 0."""
    c, t, lc, lt = chars, tags or 1, links or 1, link_tags or 1
    base = log(c / max(c - links, 1) * links + body * c + e)
    return c / t * log(max(c / lc * t / lt, 1.0)) / log(max(base, 1.0 + 1e-9))


class Page:
    """The tree as parallel lists; a node's number is less than its children's. Node 0 is the whole page; pieces are nodes'
    own texts in page order. Time and memory are linear in the page's length, however broken its markup is."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise = ["body"], [-1], [0]
        self.inside = [False]  # of an article or main
        self.pieces: list[tuple[int, str]] = []
        self.source, self.stack, self.open = source, [0], defaultdict(list)  # open: places in the stack by tag
        self.quotes, unclosed = True, set()
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                break
            m = TAG.match(source, lt)
            if not m:
                end = self._declaration(lt)
                if end is None:  # a bare "<" is text
                    self._text(source[at : lt + 1])
                    at = lt + 1
                else:
                    self._text(source[at:lt])
                    at = end
                continue
            attrs, bare, end = self._attributes(m.end())
            if end < 0:  # no ">" in the rest of the page: text
                break
            self._text(source[at:lt])
            at, name = end, m[2].lower()
            if self.open["head"] and name not in IN_HEAD and not m[1]:  # a head that was not closed
                self._pop(self.open["head"][-1])
            if name in ("html", "body"):
                continue
            if m[1]:
                self._closing(name)
                continue
            if name in RAW and name not in unclosed:
                close = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(source, at)
                if close or name in ("script", "style"):
                    end = source.find(">", close.end()) if close else -1
                    at = end + 1 if end >= 0 else n
                    continue
                unclosed.add(name)
            self._opening(name, attrs, bare)
        self._text(source[at:])

    def _declaration(self, lt: int) -> int | None:
        """Where the comment or declaration at lt ends, the page's end if it is not closed; None if there is none."""
        if self.source.startswith("<!--", lt):
            end = self.source.find("-->", lt + 4)
            return end + 3 if end >= 0 else len(self.source)
        if self.source.startswith(("!", "?", "/"), lt + 1):
            end = self.source.find(">", lt)
            return end + 1 if end >= 0 else len(self.source)
        return None

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """The attributes of NAMES, whether the tag closes itself, and the place behind it (-1: it never ends). If quotes leave the page's
        last tag open, this tag and all after it end at the next ">", whatever is quoted."""
        source, n, begin = self.source, len(self.source), at
        found: list[tuple[str, str]] = []
        while self.quotes:
            m = ATTR.match(source, at)
            at, name, value = m.end(), m[1].lower(), ""
            if m[2] or at < n and source[at] == "=":
                at += 0 if m[2] else 1
                quote = source[at : at + 1]
                if quote and quote in "'\"":
                    end = source.find(quote, at + 1)
                    if end < 0:
                        break
                    value, at = source[at + 1 : end], end + 1
                else:
                    b = BARE.match(source, at)
                    value, at = b[0], b.end()
            if name in NAMES:
                found.append((name, value))
            if at >= n:
                break
            if source[at] == ">":
                return found, source[at - 1] == "/", at + 1
        self.quotes = False
        end = source.find(">", begin)
        return [], end > 0 and source[end - 1] == "/", end + 1 if end >= 0 else -1

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], html.unescape(text)))

    def _pop(self, place: int) -> None:
        """Closes all open elements from that place in the stack."""
        while len(self.stack) > place:
            self.open[self.tag[self.stack.pop()]].pop()

    def _last(self, names: list[str] | tuple[str, ...]) -> int:
        return max((self.open[x][-1] if self.open[x] else -1) for x in names)

    def _closing(self, name: str) -> None:
        place = self._last((name,))
        if place > 0 and not (name in INLINE or name in ("p", "li")) or place > self._last(BARRIERS):
            self._pop(place)

    def _opening(self, name: str, attrs: list[tuple[str, str]], bare: bool) -> None:
        for names, limits in ([P_LEVEL] if name in CLOSES_P else []) + ([SAME_LEVEL[name]] if name in SAME_LEVEL else []):
            place = self._last(names)
            if place > self._last(limits):
                self._pop(place)
        i, above = len(self.tag), self.stack[-1]
        self.tag.append(name)
        self.parent.append(above)
        self.inside.append(self.inside[above] or self.tag[above] in ("article", "main"))
        self.noise.append(noise_level(name, attrs))
        if name not in INLINE:
            self.pieces.append((i, ""))  # parts the blocks
        if name not in VOID and not bare:
            self.open[name].append(len(self.stack))
            self.stack.append(i)

    def removed(self) -> tuple[list[bool], list[bool], list[bool]]:
        """For each node: whether density does not see it, whether it is boilerplate wherever it stands, and whether it is by what may also name a part
        of the story.

        Neither goes if it holds the page's article or headline; inside an article a header stays, and what may name a part
        of the story, unless links are more than half of its characters.
        """
        tag, parent, inside, n = self.tag, self.parent, self.inside, len(self.tag)
        level, size, links, in_link = list(self.noise), [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for i, text in self.pieces:
            if text:
                size[i] += len(text.strip())
                links[i] += len(text.strip()) * in_link[i]
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
            links[parent[i]] += links[i]
        for i in range(1, n):
            if inside[i] and level[i] == 1:
                level[i] = 2 * (2 * links[i] > size[i])
            elif tag[i] == "header" and level[i] < 2 and not inside[i]:
                level[i] = 1
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[i] |= tag[i] == "h1" or tag[i] in ("article", "main") and not level[i] and not inside[i]
            holds[parent[i]] |= holds[i]
        unseen, hard, soft = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            goes = tag[i] in NOISE_TAGS and tag[i] != "form" or not holds[i]
            unseen[i] = unseen[parent[i]] or level[i] == 3 and goes
            hard[i] = hard[parent[i]] or level[i] >= 2 and goes
            soft[i] = soft[parent[i]] or level[i] == 1 and goes
        return unseen, hard, soft

    def densities(self, gone: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
        """For each block its density, the sum of its children's and its linked characters, and the block around each node. Inline elements but links
        are no tags, their text is their block's; text right in a block counts as a child of its own."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        block, in_link = list(range(n)), [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
            if tag[i] in INLINE:
                block[i] = block[parent[i]]
        own, own_links, own_a = [0] * n, [0] * n, [0] * n
        for i, text in self.pieces:
            if text and not gone[i]:
                k = len("".join(text.split()))
                own[block[i]] += k
                own_links[block[i]] += k * in_link[i]
        for i in range(1, n):
            own_a[block[i]] += tag[i] == "a" and not gone[i]
        chars, links, link_tags, tags = list(own), list(own_links), list(own_a), list(own_a)
        for i in range(n - 1, 0, -1):
            if block[i] == i and not gone[i]:
                p = block[parent[i]]
                chars[p] += chars[i]
                links[p] += links[i]
                link_tags[p] += link_tags[i]
                tags[p] += tags[i] + 1
        body = links[0] / max(chars[0], 1)
        self.counts = chars, links, self._prose(gone)
        dense, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and block[i] == i and not gone[i]:
                dense[i] = density(chars[i], tags[i], links[i], link_tags[i], body)
                total[i] += density(own[i], own_a[i], own_links[i], own_a[i], body) if own[i] else 0.0
                if i:
                    total[block[parent[i]]] += dense[i]
        return dense, total, links, block

    def _prose(self, gone: list[bool]) -> list[int]:
        """Characters of each block in elements that hold running text, without linked ones."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        inside, total = [False] * n, [0] * n
        for i in range(1, n):
            inside[i] = (inside[parent[i]] or tag[i] in PROSE) and tag[i] != "a"
        for i, text in self.pieces:
            if text and inside[i] and not gone[i]:
                total[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        return total

    def picked(self, gone: list[bool]) -> set[int]:
        """The block of the greatest sum, and the best ones of the subtrees that reach the threshold."""
        dense, total, links, block = self.densities(gone)
        n = len(dense)
        best = list(range(n))  # block of the greatest sum in each subtree; of equals the outermost that has no more links, then the first
        for i in range(n - 1, 0, -1):
            p = block[self.parent[i]]
            own, other = best[i], best[p]
            if block[i] == i and total[own] > 0 and (total[own] > total[other] or total[own] == total[other] and (other != p or links[own] < links[other])):
                best[p] = own
        chars, _, prose = self.counts
        core = self.widened(best[0], dense, block)
        threshold, i = dense[core], core
        while i:
            i = block[self.parent[i]]
            threshold = min(threshold, dense[i])
        reach = [False] * n
        reach[0] = True
        for i in range(1, n):
            p = block[self.parent[i]]
            reach[i] = block[i] == i and reach[p] and dense[i] >= threshold and dense[i] > 0
        # What joins has running text; a bare block of a few words has a high density too.
        return {core, best[0]} | {best[i] for i in range(n) if reach[i] and 2 * prose[best[i]] >= chars[best[i]]}

    def widened(self, core: int, dense: list[float], block: list[int]) -> int:
        """The core, or the block around it while most of what that adds is running text without links. An article or main is not left."""
        chars, links, prose = self.counts
        while core and self.tag[core] not in ("article", "main"):
            out = block[self.parent[core]]
            more = chars[out] - chars[core]
            if 2 * (prose[out] - prose[core]) < more:
                break
            core = out
        return core

    def main_text(self) -> str:
        """What is picked, the last headline before it, and what stands between these, unless most of it is links. White space is one space."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        unseen, hard, soft = self.removed()
        gone = [a or b for a, b in zip(hard, soft, strict=True)]
        roots = self.picked(unseen)
        kept, linked, headline = [False] * n, [False] * n, [0] * n
        for i in range(n):
            kept[i] = not gone[i] and (i in roots or i > 0 and kept[parent[i]])
            linked[i] = tag[i] == "a" or i > 0 and linked[parent[i]]
            headline[i] = i if tag[i] == "h1" and not gone[i] else headline[parent[i]] if i else 0
        told = [k for k, (i, text) in enumerate(self.pieces) if not hard[i] and text and not text.isspace()]
        taken = {k for k in told if kept[self.pieces[k][0]]}
        if not taken:
            return ""
        first, last = min(taken), max(taken)
        title = 0
        for k in told:
            if k < first and headline[self.pieces[k][0]]:
                title = headline[self.pieces[k][0]]
        if title:
            own = [k for k in told if headline[self.pieces[k][0]] == title]
            taken.update(own)
            first = own[0]
        gap: list[int] = []
        for k in told:
            if first <= k <= last:
                if k not in taken:
                    gap.append(k)
                elif gap:
                    size = [len(self.pieces[g][1].strip()) for g in gap]
                    if 2 * sum(s for s, g in zip(size, gap, strict=True) if linked[self.pieces[g][0]]) < sum(size):
                        taken.update(gap)
                    gap = []
        out, before = [], 0
        block = list(range(n))
        for i in range(1, n):
            if tag[i] in INLINE:
                block[i] = block[parent[i]]
        for k, (i, text) in enumerate(self.pieces):
            if block[i] != before:
                out.append(" ")
            before = block[i]
            if not text or text.isspace():
                out.append(" " if not text or not hard[i] else "")
            elif k in taken:
                out.append(text)
        return " ".join("".join(out).split())


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _extract(batches: Iterator[pa.RecordBatch], column: str, name: str, bytes_at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, begin, texts, size = b.schema.get_field_index(column), 0, [], 0
        for k in range(len(b)):
            texts.append(main_text(b.column(at)[k].as_py()))
            size += len(texts[-1])
            if size >= bytes_at_once or k + 1 == len(b):
                part = b.slice(begin, k + 1 - begin)
                yield part.remove_column(at).append_column(name, pa.array(texts, pa.string()))
                begin, texts, size = k + 1, [], 0


def extract_text(pages: DataFrame, html_col: str = "html", text: str = "text") -> DataFrame:
    """pages with html_col replaced by the main text: white space is one space within and between blocks.

    Null, empty and text-free pages, and empty tables, give empty texts or none. Broken markup is read as browsers do in the main: unclosed
    paragraphs and items end where the next begins, stray closing tags are passed over, what is never closed ends with
    the page. Very long pages take time and memory in proportion to their length. Of blocks with the same density sum (ties)
    the outermost without more links is the core, of several the first. Each page is read alone, so repeated rows give repeated results. A column
    already named as text is replaced; others are kept whatever their names.
    """
    pages = pages.select(*[c for c in pages.columns if c == html_col or c.lower() != text.lower()])
    schema = T.StructType([*pages.drop(html_col).schema.fields, T.StructField(text, T.StringType())])
    return pages.mapInArrow(lambda it: _extract(it, html_col, text), schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
