"""Main text of web pages by composite text density.

A page becomes a DOM (one pass of a tag pattern with the implied end tags of HTML). Parts that never hold an
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; by element, role,
class or id) leave it. Within an article a class or id counts only where it names the element's role, not as a word
of a longer one, and never removes most of the article's text, save a thread of comments. For every node the link-adjusted density of characters per tag is computed; a node's sum is
that of its children's densities. The subtree with the largest sum is selected and widened along its path to the
body while the parent holds other parts whose density reaches the path's threshold, the least density on that path.

Its blocks are joined in page order by one line feed; white space inside a block is one space and character
references are decoded.

Defined results: null or empty html, and pages without text outside the left-out parts, give an empty text. Ties go
to the outer, then the earlier node. Malformed markup never fails: unknown end tags are ignored, open elements end
with their parent. Repeated rows give repeated rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, trimmed

#: Fixed values of HTML: elements without content, elements whose content is no markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names, up to the given fence.
_LIST, _TABLE = frozenset(["ul", "ol", "menu"]), frozenset(["table"])
ENDS = {"li": (("li",), _LIST), "dt": (("dt", "dd"), frozenset(["dl"])), "dd": (("dt", "dd"), frozenset(["dl"])), "tr": (("tr",), _TABLE), "td": (("td", "th"), frozenset(["tr"])), "th": (("td", "th"), frozenset(["tr"])), "option": (("option",), frozenset(["select"]))}
FENCE = frozenset("article section div td th table body main aside blockquote li button form".split())

#: Elements, roles and words of classes and ids that mark what is no article.
NO_ARTICLE = frozenset("nav footer aside form button select dialog menu svg object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MAIN = frozenset(["article", "main"])
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot header masthead topbar comment comments disqus respond reply "
    "replies discussion share sharing social related recommended recommendations widget widgets pagination pager toolbar search skip form copyright toc taglist tags".split()
)
#: Hints that name an article's own parts when they stand inside it.
INSIDE_OK = frozenset(["header", "foot", "tags", "discussion"])
#: Words that may stand beside hints in a class or id that names an element's role inside an article.
BESIDE = frozenset("article post entry page site blog wp box block bar list link links button buttons icon icons section area panel slot unit item items posts articles stories wrapper wrap container inner holder group".split())
#: Hints of what others wrote below an article, often longer than it; and elements whose id is an anchor made of their title.
THREADS = frozenset("comment comments disqus respond reply replies".split())
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def role(value: str, hints: frozenset) -> int:
    """1 if a class or id inside an article names an element's role (each of its words is a hint or stands beside one), 2 if that of a thread."""
    out = 0
    for token in value.split():
        parts = {word.lower() for word in WORD.findall(token)}
        if parts & hints and parts <= HINTS | BESIDE:
            out = max(out, 2 if parts & THREADS else 1)
    return out


def left_out(name: str, rest: str, inside: bool) -> int:
    """0: an ordinary element; 1: marked by class or id; 2: certainly no article. inside: within an article."""
    if name in NO_ARTICLE or name == "header" and not inside:
        return 2
    if not rest or name in ("html", "body"):
        return 0
    out = 0
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return 2
        if key == "role" and value.lower() in ROLES:
            return 2
        if key in ("class", "id") and inside:
            out = max(out, role(value, THREADS if key == "id" and name in TITLED else HINTS - INSIDE_OK))
        elif key in ("class", "id"):
            if any(word.lower() in HINTS for word in WORD.findall(value)):
                out = 1
    return out


class Page:
    """A page's nodes in document order as parallel lists, and its text runs between block borders."""

    def __init__(self, source: str):
        self.name, self.parent, self.last, self.mark, self.inside = ["#"], [0], [0], [0], [False]
        self.chars, self.linked, self.tags, self.links, self.main = [0], [0], [0], [0], [False]
        self.runs: list[tuple[int, str | None]] = []  # (node, text); None is the border of a block
        self._parse(source)

    def _open(self, name: str, rest: str, parent: int) -> int:
        i = len(self.name)
        inside = self.inside[parent] or name in MAIN
        for column, value in ((self.name, name), (self.parent, parent), (self.last, i), (self.mark, left_out(name, rest, inside)), (self.inside, inside), (self.chars, 0), (self.linked, 0), (self.tags, 0), (self.links, 0), (self.main, False)):
            column.append(value)
        return i

    def _parse(self, source: str) -> None:
        stack, count, at, runs = [0], {}, 0, self.runs
        in_link = 0

        def close(depth: int) -> None:
            nonlocal in_link
            while len(stack) > depth:
                i = stack.pop()
                n = self.name[i]
                count[n] -= 1
                in_link -= n == "a"
                self.last[i] = len(self.name) - 1
                if n in BLOCK:
                    runs.append((i, None))

        def find(names: tuple[str, ...], fence: frozenset) -> int:
            for d in range(len(stack) - 1, 0, -1):
                n = self.name[stack[d]]
                if n in names:
                    return d
                if n in fence:
                    return 0
            return 0

        def text(part: str) -> None:
            if part and not part.isspace():
                if "&" in part:
                    part = entities.unescape(part)
                runs.append((stack[-1], part))
                size = len(part.strip())
                self.chars[stack[-1]] += size
                if in_link:
                    self.linked[stack[-1]] += size
            elif part:
                runs.append((stack[-1], " "))

        while True:
            m = TOKEN.search(source, at)
            if not m:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m["cdata"]:
                    text(m["cdata"])
                continue
            name = name.lower()
            if m["end"]:
                if name == "br" or name == "p" and not count.get("p"):
                    runs.append((stack[-1], " " if name == "br" else None))
                elif count.get(name):
                    d = find((name,), frozenset())
                    if d:
                        close(d)
                continue
            if name in ("html", "body") and count.get(name):
                continue
            if name in BLOCK and count.get("p"):
                d = find(("p",), FENCE)
                if d:
                    close(d)
            if name in ENDS and any(count.get(x) for x in ENDS[name][0]):
                d = find(*ENDS[name])
                if d:
                    close(d)
            rest = m["rest"]
            i = self._open(name, rest, stack[-1])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self.mark[i] = 2
            elif name in VOID:
                runs.append((i, None if name == "hr" else " " if name == "br" else ""))
            elif not rest.rstrip().endswith("/") or name in BLOCK or name in ("a", "b", "i", "span", "em", "strong"):
                if name in BLOCK:
                    runs.append((i, None))
                stack.append(i)
                count[name] = count.get(name, 0) + 1
                in_link += name == "a"
        close(1)
        self.last[0] = len(self.name) - 1

    def main_text(self) -> str:
        n = len(self.name)
        name, parent = self.name, self.parent
        for i in range(n - 1, 0, -1):  # what each subtree holds
            if name[i] in MAIN:
                self.main[i] = True
            if self.main[i]:
                self.main[parent[i]] = True
        whole, plain = self.chars[:], [c - k for c, k in zip(self.chars, self.linked)]
        for i in range(n - 1, 0, -1):
            whole[parent[i]] += whole[i]
            plain[parent[i]] += plain[i]
        own = [c - k for c, k in zip(self.chars, self.linked)]  # plain without what is certainly no article
        full = [False] * n  # holds an article element
        for i in range(n - 1, 0, -1):
            if self.mark[i] != 2 or self.main[i]:
                own[parent[i]] += own[i]
            full[parent[i]] = full[parent[i]] or full[i] or name[i] == "article"
        gone, home = [False] * n, [0] * n  # home: the article around a node, or a main element that holds none
        for i in range(1, n):
            p = parent[i]
            home[i] = p if name[p] == "article" or name[p] == "main" and not full[p] and not home[p] else home[p]
            if gone[p]:
                gone[i] = True
            elif self.mark[i] and not self.main[i]:
                # within an article, or on a page without one, a class or id alone does not remove most of its text
                most = 2 * own[i] > own[home[i]] if home[i] else not self.main[0] and 2 * plain[i] > plain[0]
                gone[i] = self.mark[i] == 2 or not most
        chars, linked = [0 if g else c for c, g in zip(self.chars, gone)], [0 if g else c for c, g in zip(self.linked, gone)]
        tags, links = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            links[p] += links[i] + (name[i] == "a")
        if not chars[0]:
            return ""
        share = linked[0] / chars[0]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if gone[i] or not chars[i]:
                continue
            c, lc, t, lt = chars[i], linked[i], max(tags[i], 1), max(links[i], 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            inner = c / max(lc, 1) * t / lt
            density[i] = c / t * (math.log(inner) / math.log(base) if base > 1.0 and inner > 0 else math.log(max(inner, 1.0)) + c / t)
            if density[i] < 0:
                density[i] = 0.0
            if not total[i]:
                total[i] = density[i]  # a node without elements stands for itself
            if i and name[i] not in VOID:
                total[parent[i]] += density[i]
        best = max((i for i in range(n) if not gone[i] and chars[i]), key=lambda i: (total[i], -i))
        path, i = [best], best
        while i and name[i] != "body":
            i = parent[i]
            path.append(i)
        least = min((density[x] for x in path[:-1]), default=density[best])
        root, children = best, {i: [] for i in path}
        for x in range(1, n):
            if parent[x] in children and not gone[x] and chars[x]:
                children[parent[x]].append(x)
        for up in path[1:]:
            outside = chars[up] - chars[root]
            if not outside:
                if name[up] in MAIN:
                    root = up
                continue
            near = any(density[x] >= least or name[x] in ("h1", "h2", "p") for x in children[up] if not x <= root <= self.last[x])
            if near or name[up] in MAIN:
                root = up
        blocks, block = [], []
        for i, part in self.runs:
            if part is None:
                if block:
                    blocks.append(block)
                    block = []
            elif root <= i <= self.last[root] and not gone[i]:
                block.append(part)
        blocks.append(block)
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extracted(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` of every row; one pass, no shuffle, one page in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, 256):
                part = [main_text(x.as_py()) for x in source.slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, 256) for c in batch.columns[:-1]), pa.array(part, pa.string()), pa.array([len(x) for x in part], pa.int64())], names=[*keep, "text", "n_chars"])

    small_batches(df.sparkSession)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(trimmed(run), f"{schema}, text string, n_chars long")
