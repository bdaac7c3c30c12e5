"""Main text of web pages by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML vocabulary: fixed values
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body button div fieldset figure footer form header html main menu nav ol p section table td tr ul".split()
)
INLINE = frozenset("a abbr b br code em font i img label q s small span strong sub sup time u".split())
# elements that are never article text, by name
UNWANTED = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar"}
UNWANTED |= {"form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "search": "form"}
# words in class, id or role that name such an element
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar",
    "header": "header masthead",
    "footer": "footer contentinfo copyright",
    "sidebar": "sidebar aside complementary related recommended recommendations widget rail trending",
    "notice": "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription paywall alert signup dialog",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner",
    "comments": "comment comments disqus respond replies reply",
    "share": "share sharing social",
    "form": "search login",
}
HINT_KIND = {w: kind for kind, ws in HINTS.items() for w in ws.split()}

# elements whose content is never words: fixed values
RAW = "script style template svg iframe textarea select title noscript canvas object audio video".split()
RAW_OPEN = re.compile(rf"<({'|'.join(RAW)})\b", re.I)
RAW_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# text, or a tag without brackets among its attributes; a match that fails has read no further than the next bracket
PLAIN = re.compile(r"""([^<]+)|<(/?)([a-zA-Z][^\s/><"']*)(?=[\s/>])((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
SPECIAL = re.compile(r"""[>"']""")
ANGLE = re.compile(r"[<>]")
NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
SEMANTIC = re.compile(r"<(?:article|main)\b", re.I)


class TagEnds:
    """Where tags close: the first `>` outside quotes.

    Whatever is learned from one quote or bracket is kept, so all tags of a
    page together cost one pass over it, closed or not.
    """

    def __init__(self, source: str):
        self.source = source
        self.specials = [m.start() for m in SPECIAL.finditer(source)]
        self.known: dict[int, int] = {}

    def find(self, at: int) -> int:
        """Position of the `>` that closes a tag whose attributes start at `at`, -1 if none does."""
        passed, end = [], -1
        i = bisect_left(self.specials, at)
        while i < len(self.specials):
            if i in self.known:
                end = self.known[i]
                break
            passed.append(i)
            k = self.specials[i]
            if self.source[k] == ">":
                end = k
                break
            close = self.source.find(self.source[k], k + 1)
            if close < 0:
                break
            i = bisect_left(self.specials, close + 1)
        self.known.update(dict.fromkeys(passed, end))
        return end


def tokens(source: str) -> Iterator[tuple[str | None, str, str, str]]:
    """`(text, close, name, attrs)` in page order: text, or a tag when text is None.

    Comments, declarations and elements without words are left out. A tag that
    never closes ends at the next bracket. Time grows with the page's length,
    however it is written.
    """
    ends, at, size = None, 0, len(source)
    while at < size:
        plain = PLAIN.match(source, at)
        if plain and plain[1]:
            yield plain[1], "", "", ""
            at = plain.end()
        elif plain and (plain[2] or not RAW_OPEN.match(source, at)):
            yield None, plain[2], plain[3], plain[4]
            at = plain.end()
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at + 2)
            at = size if end < 0 else end + 1
        elif (tag := TAG.match(source, at)) is None:
            yield "<", "", "", ""
            at += 1
        else:
            ends = ends or TagEnds(source)
            end = ends.find(tag.end())
            raw = RAW_OPEN.match(source, at)
            if raw and end >= 0:
                closing = RAW_CLOSE[raw[1].lower()].search(source, end + 1)
                at = closing.end() if closing else size
            elif end >= 0:
                yield None, tag[1], tag[2], source[tag.end() : end]
                at = end + 1
            else:
                bracket = ANGLE.search(source, tag.end())
                end = bracket.start() if bracket else size
                yield None, tag[1], tag[2], source[tag.end() : end]
                at = end + 1 if bracket and bracket[0] == ">" else end


def hinted(attrs: str) -> str | None:
    for value in NAMING.findall(attrs):
        for word in re.findall(r"[a-z]+", value.lower()):
            if word in HINT_KIND:
                return HINT_KIND[word]
    return None


class Page:
    """Items of a page in order: `(key, n, block, container)` with the pieces of text of each block.

    A key names what is scored: a tag, or the words of a context. A context is
    the nearest unwanted element, `article`, or the nearest container.
    """

    def __init__(self, source: str):
        self.items: list[tuple[str, int, int, int]] = []
        self.pieces: list[str] = []  # of each item; tags have none
        self.names, self.parents, self.contexts = ["page"], [-1], ["body"]
        self.unwanted, self.article, self.framing = [False], [False], [False]
        self.labelled = bool(SEMANTIC.search(source))
        block, stack, opened = 0, [0], Counter()
        for text, close, name, attrs in tokens(source):
            if text is not None:
                self.add(f"w:{self.contexts[stack[-1]]}", len(text.split()), block, stack[-1], text)
                continue
            name = name.lower()
            if name in BLOCKS:
                block += 1
            if name in CONTAINERS and not close:
                if name == "p":  # a paragraph ends where the next one starts
                    while self.names[stack[-1]] == "p":
                        stack.pop()
                        opened["p"] -= 1
                stack.append(self.open(name, attrs, stack[-1]))
                opened[name] += 1
            known = name if name in BLOCKS or name in INLINE else "other"
            self.add(f"{close}{known}", 1, block, stack[-1], " " if name == "br" else "")
            if name in CONTAINERS and close and opened[name]:
                while (closed := self.names[stack.pop()]) != name:
                    opened[closed] -= 1
                opened[name] -= 1

    def add(self, key: str, n: int, block: int, container: int, piece: str) -> None:
        self.items.append((key, n, block, container))
        self.pieces.append(piece)

    def open(self, name: str, attrs: str, parent: int) -> int:
        kind = UNWANTED.get(name)
        if name not in ("html", "body"):
            kind = kind or hinted(attrs)
        inside = self.article[parent]
        content = name in ("article", "main") and kind != "comments"
        if content or (kind == "header" and inside and not self.unwanted[parent]):
            kind = None  # the article's own heading
        self.names.append(name)
        self.parents.append(parent)
        self.unwanted.append(kind is not None or (self.unwanted[parent] and not content))
        self.article.append(content or inside)
        # menus, headers and footers at the level of the page frame the main text; other unwanted elements only interrupt it
        frame = kind in ("menu", "header", "footer") and self.names[parent] in ("page", "html", "body")
        self.framing.append(self.unwanted[-1] and (self.framing[parent] if self.unwanted[parent] else frame))
        if self.unwanted[-1]:
            context = kind or self.contexts[parent]
        elif self.article[-1]:
            context = "article"
        else:  # plain containers of pages that mark an article are told from those of pages that do not
            context = f"{name}{'' if self.labelled else '?'}"
        self.contexts.append(context)
        return len(self.names) - 1

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First and last item of the contiguous run with the largest score; one linear scan.

        Unwanted elements are left out of the text, so they score nothing, however long, unless they frame it.
        """
        best = (0.0, 0, -1)
        score, start = 0.0, 0
        for at, (key, n, _, c) in enumerate(self.items):
            if self.unwanted[c] and not self.framing[c]:
                continue
            if score <= 0:
                score, start = 0.0, at
            score += n * weight(weights, key)
            if score > best[0]:
                best = (score, start, at)
        return best[1:]

    def text(self, weights: dict[str, float]) -> str:
        first, last = self.region(weights)
        used = {c for key, n, _, c in self.items[first : last + 1] if key[:2] == "w:" and n and not self.unwanted[c]}
        wanted = self.within(self.root(used)) if used else None
        out: dict[int, list[str]] = {}
        for at, (_, _, block, c) in enumerate(self.items):
            if self.unwanted[c] or not (first <= at <= last or wanted and wanted[c]):
                continue
            if self.pieces[at]:
                out.setdefault(block, []).append(self.pieces[at])
        blocks = (" ".join(entities.unescape("".join(p)).split()) for p in out.values())
        return "\n\n".join(b for b in blocks if b)

    def root(self, used: set[int]) -> int:
        """The innermost element around all of `used`; inside an article, the article."""
        # elements are numbered as they open, so what holds the first and the last holds all between

        def path(c: int) -> list[int]:
            out = []
            while c >= 0:
                out.append(c)
                c = self.parents[c]
            return out[::-1]

        common = [a for a, b in zip(path(min(used)), path(max(used))) if a == b]
        for c in reversed(common):
            if self.names[c] in ("article", "main") and not self.unwanted[c]:
                return c
        return common[-1]

    def within(self, root: int) -> list[bool] | None:
        """Which elements lie inside `root`; None when it is the page itself, which has no end to snap to."""
        if self.names[root] in ("page", "html", "body"):
            return None
        inside = []
        for c, parent in enumerate(self.parents):
            inside.append(c == root or parent >= 0 and inside[parent])
        return inside


def weight(weights: dict[str, float], key: str) -> float:
    return weights.get(key, 1.0 if key[:2] == "w:" else -0.5)


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Log-odds of every key inside and outside the article, from all pages that mark one.

    A page labels itself by an `article` or `main` element. Words of wanted
    contexts score positive, those of unwanted ones and all tags negative.
    Keys are made of known names, so a few hundred rows reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for b in batches:
            for source in b.column("html").to_pylist():
                page = Page(source or "")
                if page.labelled:
                    for key, n, _, c in page.items:
                        (inside if page.article[c] and not page.unwanted[c] else outside)[key] += n
        keys = sorted(inside.keys() | outside.keys())
        columns = [pa.array(keys, pa.string())] + [pa.array([x[k] for k in keys], pa.int64()) for x in (inside, outside)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_in", "n_out"])

    counted = pages.select("html").mapInArrow(work, "key string, n_in long, n_out long")
    weights = {}
    for key, n_in, n_out in counted.groupBy("key").agg(F.sum("n_in"), F.sum("n_out")).collect():
        odds = log((n_in + 1) / (n_out + 1))
        if key[:2] == "w:":
            weights[key] = max(-4.0, min(4.0, odds)) if n_in or n_out else 1.0
        else:
            weights[key] = -max(0.5, min(6.0, -odds))
    for kind in HINTS:
        weights[f"w:{kind}"] = min(-1.0, weights.get(f"w:{kind}", -1.0))
    return weights


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`(page_id, url, text)`: the main text of every page.

    Words score positive and tags negative; the best contiguous run is found by
    a linear scan and snapped to the element around it. Unwanted elements
    inside it (menus, adverts, forms, comments and so on) neither end it nor
    stay in the text. Blocks
    are unescaped, white space inside one becomes a single space, and blocks
    are joined by a blank line. A null, empty or text-free page gives the empty
    text; ids and urls pass through, nulls included; extra columns are ignored;
    rows that repeat give equal rows; an empty table gives an empty table.
    Each page is read by itself: nothing is shuffled but the key counts.
    """
    weights = learn_weights(pages) if weights is None else weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([Page(s or "").text(weights) for s in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), texts], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string")
