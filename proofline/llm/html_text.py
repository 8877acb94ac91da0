"""Main text of web pages by tag-path ratios.

Each piece of text has a path of tags from the root. Per path the characters,
punctuation marks and pieces are added up; the ratios of both to the pieces are
smoothed along the page, fused into one weight, and paths at or above a share of
the heaviest one are content. Pieces on these paths, and those beside them in
the same content element (headings, short lines), make up the text. A group of
links in that element whose path is too light and that stands beside no heavy
path, is a menu and left out. Elements that say themselves that they are no
article (navigation, forms, adverts, comments and so on) are left out before. A
class or id name, or a form, does not count where the element holds the only
article, or on a page without one most of the text: then it is a wrapper.

Character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined by a line feed in page order. A missing or empty
page, or one of markup only, has the empty text. Repeated pages stay. Broken
markup is read as far as it goes: an end without a beginning is passed over,
and what is never closed ends with the page. Every page is read as a whole and on its own, so hot
hosts need no special care. Other columns pass through; `text` and `n_chars` are
replaced.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a beginning element ends, if it stands open within the nearest of the elements after the bar.
ENDS = {
    **{t: (("p",), ("button", "td", "th", "table")) for t in BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
ASIDE = frozenset("nav header footer aside form button select menu dialog search fieldset label head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: Words in class and id names of elements that are not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination header masthead footer sidebar aside widget rail "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond".split()
)
#: Of these, the words of readers' comments, whose element is never taken for a wrapper.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements that group others; a list of links is judged within the nearest one.
GROUPS = frozenset("article body center details dialog div dl main menu ol section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、·()\"“”«»-]")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+")

#: Share of the heaviest path from which a path is content, and how far a piece smooths its neighbours.
SHARE = 0.2
SMOOTH = (0.25, 0.5, 0.25)
#: Share of the content's characters that its element must hold.
HOLDS = 0.8
#: Share of a group's characters in links, and links on a path, from which a group is a menu.
LINKED = 0.8
LINKS = 3


def _beside(tag: str, attributes: str) -> str:
    """Whether an element says that it is not part of the article: "yes", "wrapper" if it may still hold the article, or ""."""
    if tag in ASIDE:
        return "wrapper" if tag == "form" else "yes"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    said = "yes" if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) else ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            words = HINTS.intersection(_NAME.findall(spaced))
            if words:
                said = said or ("wrapper" if READERS.isdisjoint(words) else "yes")
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return "yes"
    return said


class Piece:
    """A piece of text: its path, its block, the nearest group, and whether it stands in a link.

    `aside` and `named` are the nearest element set aside and the nearest article, by number from 1 on, 0 if there is none.
    """

    __slots__ = ("aside", "block", "group", "link", "named", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], block: int, link: bool, aside: int, named: int, group: int):
        self.text, self.path, self.block, self.link, self.aside, self.named, self.group = text, path, block, link, aside, named, group


def _opened(out: list[Piece], asides: list[tuple[int, bool]], named: list[int]) -> list[Piece]:
    """The pieces that stand in no element set aside, once wrappers are opened.

    `asides` has for each element the one around it and whether it may be a wrapper; `named` has for each article the element
    set aside around it.
    """

    def chain(aside: int) -> list[int]:
        found = []
        while aside:
            found.append(aside)
            aside = asides[aside][0]
        return found

    sizes: dict[int, int] = {}
    own: dict[int, int] = {}
    for p in out:
        size = len(p.text.strip())
        sizes[p.aside] = sizes.get(p.aside, 0) + size
        if p.named and p.aside == named[p.named]:
            own[p.named] = own.get(p.named, 0) + size
    lifted = {0}
    if not any(size and not named[n] for n, size in own.items()):
        inside = [n for n, size in own.items() if size and all(asides[a][1] for a in chain(named[n]))]
        most = max(sizes, key=sizes.get, default=0)
        if inside:
            lifted.update(chain(named[max(inside, key=lambda n: (own[n], -n))]))
        elif 2 * sizes.get(most, 0) > sum(sizes.values()) and all(asides[a][1] for a in chain(most)):
            lifted.update(chain(most))
    return [p for p in out if p.aside in lifted]


def pieces(page: str) -> list[Piece]:
    """The pieces of text of a page that no element sets aside, in page order."""
    out: list[Piece] = []
    # per open element: tag, and what was nearest before it of the elements set aside, the articles and the groups
    stack: list[tuple[str, int, int, int]] = []
    asides: list[tuple[int, bool]] = [(0, True)]
    named: list[int] = [0]
    path: tuple[str, ...] = ()
    at, block, link, groups = 0, 0, 0, 0
    aside, name, group = 0, 0, 0

    def close(to: int) -> None:
        nonlocal path, block, aside, link, name, group
        while len(stack) > to:
            tag, aside, name, group = stack.pop()
            link -= tag == "a"
            block += tag in BLOCK
        path = path[:to]

    while at < len(page):
        found = _TOKEN.match(page, at)
        at = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text.startswith("<![CDATA["):
                text = text[9:].removesuffix("]]>")
            elif text[:2] in ("<!", "<?") and len(text) > 1:
                continue
            elif "&" in text:
                text = html.unescape(text)
            if text:
                out.append(Piece(text, path, block, link > 0, aside, name, group))
            continue
        tag = tag.lower()
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                # an end of an inline element does not close blocks
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            else:
                block += tag in BLOCK
            continue
        ended = ENDS.get(tag)
        if ended:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended[1]:
                    break
                if stack[i][0] in ended[0]:
                    close(i)
                    break
        if tag in VOID:
            if tag == "br" and out:
                out.append(Piece(" ", path, block, link > 0, aside, name, group))
            block += tag in BLOCK
            continue
        if found[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            stack.append((tag, aside, name, group))
            path = (*path, tag)
            continue
        stack.append((tag, aside, name, group))
        path = (*path, tag)
        said = _beside(tag, found[3])
        if said:
            asides.append((aside, said == "wrapper"))
            aside = len(asides) - 1
        if tag in ("article", "main"):
            named.append(aside)
            name = len(named) - 1
        if tag in GROUPS:
            groups += 1
            group = groups
        link += tag == "a"
        block += tag in BLOCK
    return _opened(out, asides, named)


def content(found: list[Piece]) -> list[Piece]:
    """The pieces that are content, by the weights of their paths."""
    full = [p for p in found if p.text.strip()]
    if not full:
        return []
    sums: dict[tuple[str, ...], list[float]] = {}
    for p in full:
        own = sums.setdefault(p.path, [0.0, 0.0, 0.0, 0.0])
        size = len(p.text.strip())
        own[0] += 0 if p.link else size
        own[1] += 0 if p.link else len(PUNCTUATION.findall(p.text))
        own[2] += 1
        own[3] += size
    ratios = [(sums[p.path][0] / sums[p.path][2], sums[p.path][1] / sums[p.path][2]) for p in full]
    before, here, after = SMOOTH
    weights: dict[tuple[str, ...], list[float]] = {}
    for i, p in enumerate(full):
        low, high = ratios[max(0, i - 1)], ratios[min(len(full) - 1, i + 1)]
        length, marks = (before * low[k] + here * ratios[i][k] + after * high[k] for k in (0, 1))
        weights.setdefault(p.path, []).append((length * (1 + marks)) ** 0.5)
    fused = {path: sum(w) / len(w) for path, w in weights.items()}
    heaviest = max(fused.values())
    chosen = {path for path, w in fused.items() if w >= SHARE * heaviest}
    # the deepest element that holds the content; below the page itself it also holds what is short in it
    total = sum(sums[p][3] for p in chosen)
    holder: tuple[str, ...] = ()
    named = [p[: i + 1] for p in sums for i, tag in enumerate(p) if tag in ("article", "main")]
    if named:
        holder = max(set(named), key=lambda h: (sum(sums[p][3] for p in sums if p[: len(h)] == h), -len(h)))
        chosen = {p for p in chosen if p[: len(holder)] == holder} or {p for p in sums if p[: len(holder)] == holder}
    else:
        depth = 1
        while True:
            heads: dict[tuple[str, ...], float] = {}
            for p in chosen:
                if len(p) >= depth:
                    heads[p[:depth]] = heads.get(p[:depth], 0) + sums[p][3]
            best = max(heads, key=heads.get, default=None)
            if best is None or heads[best] < HOLDS * total or best[-1] not in BLOCK or best[-1] == "p":
                break
            holder, depth = best, depth + 1
    inside = len(holder) > 2 or (named and holder)
    # menus: groups of links on paths of links alone, without a piece on a content path
    linked: dict[int, list[int]] = {}
    heavy: set[int] = set()
    for p in full:
        size, links = len(p.text.strip()), p.link and sums[p.path][0] == 0 and sums[p.path][2] >= LINKS
        own = linked.setdefault(p.group, [0, 0])
        own[0] += size if links else 0
        own[1] += size
        if p.path in chosen:
            heavy.add(p.group)
    menus = {g for g, (links, size) in linked.items() if g not in heavy and links and links >= LINKED * size}
    return [p for p in found if p.path in chosen or (inside and p.path[: len(holder)] == holder and p.group not in menus)]


def main_text(page: str | None) -> str:
    """The main text of a page, one line for each block."""
    blocks: list[tuple[int, list[str]]] = []
    for p in content(pieces(page or "")):
        if not blocks or blocks[-1][0] != p.block:
            blocks.append((p.block, []))
        blocks[-1][1].append(p.text)
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n".join(line for line in lines if line)


def extract(df: DataFrame, source: str = "html") -> DataFrame:
    """The frame without its page source, with `text` and `n_chars` (code points) instead."""
    kept = [c for c in df.columns if c not in (source, "text", "n_chars")]
    fields = [f for f in df.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*kept, "text", "n_chars"],
                )

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").cast("string").alias("__page")).mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
