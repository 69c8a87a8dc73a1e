"""The content area of one page and its blocks, worked out in the pass that parses it.

Whether an element makes a block depends on the area that is being read, so the areas of a page are scored from the inside
out: an area has the distinct blocks of the areas in it, less those that only speak for themselves further in. The smaller
set is always poured into the larger one. Dealing pages out, and all that follows, is Spark's.
"""

from __future__ import annotations

import re

import pyarrow as pa

from ..operators.merge import _INVISIBLE, squeeze
from .html_nodes import CONTAINERS, FALLBACK_ROOTS, HEADINGS, SELECTED, node_rows

# What a block and a picture are worth, and the score that an area must exceed.
PER_BLOCK, PER_MEDIA, LEAST_SCORE = 20, 30, 120
# Attributes that hold the address of a picture that is loaded late, and addresses that stand for it.
LAZY = ("data-src", "data-original", "data-original-src", "data-lazy-src")
PLACEHOLDER = re.compile(r"^data:image/svg\+xml(?:[;,]|$)|/pic_blank\.gif(?:[?#]|$)", re.I)
# A host whose addresses change from visit to visit, and what changes.
_VISITS = re.compile(r"^https?://(?:[^/?#:@]*\.)?mmbiz\.qpic\.cn(?=[/?#:]|$)", re.I)
_CHANGES = re.compile(r"^(?:tp|wxfrom|wx_lazy)(?:=|$)")

# Fixed value: the address that a page's relative ones count from.
BASE = r"""(?is)<base\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""

KINDS = {**dict.fromkeys(HEADINGS, "heading"), "li": "listItem", "blockquote": "quote", "pre": "code", "img": "image", "video": "video", "source": "video", "a": "link"}
_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
_ORIGIN = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*")
# The white space of the browser's language.
_EDGES = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _without_dots(url: str) -> str:
    origin = _ORIGIN.match(url)
    if not origin:
        return url
    path = re.match(r"[^?#]*", url[origin.end() :])[0]
    parts = path.split("/")[1:]
    if "." not in parts and ".." not in parts:
        return url
    out = [""]
    for p in parts:
        if p == "..":
            del out[max(1, len(out) - 1) :]
        elif p != ".":
            out.append(p)
    return origin[0] + "/".join(out + [""] * (parts[-1] in (".", ".."))) + url[origin.end() + len(path) :]


def absolute(href: str, base: str) -> str:
    """Addresses that start with a scheme, a host, a root, a query or a fragment are resolved; others against the base's folder."""
    if not href:
        return ""
    if _SCHEME.match(href):
        return _without_dots(href)
    origin = m[0] if (m := _ORIGIN.match(base)) else ""
    bare = re.sub(r"[?#].*$", "", base, count=1, flags=re.S)
    if href.startswith("//"):
        found = (m[0] if (m := _SCHEME.match(base)) else "") + href
    elif href.startswith("/"):
        found = origin + href
    elif href.startswith("?"):
        found = bare + href
    elif href.startswith("#"):
        found = base.partition("#")[0] + href
    else:
        found = (origin + "/" if len(bare) == len(origin) else bare[: bare.rfind("/") + 1]) + href
    return _without_dots(found)


def base_href(html: str | None) -> str:
    """The address in a page's base element, empty without one."""
    found = re.search(BASE, html or "")
    return found[1] if found else ""


def _first(attrs: dict[str, str], names: tuple[str, ...]) -> str:
    return next((attrs[n] for n in names if attrs.get(n)), "")


def image_source(attrs: dict[str, str]) -> str:
    lazy, shown = _first(attrs, LAZY), attrs.get("src", "")
    return lazy if lazy and (not shown or PLACEHOLDER.search(shown.strip(" "))) else shown or lazy


def image_key(src: str) -> str:
    """A picture's address without what changes from visit to visit, on the one host that has it."""
    if not _VISITS.match(src):
        return src
    query = [p for p in re.split("&", src.partition("?")[2].partition("#")[0]) if p and not _CHANGES.match(p)]
    return re.sub(r"[?#].*$", "", src, count=1, flags=re.S) + ("?" + "&".join(query) if query else "")


def block_of(tag: str, attrs: dict[str, str], text: str | None, base: str) -> tuple | None:
    """type, level, text, src, alt and href of the block that an element makes, if it has something to show."""
    kind = KINDS.get(tag, "paragraph")
    if kind == "image":
        src = absolute(image_source(attrs), base)
        return (kind, None, None, src, squeeze(attrs.get("alt")), None) if src else None
    if kind == "video":
        src = absolute(_first(attrs, ("src", "data-src")), base)
        name = squeeze(_first(attrs, ("title", "aria-label")) or (text if tag == "video" else "") or "Video") or "Video"
        return (kind, None, name, src, None, None) if src else None
    said = _INVISIBLE.sub("", text or "").replace("\r\n", "\n").strip(_EDGES) if kind == "code" else squeeze(text)
    if kind == "link":
        href = absolute(attrs.get("href", ""), base)
        return (kind, None, said or squeeze(href), None, None, href) if href else None
    return (kind, int(tag[1]) if kind == "heading" else None, said, None, None, None) if said else None


def _key(block: tuple) -> tuple:
    kind, level, text, src, alt, href = block
    return (kind, image_key(src), alt) if kind == "image" else (kind, level, squeeze(text), src, href)


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def scored(nodes: list[tuple], base: str) -> tuple[list[tuple | None], list[int], list[int]]:
    """Of each element what it makes, (key, worth, block, outer), where outer is the element from which on it is spoken for; and
    the score and the number of blocks of it as an area."""
    n = len(nodes)
    made: list[tuple | None] = [None] * n
    for i, (_, _, _, tag, attrs, text, own, block_below, content_below, visible, _, known_above, leaf_above) in enumerate(nodes):
        container = tag in CONTAINERS
        if visible and tag in SELECTED and not (container and (block_below or (not own and content_below))) and (block := block_of(tag, attrs, text, base)):
            worth = _units(squeeze(block[2] or block[4])) + PER_BLOCK + PER_MEDIA * (block[0] in ("image", "video"))
            made[i] = _key(block), worth, block, max(known_above, leaf_above) if container else -1

    parents, way = [-1] * n, []
    for i, row in enumerate(nodes):
        del way[row[2] :]
        parents[i] = way[-1] if way else -1
        way.append(i)
    scores, counts = [0] * n, [0] * n
    sums = [0] * n  # of what the areas in an element pass on to it
    held: list[dict[tuple, list[int]]] = [{} for _ in range(n)]  # the same by keys: how many blocks, and what one is worth
    gone: list[list[tuple]] = [[] for _ in range(n)]  # the keys that an element's areas pass on no further
    for i in range(n - 1, -1, -1):
        keys, score = held[i], sums[i]
        for key in gone[i]:
            keys[key][0] -= 1
            if not keys[key][0]:
                score -= keys.pop(key)[1]
        if made[i]:
            key, worth, _, outer = made[i]
            if key in keys:
                keys[key][0] += 1
            else:
                keys[key] = [1, worth]
                score += worth
            if outer >= 0:
                gone[outer].append(key)
        scores[i], counts[i], p, held[i] = score, len(keys), parents[i], {}
        if p < 0:
            continue
        large, small, total = (held[p], keys, sums[p]) if len(held[p]) >= len(keys) else (keys, held[p], score)
        for key, (times, worth) in small.items():
            if key in large:
                large[key][0] += times
            else:
                large[key] = [times, worth]
                total += worth
        held[p], sums[p] = large, total

    return made, scores, counts


def best_area(nodes: list[tuple], scores: list[int], counts: list[int]) -> int | None:
    """The first element of each preference counts, if it scores over LEAST_SCORE with more than one block; the earliest
    preference wins. Without one, the highest score over LEAST_SCORE among containers, the first of equals."""
    firsts: dict[int, int] = {}
    for i, row in enumerate(nodes):
        if row[9]:
            for rank in row[10]:
                firsts.setdefault(rank, i)
    best = next((i for _, i in sorted(firsts.items()) if scores[i] > LEAST_SCORE and counts[i] > 1), None)
    if best is not None:
        return best
    wide = [i for i, row in enumerate(nodes) if row[9] and row[3] in FALLBACK_ROOTS and scores[i] > LEAST_SCORE]
    return max(wide, key=lambda i: (scores[i], -i), default=None)


def blocks_in(nodes: list[tuple], made: list[tuple | None], area: int) -> list[tuple]:
    """The blocks of an area in order, the first of equal ones."""
    found = {}
    for m in (made[i] for i in range(area, nodes[area][1] + 1) if made[i] and (i == area or made[i][3] < area)):
        found.setdefault(m[0], m[2])
    return list(found.values())


def content_of(nodes: list[tuple], base: str) -> tuple[int, int, list[tuple]] | None:
    """Score, number of blocks and the blocks of a page's best area, from the rows of node_rows(); None without one."""
    made, scores, counts = scored(nodes, base)
    best = best_area(nodes, scores, counts)
    return None if best is None else (scores[best], counts[best], blocks_in(nodes, made, best))


#: A selected area with one block or none gives way to the best one, if that has more blocks than so many above it.
FEW, MORE = 1, 2


def selected_content(nodes: list[tuple], base: str, tag: str | None, nth: int | None) -> tuple[int | None, bool, list[tuple]] | None:
    """How many blocks the nth element (from 0) of a tag has, whether the best area took its place, and the blocks of the one
    that is read. Without such an element the best area; None without that too."""
    made, scores, counts = scored(nodes, base)
    best = best_area(nodes, scores, counts)
    of_tag = [i for i, row in enumerate(nodes) if row[3] == tag] if tag and nth is not None and nth >= 0 else []
    chosen = of_tag[nth] if of_tag and nth < len(of_tag) else None
    if chosen is None:
        return None if best is None else (None, False, blocks_in(nodes, made, best))
    promoted = best is not None and best != chosen and counts[chosen] <= FEW and counts[best] > counts[chosen] + MORE
    return counts[chosen], promoted, blocks_in(nodes, made, best if promoted else chosen)


def page_content(html: str | None, base: str) -> tuple[int, int, list[tuple]] | None:
    return content_of(node_rows(html), base)


_FIELDS = {"type": pa.string(), "level": pa.int32(), "text": pa.string(), "src": pa.string(), "alt": pa.string(), "href": pa.string()}


def block_arrays(pages: list[list[tuple] | None]) -> pa.Array:
    """Each page's blocks as a list of structs, null for None."""
    every = [b for blocks in pages for b in blocks or ()]
    columns = list(zip(*every)) or [()] * len(_FIELDS)
    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _FIELDS.values())], names=list(_FIELDS))
    ends = [0]
    for blocks in pages:
        ends.append(ends[-1] + len(blocks or ()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([blocks is None for blocks in pages]))
