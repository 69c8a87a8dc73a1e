"""Documents of nested blocks as a row for each block that isn't in another one's care, with what belongs to it.

Which element belongs to which block is known where a page is parsed, from the elements around it; what a block becomes is
decided by Spark.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

from ..operators.merge import squeeze
from .html_marks import Marks

# The classes of the family's blocks.
ROOT, ZONE, LINE, CODE_ZONE = "docx-page-block", "zone-container", "ace-line", "code-block-zone-container"
QUOTE, TABLE, CELL, CODE, IMAGE, ORDERED, BULLET, TEXT = (f"docx-{x}-block" for x in ("quote_container", "table", "table_cell", "code", "image", "ordered", "bullet", "text"))
MANAGED = frozenset((QUOTE, TABLE, CELL, CODE))

_STRINGS, _ATTRS = T.ArrayType(T.StringType()), T.ArrayType(T.MapType(T.StringType(), T.StringType()))
_CHILD = T.StructType([
    T.StructField("pre", T.IntegerType()), T.StructField("record", T.StringType()), T.StructField("block_id", T.StringType()), T.StructField("picture", T.BooleanType()), T.StructField("lines", _STRINGS), T.StructField("pictures", _ATTRS),
])
_CELL = T.StructType([T.StructField("nested", _STRINGS), T.StructField("own", _STRINGS), T.StructField("plain", T.StringType())])
#: lines: of the block's own zones, as inline Markdown; code: lines of code; children: blocks directly in a quote; cells: of a
#: table, by row.
FIELDS = [
    T.StructField("pre", T.IntegerType()), T.StructField("classes", _STRINGS), T.StructField("record", T.StringType()), T.StructField("block_id", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("lines", _STRINGS), T.StructField("code", _STRINGS), T.StructField("pictures", _ATTRS), T.StructField("children", T.ArrayType(_CHILD)), T.StructField("cells", T.ArrayType(T.ArrayType(_CELL))),
]


class _Around(NamedTuple):
    """The elements around an element, -1 for none: the nearest block, the first root, the nearest zone and the block around
    that, and so on; how many list blocks, and whether a block below the root has the element in its care."""

    block: int = -1
    root: int = -1
    depth: int = 0
    managed: bool = False
    zone: int = -1
    zone_block: int = -1
    code_zone: int = -1
    code: int = -1
    image: int = -1
    table: int = -1
    row: int = -1


def block_rows(tree: Marks) -> list[tuple]:
    """The values of FIELDS of each block below the root that no other one has in its care."""
    n = len(tree.tags)
    inner: list[_Around] = [_Around()] * n  # what is around the children of each element
    blocks, children, lines, code, pictures, cells = [], {}, {}, {}, {}, {}
    zones, lined = [], set()
    for i in range(n):
        p, names, tag, attrs = tree.parents[i], tree.names[i], tree.tags[i], tree.attrs[i]
        a = inner[p] if p >= 0 else inner[i]
        if tag == "img" and a.image >= 0:
            pictures.setdefault(a.image, []).append(list(attrs.items()))
        if tag in ("td", "th") and a.table >= 0 and a.row >= 0:
            cells.setdefault(a.table, {}).setdefault(a.row, []).append(i)
        if LINE in names:
            if a.zone >= 0:
                lined.add(a.zone)
                if "data-slate-editor" in tree.attrs[a.zone]:
                    lines.setdefault(a.zone_block, []).append((i, tree.inside(i)))
            if a.code_zone >= 0:
                code.setdefault(a.code, []).append(tree.inside(i))
        if ZONE in names and "data-slate-editor" in attrs:
            zones.append((i, a.block))
        of_block = "block" in names and bool(attrs.get("data-block-id"))
        if of_block:
            blocks.append((i, a))
            children.setdefault(a.block, []).append(i)
            a = a._replace(
                block=i, root=i if a.root < 0 and ROOT in names else a.root, depth=a.depth + (ORDERED in names or BULLET in names), managed=a.managed or (a.root >= 0 and not MANAGED.isdisjoint(names)),
                code=i if CODE in names else a.code, image=i if IMAGE in names else a.image,
            )
        if names or tag == "tr":
            if ZONE in names:
                a = a._replace(zone=i, zone_block=inner[p].block if p >= 0 else -1)
            if CODE_ZONE in names:
                a = a._replace(code_zone=i)
            if TABLE in names:
                a = a._replace(table=i)
            if tag == "tr":
                a = a._replace(row=i)
        inner[i] = a
    # a zone without lines counts as one of its plain text
    for zone, block in zones:
        if zone not in lined:
            lines.setdefault(block, []).append((zone, squeeze(tree.text(zone))))
    said = lambda i: [text for _, text in sorted(lines.get(i, ()))]
    named = lambda i: (tree.attrs[i].get("data-record-id") or tree.attrs[i]["data-block-id"], tree.attrs[i]["data-block-id"])

    def child(i: int) -> dict:
        record, block_id = named(i)
        return {"pre": i, "record": record, "block_id": block_id, "picture": IMAGE in tree.names[i], "lines": said(i), "pictures": pictures.get(i, [])}

    def cell(i: int) -> dict:
        return {"nested": [x for c in children.get(i, ()) for x in said(c)], "own": said(i), "plain": squeeze(tree.text(i))}

    return [
        (
            i, tree.names[i], *named(i), a.depth, said(i), code.get(i), pictures.get(i, []), [child(c) for c in children.get(i, ())] if QUOTE in tree.names[i] else [],
            [[cell(c) for c in row] for row in cells[i].values()] if i in cells else None,
        )
        for i, a in blocks
        if a.root >= 0 and not a.managed
    ]


def page_block_rows(html: str | None, url: str | None = None) -> list[tuple]:
    tree = Marks(tight=False)
    tree.finish(html)
    return block_rows(tree)
