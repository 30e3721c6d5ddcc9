"""Pages as element trees: one row a page, parsed once, read with array functions.

`pieces` holds a page's texts in order, each with the element that it stands in; `elements` holds its elements in order, each with the places
`lo` to `hi` of the pieces that it contains and the number `last` of the last element inside it. So any element's text is a slice of
pieces, no text is stored twice however deep pages are nested, and selectors, containers and siblings need no join and no
shuffle. Script and style hold no text, comments are no part of the tree, and what stands inside HIDDEN elements is marked as not shown.
A <p> closes an open <p>; closing an element closes what is open inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("subtxt", "script", "style", "nav"))
SCHEMA = (
    "pieces array<struct<text:string,owner:int,shown:boolean>>, "
    "elements array<struct<id:int,parent:int,last:int,tag:string,attrs:map<string,string>,classes:array<string>,lo:int,hi:int,shown:boolean>>"
)
#: Pages parsed before their rows are handed on.
AT_ONCE = 100


class Tree(HTMLParser):
    """The pieces and elements of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.pieces: list[dict] = []
        self.open: list[int] = []

    def shown(self) -> bool:
        return not self.open or self.elements[self.open[-1]]["shown"]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and any(self.elements[i]["tag"] == "p" for i in self.open):
            self.handle_endtag("p")
        me, at = len(self.elements), len(self.pieces)
        own = {k: v or "" for k, v in reversed(attrs)}  # the first of equal names counts
        self.elements.append({"id": me, "parent": self.open[-1] if self.open else -1, "last": me, "tag": tag, "attrs": list(own.items()), "classes": own.get("class", "").split(), "lo": at, "hi": at, "shown": self.shown() and tag not in HIDDEN})
        if tag not in VOID:
            self.open.append(me)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.elements[self.open[k]]["tag"] == tag), None)
        if at is not None:
            self.shut(at)

    def shut(self, at: int) -> None:
        for i in self.open[at:]:
            self.elements[i].update(last=len(self.elements) - 1, hi=len(self.pieces))
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        owner = self.open[-1] if self.open else -1
        clean = " ".join(data.split())
        if clean and (owner < 0 or self.elements[owner]["tag"] not in ("script", "style")):
            self.pieces.append({"text": clean, "owner": owner, "shown": self.shown()})


REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z0-9]+;)?")


def unclosed_kept(html: str) -> str:
    """The page with each ampersand escaped that begins no character reference with a semicolon, so that it is read as text."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parsed(pages: DataFrame, closed: bool = False) -> DataFrame:
    """The pages with all their columns but html, and their pieces and elements; a null page has none of either. With `closed` only character
    references that end in a semicolon count."""
    kept = [f for f in pages.schema if f.name != "html"]
    added = StructType.fromDDL(SCHEMA)
    schema = StructType([*kept, *added])
    kinds = [f.type for f in to_arrow_schema(added)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("html")
            for lo in range(0, whole.num_rows, AT_ONCE):
                batch, trees = whole.slice(lo, AT_ONCE), []
                for html in batch.column(at).to_pylist():
                    tree = Tree()
                    tree.feed(unclosed_kept(html or "") if closed else html or "")
                    tree.close()
                    tree.shut(0)
                    trees.append(tree)
                made = [pa.array([t.pieces for t in trees], kinds[0]), pa.array([t.elements for t in trees], kinds[1])]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *made], [f.name for f in schema])

    return pages.mapInArrow(parse, schema)


def text_of(element: Column) -> Column:
    """All text that an element holds, in the page's order, pieces parted by a space."""
    return F.array_join(F.transform(F.slice("pieces", element["lo"] + 1, element["hi"] - element["lo"]), lambda p: p["text"]), " ")


def shown_text_of(element: Column) -> Column:
    """The text of an element without that of hidden elements inside it."""
    own = F.filter(F.slice("pieces", element["lo"] + 1, element["hi"] - element["lo"]), lambda p: p["shown"])
    return F.array_join(F.transform(own, lambda p: p["text"]), " ")


def attribute(element: Column, name: str) -> Column:
    """An attribute's value, however it is quoted and wherever it stands in its tag; null if missing."""
    return F.try_element_at(element["attrs"], F.lit(name))


def has_class(element: Column, name: str) -> Column:
    return F.array_contains(element["classes"], name)


#: How a (kind, name) selector tells an element: by id, tag, class, a class of a div, or a part of the class attribute.
KINDS: dict[str, Callable[[Column, str], Column]] = {
    "id": lambda e, name: F.coalesce(attribute(e, "id") == name, F.lit(False)),
    "tag": lambda e, name: e["tag"] == name,
    "class": has_class,
    "div": lambda e, name: (e["tag"] == "div") & has_class(e, name),
    "part": lambda e, name: F.contains(F.coalesce(attribute(e, "class"), F.lit("")), F.lit(name)),
}


def boxes(*tags: str) -> Column:
    """The elements that selectors can match: those with an id or a class, and those of the tags. A page has few, so a query that asks
    several selectors makes them a column first."""
    return F.filter("elements", lambda e: e["tag"].isin(*tags) | (F.size(e["classes"]) > 0) | F.map_contains_key(e["attrs"], "id"))


def chosen(selector: tuple[str, str], among: str = "elements") -> Column:
    """The elements of the column `among` that a selector matches, in order."""
    kind, name = selector
    return F.filter(among, lambda e: KINDS[kind](e, name))


def tagged(*tags: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def inside(elements: Column, root: Column) -> Column:
    """Those of the elements (or of structs with an id) that lie below the root."""
    return F.filter(elements, lambda e: (e["id"] > root["id"]) & (e["id"] <= root["last"]))


def follower(element: Column) -> Column:
    """The text behind an element: its next sibling's, or if that is empty or missing the first text behind it below the same parent, which is
    a whole sibling's or what stands between two."""
    sibling = F.get("elements", element["last"] + 1)
    beside = F.when(sibling["parent"] == element["parent"], text_of(sibling))
    piece = F.get("pieces", element["hi"])
    parent = F.get("elements", element["parent"])
    within = piece.isNotNull() & ((element["parent"] < 0) | (element["hi"] < parent["hi"]))
    holder = F.filter("elements", lambda e: (e["parent"] == element["parent"]) & (e["lo"] <= element["hi"]) & (e["hi"] > element["hi"]))
    first = F.when(piece["owner"] == element["parent"], piece["text"]).otherwise(text_of(F.get(holder, F.lit(0))))
    return F.coalesce(F.nullif(beside, F.lit("")), F.when(within, first), F.lit(""))
