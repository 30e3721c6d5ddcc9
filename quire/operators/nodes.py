"""Element rows of pages, for queries that join or count them, and objects that scripts assign.

Rules about titles and paragraphs read whole trees (operators.trees), which need no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scripts import assigned_object
from quire.operators import trees


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_id, parent_id, end_id, tag, attrs, own_text, text of each element; a null page has none.

    Element x lies below element n if n.node_id < x.node_id <= n.end_id. own_text is what stands directly in an element; text is all it
    holds, pieces joined by one space, white space collapsed.
    """
    own = lambda e: F.array_join(F.transform(F.filter("pieces", lambda p: p["owner"] == e["id"]), lambda p: p["text"]), " ")
    rows = F.transform(
        "elements",
        lambda e: F.struct(
            e["id"].alias("node_id"), e["parent"].alias("parent_id"), e["last"].alias("end_id"), e["tag"].alias("tag"), e["attrs"].alias("attrs"),
            own(e).alias("own_text"), trees.text_of(e).alias("text"),
        ),
    )
    return trees.parsed(pages.select("page_id", "html")).select("page_id", F.inline(rows))


def assignment(pages: DataFrame, name: str) -> DataFrame:
    """page_id, payload: the object assigned to `name` in a page's scripts; null if none."""
    return pages.select("page_id", assigned_object(F.col("html"), name).alias("payload"))
