"""Functions over script text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def repair_escapes(raw: Column) -> Column:
    """A backslash that starts no JSON escape goes."""
    return F.regexp_replace(raw, r'\\([^"\\/bfnrtu]|$)', "$1")


#: Script text in steps: strings with their escapes, braces, all else. Possessive, so that long strings need no stack.
STEPS = r""""(?:[^"\\]++|\\[\s\S])*+"?|'(?:[^'\\]++|\\[\s\S])*+'?|[{}]|[^"'{}]++"""


def assigned_object(html: Column, name: str) -> Column:
    """The object assigned to `name` in a page's scripts, up to the brace that closes it outside strings; null if there is none. Only
    the script that holds the assignment is read."""
    rest = F.nullif(F.regexp_extract(html, rf"(?s){re.escape(name)}[^=]*+=[^{{]*+(\{{.*)", 1), F.lit(""))
    own = F.regexp_replace(rest, r"(?is)</script.*$", "")
    depth = lambda t: F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
    walk = lambda s, t: F.when(s["done"], s).otherwise(
        F.struct((s["depth"] + depth(t)).alias("depth"), (s["size"] + F.length(t)).alias("size"), (s["depth"] + depth(t) == 0).alias("done"))
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    size = F.aggregate(F.regexp_extract_all(own, F.lit(STEPS), F.lit(0)), start, walk, lambda s: F.when(s["done"], s["size"]))
    return F.substring(own, F.lit(1), size)
