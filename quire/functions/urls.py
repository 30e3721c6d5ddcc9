"""URL functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(url: Column) -> Column:
    return F.concat(F.substring(F.sha2(url, 256), 1, 24), F.lit(".html"))


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host_key(url: Column) -> Column:
    """Lower-case host, with a port only if the URL names one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def collapse_dots(path: Column) -> Column:
    """`.` and `..` segments of an absolute path resolved."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.expr("cast(array() as array<string>)"),
        lambda a, p: F.when(p == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).when(p == ".", a).otherwise(F.array_append(a, p)),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def absolutize(base: Column, href: Column) -> Column:
    """href resolved against base."""
    root, scheme = origin(base), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", "")
    bare, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, collapse_dots(bare), tail))
        .when(bare == "", F.concat(F.regexp_replace(base, "#.*$", ""), tail))
        .otherwise(F.concat(root, collapse_dots(F.concat(folder, bare)), tail))
    )
