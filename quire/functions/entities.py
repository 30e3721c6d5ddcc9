"""Character references as HTML defines them, decoded inside the JVM.

The text is split at its ampersands; of each piece the reference at its start is replaced: a number by its code point, a name by
what HTML's list of names (the standard library's) says. Names of the list that need no semicolon are found at the start of a longer
run of letters as well, the longest first. What is no reference stays, ampersand included.

With `closed` a reference must end in a semicolon, and is text without one: so the queries' statements read pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that stand for nothing by themselves, as HTML says.
NO_CHARACTER = "[\x01-\x08\x0b\x0e-\x1f\x7f-\x9f﷐-﷯]"
REPLACEMENT = "�"


def windows() -> dict[int, str]:
    """Numbers from 128 to 159 mean what they mean in Windows-1252; five of them have no meaning there and stay."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


@cache
def closed_names() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The names that end in a semicolon, and their characters."""
    pairs = sorted((k, v) for k, v in html5.items() if k.endswith(";"))
    return tuple(k for k, _ in pairs), tuple(v for _, v in pairs)


@cache
def open_names() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The names that need no semicolon, longest first."""
    pairs = sorted(((k, v) for k, v in html5.items() if not k.endswith(";")), key=lambda p: (-len(p[0]), p[0]))
    return tuple(k for k, _ in pairs), tuple(v for _, v in pairs)


def table(names: tuple[str, ...], characters: tuple[str, ...]) -> Column:
    """The names by their first letter, as a map of short maps: a lookup compares some fifty keys in each. One constant, so
    that the plan holds it as such and not as thousands of parts."""
    first: dict[str, dict[str, str]] = {}
    for name, char in zip(names, characters, strict=True):
        first.setdefault(name[0], {})[name] = char
    return F.from_json(F.lit(json.dumps(first)), "map<string,map<string,string>>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times, and computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looked_up(known: Column, name: Column) -> Column:
    return F.try_element_at(F.try_element_at(known, F.substring(name, 1, 1)), name)


def character(number: Column) -> Column:
    """The character of a code point, as a numeric reference means it; empty for those that stand for none."""
    special = windows()
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in special.items() for x in pair)), number)
    utf32 = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    noncharacter = F.pmod(number, F.lit(0x10000)) >= 0xFFFE
    plain = F.when(noncharacter | utf32.rlike(NO_CHARACTER), "").otherwise(utf32)
    impossible = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(impossible, REPLACEMENT).when(number.between(0x80, 0x9F), known).otherwise(plain)


def numbered(digits: Column, base: int) -> Column:
    """The number of a run of digits; one of more digits than any code point has is beyond them all."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) > 7, 0x110000).when(short == "", 0).otherwise(F.conv(short, base, 10).cast("int"))


def reference(piece: Column, closed: bool = False) -> Column:
    """A piece of text behind an ampersand, its reference decoded."""
    end = ";" if closed else ""
    decimal, hexadecimal = F.regexp_extract(piece, f"^#([0-9]+){end}", 1), F.regexp_extract(piece, f"^#[xX]([0-9a-fA-F]+){end}", 1)
    name = F.regexp_extract(piece, "^[a-zA-Z][^\\t\\n\\f <&#;]{0,31};", 0)
    start = F.regexp_extract(piece, f"^(?:{'|'.join(open_names()[0])})", 0)
    rest = lambda size: F.substring(piece, size + 1, F.length(piece))
    # Null where the piece begins with no such reference.
    return F.coalesce(
        F.when(decimal != "", F.concat(character(numbered(decimal, 10)), F.regexp_replace(piece, "^#[0-9]+;?", ""))),
        F.when(hexadecimal != "", F.concat(character(numbered(hexadecimal, 16)), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]+;?", ""))),
        F.concat(looked_up(table(*closed_names()), name), rest(F.length(name))),
        *([] if closed else [F.concat(looked_up(table(*open_names()), start), rest(F.length(start)))]),
        F.concat(F.lit("&"), piece),
    )


def decode(text: Column, closed: bool = False) -> Column:
    """The text with all its character references decoded once; null stays null."""
    later = lambda pieces: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: reference(p, closed))
    decoded = lambda t: let(F.split(t, "&", -1), lambda pieces: F.concat(pieces[0], F.array_join(later(pieces), "")))
    return let(text, lambda t: F.when(~F.contains(t, F.lit("&")), t).otherwise(decoded(t)))
