"""Scalar text functions as Column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import entities
from quire.functions.entities import let

#: Unicode white space, spelt out because regex dialects differ in what \s holds.
WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Characters that sites hide between words.
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{202C}\x{A0}\x{AD}\x{FEFF}]"
HEADING = r"(?i)\bChapter" + WS + r"+([0-9]+)(?:" + WS + r"*[:\-]" + WS + r"*|" + WS + r"+)?(.*)$"
#: Our own rules for what sites append to titles: pattern by rule, in order.
TITLE_SUFFIXES = (r"(?i) *\| *Example *Reader.*$", r"(?i) *[|\-] *Sample *Novels.*$", r"(?i) *- *Read *Online.*$")


def ws_collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " "))


def strip_invisible(text: Column) -> Column:
    return ws_collapse(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE + "+", " "))


def entity_decode(text: Column, closed: bool = False) -> Column:
    """Character references to characters, by name and by number; with `closed` only those that end in a semicolon."""
    return entities.decode(text, closed)


def entity_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def strip_tags(html: Column, closed: bool = False) -> Column:
    return ws_collapse(entity_decode(F.regexp_replace(html, "<[^>]+>", " "), closed))


def markup_to_text(raw: Column, closed: bool = False) -> Column:
    """Tags go only if both angle brackets occur."""
    both = lambda t: F.contains(t, F.lit("<")) & F.contains(t, F.lit(">"))
    return let(F.coalesce(raw, F.lit("")), lambda t: F.when(both(t), strip_tags(t, closed)).otherwise(ws_collapse(t)))


def heading_number(text: Column) -> Column:
    """N of "Chapter N", null if the text is no heading."""
    return F.try_to_number(F.nullif(F.regexp_extract(ws_collapse(text), HEADING, 1), F.lit("")), F.lit("9" * 18)).cast("long")


def heading_rest(text: Column) -> Column:
    return ws_collapse(F.regexp_extract(ws_collapse(text), HEADING, 2))


def title_suffix_trim(title: Column) -> Column:
    for pattern in TITLE_SUFFIXES:
        title = F.regexp_replace(title, pattern, "")
    return F.btrim(title, F.lit(" -|:;."))


#: The labels that a chapter's name may begin with, in the order in which they are taken away.
LABELS = (r"(?i)^Chapter +[0-9]+ *[-–—:] *", r"(?i)^Chapter +[0-9]+ *$", r"(?i)^Chapter +[0-9]+ +")


def title_only(raw: Column) -> Column:
    """A chapter name without its leading label and final dots."""
    raw = ws_collapse(raw)
    for pattern in LABELS:
        raw = F.regexp_replace(raw, pattern, "")
    return F.trim(F.rtrim(F.trim(raw), F.lit(".")))


def is_degraded(title: Column) -> Column:
    return F.trim(F.coalesce(title, F.lit(""))) == ""


def chapter_heading(idx: Column, title: Column) -> Column:
    label = F.concat(F.lit("Chapter "), idx.cast("string"))
    return F.when(is_degraded(title), F.concat(label, F.lit("."))).otherwise(F.concat(label, F.lit(": "), F.trim(title), F.lit(".")))


def chapter_raw_text(idx: Column, title: Column, paragraphs: Column) -> Column:
    return F.array_join(F.concat(F.array(chapter_heading(idx, title)), paragraphs), "\n\n")


def safe_filename(name: Column, default: str = "untitled") -> Column:
    clean = ws_collapse(F.regexp_replace(F.coalesce(name, F.lit("")), r'[:*?"<>|/\\]+', "_"))
    return F.coalesce(F.nullif(F.trim(F.substring(clean, 1, 120)), F.lit("")), F.lit(default))


def file_stem(title: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.replace(safe_filename(title, ""), F.lit(" "), F.lit("_")), F.lit("_")), F.lit("")), slug)
