"""Chat formatting by grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn, the rendered text is parsed again by a deterministic parser, and the turns it
recovers are compared with the source. Where they differ, the turns that hold conflicting content are escaped and the
comparison is made again; it always succeeds then, as an escaped text holds no control string.

Grammar: conversation = turn*; turn = "[INST]" text "[/INST]" (user) | "<s>" text "</s>" (assistant)
| "<<SYS>>" role "\\n" text "<</SYS>>" (any other role, percent-encoded).
Escaping puts one backslash after the first character of a control string, also of one that holds backslashes there
already; unescaping takes one away. So the two are inverse for every text.

Edge cases: a null text or role is empty; turns are ordered by turn, then role, then text, nulls first, and repeated rows
stay; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
A conversation is one value in the output, so its text is bounded by what one Spark string may hold (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>"
CONFLICT = r"(\[(?=\\*/?INST\])|<(?=\\*(?:/?s>|</?SYS>>)))"
ESCAPED = r"(\[(?=\\+/?INST\])|<(?=\\+(?:/?s>|</?SYS>>)))\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONFLICT, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), F.url_encode(role), F.lit("\n"), text, F.lit("<</SYS>>")))
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")


def parse(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds `out`, an array of (role, text, start, end): the turns recovered from the formatted text in `column`, and where
    each text stands in it (code points).

    A text that isn't of the grammar gives turns that no source has: their role is null. Marks and parts are columns
    of their own, so that each text is searched once and not again for every turn.
    """
    marked = df.withColumns({"_marks": F.regexp_extract_all(column, F.lit(CONTROL), F.lit(0)), "_parts": F.split(column, CONTROL, -1)})
    # Marks 2k and 2k+1 enclose the text of turn k, which is part 2k+1; the even parts between turns must be empty.
    cut = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_marks")), lambda i: (i % 2 == 0) & (i < F.size("_marks"))),
        lambda i: F.struct(
            F.get("_marks", i).alias("open"),
            F.coalesce(F.get("_marks", i + 1), F.lit("")).alias("close"),
            F.coalesce(F.get("_parts", i), F.lit("")).alias("between"),
            F.coalesce(F.get("_parts", i + 1), F.lit("")).alias("whole"),
        ),
    )
    pieces = marked.withColumn("_pieces", cut)
    read = F.transform(
        "_pieces",
        lambda x: F.struct(
            F.when(x["between"] != "", F.lit(None).cast("string"))
            .when((x["open"] == "[INST]") & (x["close"] == "[/INST]"), "user")
            .when((x["open"] == "<s>") & (x["close"] == "</s>"), "assistant")
            .when((x["open"] == "<<SYS>>") & (x["close"] == "<</SYS>>"), F.try_url_decode(F.substring_index(x["whole"], "\n", 1)))
            .alias("role"),
            F.when(x["open"] == "<<SYS>>", F.regexp_replace(x["whole"], r"(?s)\A[^\n]*\n", "")).otherwise(x["whole"]).alias("body"),
            (F.length(x["between"]) + F.length(x["open"]) + F.length(x["whole"])).alias("to_end"),
            F.length(x["close"]).alias("n_close"),
        ),
    )
    bodies = pieces.withColumn("_read", read)
    none = F.expr("cast(array() as array<struct<role:string,text:string,start:int,end:int>>)")
    walked = F.aggregate(
        "_read",
        F.struct(F.lit(0).alias("at"), none.alias("turns")),
        lambda a, x: F.struct(
            (a["at"] + x["to_end"] + x["n_close"]).alias("at"),
            F.concat(
                a["turns"],
                F.array(
                    F.struct(
                        x["role"].alias("role"),
                        unescape(x["body"]).alias("text"),
                        (a["at"] + x["to_end"] - F.length(x["body"])).alias("start"),
                        (a["at"] + x["to_end"]).alias("end"),
                    )
                ),
            ).alias("turns"),
        ),
        lambda a: a["turns"],
    )
    return bodies.withColumn(out, walked).drop("_marks", "_parts", "_pieces", "_read")


def same_turns(parsed: Column, source: Column) -> Column:
    plain = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return plain.eqNullSafe(source)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (recovered: role, text, start, end), escaped, identical.

    The loss mask covers [start, end) of the assistant turns.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ordered"))
    source = grouped.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = parse(source.withColumn("plain", render(F.col("source"))), "plain", "tried")
    tried = plain.withColumn("fits", same_turns(F.col("tried"), F.col("source")))
    guarded = F.transform("source", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    out = tried.select("conv_id", "source", (~F.col("fits")).alias("escaped"), F.when(F.col("fits"), F.col("plain")).otherwise(render(guarded)).alias("formatted"))
    read = parse(out, "formatted", "turns")
    return read.select("conv_id", "formatted", "turns", "escaped", same_turns(F.col("turns"), F.col("source")).alias("identical"))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


#: Fixed by the query's contract: a conversation that holds control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """Adds conversation -1: a user, then an assistant row, both saying PROBE."""
    spark = rows.sparkSession
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
