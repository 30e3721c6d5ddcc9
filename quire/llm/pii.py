"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans are found by pattern. The corpus tells how strongly the other terms of a document reveal its protected entities: with
document counts n(c) of entity c, n(t) of term t, n(c,t) of both, over whole texts, and N documents,
PMI(c;t) = log2(N n(c,t) / (n(c) n(t))) and IC(c) = log2(N / n(c)). Their ratio is at most 1, which it reaches when t never
occurs without c. A term with a ratio of `generalise_at` or more, seen with c in `min_support` documents, is replaced by its
class wherever it stands in a document that holds c; with `remove_at` or more it is removed. Base spans are always replaced by their kind.

Copied text tells nothing: all its rare words occur with the entity only because it was copied. So a text supports a pair only by a
place of the term outside passages copied from another text with the entity: PASSAGE terms in a row, more than half of them
different, that both hold. Of the texts that share a passage, one (of smallest hash) supports by it. No document is left out: each loses all its terms that are told, however many.

Edge cases: a null text is empty and has no spans; documents without base spans have no added ones; identical rows and texts count
one by one in all counts, once for the support, and each keep their result; rows that share a doc_id but not the text are told
apart; of overlapping spans, and of labels for one term, the first in order stands; a text of any length is one value, searched whole; other
columns pass through unchanged, whatever their names, but one named like the column of spans is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: The kinds in their order, and the patterns. Possessive where the base pattern can't gain by giving back, and
#: anchored at the start of a run, so that long runs of one class cost linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: So many terms in a row, more than half of them different, make a passage.
PASSAGE = 20
NO_SPANS = "cast(array() as array<struct<start:int,end:int,hit:string>>)"


def spans_of(text: Column, pattern: str | Column) -> Column:
    """All matches in order as (start, end, hit), in code points: gaps between matches and their lengths add up."""
    hits, gaps = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # There is one gap more than there are hits; the step of the last has no hit.
    steps = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), a["spans"])
            .otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit")))))
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )


def valid_ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid_card(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, r"[\x20-]", ""))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 0, doubled(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.when(F.length(digits) <= 19, total % 10 == 0).otherwise(False)


def valid_phone(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """The valid base spans of each kind. Cheap tests come first: most texts hold no such character."""
    none, digit = F.expr(NO_SPANS), text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(spans_of(text, IP), lambda s: valid_ip(s["hit"]))).otherwise(none),
        "card": F.when(digit, F.filter(spans_of(text, CARD), lambda s: valid_card(s["hit"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans_of(text, PHONE), lambda s: valid_phone(s["hit"]))).otherwise(none),
    }


def entity(rank: Column, hit: Column) -> Column:
    """The protected value: e-mail addresses in lower case, numbers by their digits."""
    return F.concat(rank.cast("string"), F.lit(":"), F.when(rank == 0, F.lower(hit)).when(rank == 1, hit).otherwise(F.regexp_replace(hit, "[^0-9]", "")))


def with_rank(spans: Column, n: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), s["end"].alias("end"), s["hit"].alias("hit")))


def found(docs: DataFrame) -> DataFrame:
    """docs with _key (of doc_id and text), _text and _base: array of (start, rank, end, hit), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({"_text": text, "_key": F.xxhash64("doc_id", text)})
    rows = rows.withColumns({f"_{k}": c for k, c in base_spans(F.col("_text")).items()})
    ranked = [with_rank(F.col(f"_{k}"), n) for n, k in enumerate(KINDS)]
    return rows.withColumn("_base", F.array_sort(F.concat(*ranked))).drop(*(f"_{k}" for k in KINDS))


def held_terms(hits: DataFrame) -> DataFrame:
    """_key, _t (of the text), copies, entities, words: the distinct entities of each document with base spans, and all terms of its whole text in order."""
    words = F.filter(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    one = hits.groupBy("_key").agg(F.count("*").alias("copies"), F.first(F.struct("_text", "_base")).alias("x")).select("_key", "copies", "x.*")
    entities = F.array_distinct(F.transform("_base", lambda b: entity(b["rank"], b["hit"])))
    return one.select("_key", F.xxhash64("_text").alias("_t"), "copies", entities.alias("entities"), words.alias("words"))


def term_documents(docs: DataFrame) -> DataFrame:
    """h, n_t: in how many documents each term occurs, over all whole texts (rows that are alike count once a copy)."""
    terms = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return docs.select(F.explode(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))).alias("h")).groupBy("h").agg(F.count("*").alias("n_t"))


def disclosing(docs: DataFrame, held: DataFrame, generalise_at: float, remove_at: float, min_support: int) -> DataFrame:
    """entity, term, removed: the pairs beyond the thresholds, copied or not."""
    held = held.groupBy("_t").agg(F.sum("copies").alias("copies"), F.first("entities").alias("entities"), F.first(F.array_distinct("words")).alias("terms"))
    own = held.select("copies", F.explode("entities").alias("entity"))
    entities = own.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count("*").alias("support"))
    # Most entities occur in one document; its terms have no support, so they are never listed.
    entities = stage(entities.filter(F.col("support") >= min_support).select("entity", "n_c"), "entities")
    each = held.select("copies", "terms", F.explode("entities").alias("entity")).join(entities, "entity", "left_semi")
    # Summed up in each task first, so that an entity of many documents is no hot key: groups are pairs.
    pairs = each.select("copies", "entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("support")).filter(F.col("support") >= min_support)
    total = docs.agg(F.count("*").alias("n"))
    scored = (
        pairs.join(entities, "entity")
        .withColumn("h", F.xxhash64("term"))
        .join(term_documents(docs), "h")
        .join(F.broadcast(total))  # one row
        .withColumn("ic", F.log2(F.col("n") / F.col("n_c")))
        .withColumn("ratio", F.when(F.col("ic") > 0, F.log2(F.col("n") * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.col("ic")).otherwise(0.0))
    )
    return scored.filter(F.col("ratio") >= generalise_at).select("entity", "term", (F.col("ratio") >= remove_at).alias("removed"))


def passages(hashes: Column) -> Column:
    """Each passage of a stored array of hashed terms, as (at, h): its place, from 1, and its hash."""
    part = lambda i: F.slice(hashes, i, F.lit(PASSAGE))
    each = F.transform(F.sequence(F.lit(1), F.size(hashes) - PASSAGE + 1), lambda i: F.struct(i.alias("at"), F.when(2 * F.size(F.array_distinct(part(i))) > PASSAGE, F.xxhash64(part(i))).alias("h")))
    return F.when(F.size(hashes) >= PASSAGE, F.filter(each, lambda p: p["h"].isNotNull()))


def outside(words: Column, starts: Column) -> Column:
    """The distinct terms that stand outside the passages at `starts` (sorted)."""
    edges = F.concat(F.array(F.lit(1 - PASSAGE)), starts, F.array(F.size(words) + 1))
    n = F.size(edges) - 1
    gap = lambda a, b: F.slice(words, a + PASSAGE, F.greatest(b - a - PASSAGE, F.lit(0)))
    return F.array_distinct(F.flatten(F.zip_with(F.slice(edges, F.lit(1), n), F.slice(edges, F.lit(2), n), gap)))


def supported(told: DataFrame, held: DataFrame, min_support: int) -> DataFrame:
    """Those of the told pairs that `min_support` texts hold at places which aren't copied from one another."""
    texts = held.dropDuplicates(["_t"])
    pairs = texts.select("_t", F.explode("entities").alias("entity")).join(told.select("entity", "term"), "entity")
    pairs = stage(pairs.join(texts.select("_t", F.explode(F.array_distinct("words")).alias("term")), ["_t", "term"], "left_semi"), "pairs")
    cases = pairs.select("_t", "entity").distinct()
    # Only texts with a told term are cut into passages. Hashes are stored, as an expression would be computed anew at each place.
    own = stage(texts.select("_t", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).join(cases.select("_t").distinct(), "_t", "left_semi"), "own")
    found = stage(own.select("_t", F.inline(passages(F.col("hashes")))).join(cases, "_t"), "passages")
    shared = found.groupBy("entity", "h").agg(F.min("_t").alias("first"), F.max("_t").alias("last")).filter("first < last").select("entity", "h", "first")
    copied = found.join(shared, ["entity", "h"]).filter(F.col("_t") != F.col("first")).groupBy("_t", "entity").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    starts = F.coalesce("starts", F.expr("cast(array() as array<int>)"))
    free = cases.join(copied, ["_t", "entity"], "left").join(own.select("_t", "words"), "_t").select("_t", "entity", F.explode(outside(F.col("words"), starts)).alias("term"))
    support = free.join(pairs, ["_t", "entity", "term"], "left_semi").groupBy("entity", "term").count().filter(F.col("count") >= min_support)
    return told.join(support, ["entity", "term"], "left_semi")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, label) replaced; of overlapping spans the first one's label stands."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["label"])).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )


def sanitise(docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, min_support: int = 2, spans: str | None = "pii_spans") -> DataFrame:
    """The documents with all their columns, text sanitised, and, if it is to have a name, a column of spans: array of (start, rank, end,
    kind, label), sorted. Kinds are those of KINDS, then "term" for what the method adds."""
    columns = [c for c in docs.columns if c != spans]
    # The user's columns travel in one, so that their names can't clash with those used here.
    marked = found(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")).alias("_row")))
    hits = stage(marked.filter(F.size("_base") > 0), "hits")  # documents with personal data only
    held = stage(held_terms(hits), "held")
    told = supported(stage(disclosing(docs, held, generalise_at, remove_at, min_support), "told"), held, min_support)
    # A term told by two entities is removed if either asks for it. Only a document's own terms are told: all pairs of others would
    # be more than it holds.
    mine = held.select("_key", F.explode("entities").alias("entity")).join(told, "entity")
    terms = mine.groupBy("_key", "term").agg(F.max("removed").alias("removed"))
    terms = terms.join(held.select("_key", F.explode(F.array_distinct("words")).alias("term")), ["_key", "term"], "left_semi")
    listed = terms.groupBy("_key").agg(F.collect_list("term").alias("_terms"), F.collect_list(F.when(F.col("removed"), F.col("term"))).alias("_removed"))
    # Every place of these terms, as whole words, but not inside base spans.
    text, pattern = F.col("_text"), F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    clear = F.filter(spans_of(text, pattern), lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    label = lambda s: F.when(F.array_contains("_removed", F.lower(s["hit"])), "").when(s["hit"].rlike(r"^\p{N}+$"), "[NUMBER]").otherwise("[TERM]")
    span = lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("term").alias("kind"), label(s).alias("label"))
    kind = F.array(*map(F.lit, KINDS))
    base = F.transform(
        "_base",
        lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(kind, s["rank"]).alias("kind"), F.concat(F.lit("["), F.upper(F.get(kind, s["rank"])), F.lit("]")).alias("label")
        ),
    )
    with_hits = (
        hits.join(listed, "_key", "left")
        .withColumn("_added", F.when(F.col("_terms").isNotNull(), F.transform(clear, span)))
        .withColumn("_all", F.array_sort(F.concat(base, F.coalesce("_added", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,label:string>>)")))))
        .select("_row", sanitised(F.col("_text"), F.col("_all")).alias("text"), F.col("_all").alias("pii_spans"))
    )
    without = marked.filter(F.size("_base") == 0).select(
        "_row", "text", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,label:string>>)").alias("pii_spans")
    )
    own = [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns]
    return with_hits.unionByName(without).select(*own, *([F.col("pii_spans").alias(spans)] if spans else []))


def digest(clean: DataFrame) -> DataFrame:
    """The contract's columns from sanitise()'s rows."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("pii_spans", lambda s: s["rank"] < len(KINDS))
    count = lambda n: F.size(F.filter("pii_spans", lambda s: s["rank"] == n)).cast("long")
    return clean.select(
        "doc_id",
        *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)),
        F.sha2(said(own), 256).alias("base_sha256"),
        said(F.col("pii_spans")).alias("spans"),
        count(len(KINDS)).alias("n_terms"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"),
    )
