"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, lm, mixing, phrases, pii, quality, ranking, spelling, substring, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.classes(table(spark, sf_dir, "documents")))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Phrases of one to five words by piece, each with the counts of its parts; HUGEINT holds the products.
OP12_PHRASES = """
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS words
  FROM (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM starts) WHERE i + k - 1 <= len(w)
),
counts AS (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k >= 2),
inside AS (
  SELECT DISTINCT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, words, a, m, k, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, words, a, k, unnest(range(2, k)) AS m FROM candidates WHERE k > 2))
),
kept AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = c.lang AND s.phrase = c.phrase AND s.a >= c.a)),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(words[1 : j], ' ') AS head, array_to_string(words[j + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, h.a AS l, t.a AS r, s.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_pii": op2_pii,
        "op3_lm": op3_lm,
        "op4_chat": op4_chat,
        "op5_jaccard": op5_jaccard,
        "op6_ann": op6_ann,
        "op7_toxicity": op7_toxicity,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_substring": op10_substring,
        "op11_spelling": op11_spelling,
        "op12_phrases": op12_phrases,
        "op13_ranking": op13_ranking,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": OP12_PHRASES}
