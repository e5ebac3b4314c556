"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate that rejects a text. On a bounded random sample the cascade estimates what each rule costs and how often
it rejects; rules then run in the order of rejections per cost, and a text that one rejects skips the rest. Order changes the
work, never the verdict. A cost is the time of many evaluations of the rule in one job less that of a rule that always passes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import table, text_of, words_of
from vellumgrid.storage import write_table

#: Rows on which costs and rejections are estimated, about; the longest text among them, in characters; evaluations of a rule on each.
SAMPLE_ROWS, SAMPLE_CHARACTERS, EVALUATIONS = 200, 100_000, 40
#: Differences of cost that time can't tell, in seconds a job.
RESOLUTION = 0.02
WINDOW_WORDS = 8
#: The characters counted as symbols, and the lower bound and share of the base rule.
SYMBOLS, LEAST_WORDS, MOST_REPEATED_PERCENT = "#*$%&|<>", 20, 30
#: Fewer lines that repeat are no reason to reject a short text.
LEAST_DUPLICATE_LINES = 3


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    """Over the columns of `measured`."""


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def n_duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column, k: int = WINDOW_WORDS) -> Column:
    """One 64-bit hash for each window of k words."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1))), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def n_repeated_words(hashes: Column, k: int = WINDOW_WORDS) -> Column:
    """Words in windows whose hash occurs twice or more; a text without repeats is told by one distinct count."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(row: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(row, i - 1)["h"] == x["h"])) | F.coalesce(F.get(row, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(row, same), lambda x: x["i"]))

    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + k - F.greatest(i, a["end"])).alias("n"), (i + k).alias("end")),
    )["n"]
    # each array is named once by a one-element transform, so that Spark computes it once
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(once(placed, lambda row: once(repeated(row), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, body, words and the base counts of every row; a null text counts as empty."""
    return (
        docs.select(F.col("doc_id").cast("long"), text_of(F.col("text").cast("string")).alias("body"))
        .withColumn("words", words_of("body"))
        .withColumns({
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": n_symbols(F.col("body")),
            "n_dup_lines": n_duplicate_lines(F.col("body")),
            "hashes": window_hashes(F.col("words")),
        })
        .withColumn("n_repeat_words", n_repeated_words(F.col("hashes")))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    )


def rules() -> list[Rule]:
    """The base rule and the cascade's own. Bounds of the latter are loose: each rejects what no prose in any language has."""
    body, n = F.col("body"), F.col("n_words")
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(body, r"\P{Lu}+", ""))
    lines = F.size(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    stutters = F.size(F.filter(F.col("words"), lambda w, i: (i > 0) & (F.get(F.col("words"), i - 1) == w)))
    return [
        Rule("base", F.col("base_failed")),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= LEAST_DUPLICATE_LINES) & (10 * F.col("n_dup_lines") > 3 * lines)),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 16 * n)),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("capitals", 2 * capitals > letters),
        Rule("stutter", 5 * stutters > n),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` measured rows, each with the same chance, as a written table; longer texts than SAMPLE_CHARACTERS stay out."""
    total = max(1, docs.count())
    chosen = docs.select("doc_id", "text").sample(min(1.0, 1.2 * rows / total), seed=7).where(F.length(text_of(F.col("text").cast("string"))) <= SAMPLE_CHARACTERS)
    return write_table(measured(chosen.limit(rows)), "quality-sample")


def estimate(docs: DataFrame, of: list[Rule] | None = None, rows: int = SAMPLE_ROWS, evaluations: int = EVALUATIONS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on about `rows` rows, in the order of the cascade: most rejections per second first, then the
    cheapest, then by name. Seconds are of all evaluations, the least of two jobs, after one to warm up."""
    sample = sampled(docs, rows)
    # a rule's columns, and a counter that makes each evaluation another one
    again = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(evaluations))))

    def run(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        n, rejected = again.agg(F.count("turn"), F.count_if(F.coalesce(rejects, F.lit(False)))).first()
        return time.perf_counter() - began, rejected / max(1, n)

    def cheapest(rejects: Column) -> tuple[float, float]:
        tried = [run(rejects) for _ in range(2)]
        return min(t for t, _ in tried), tried[0][1]

    passing = F.size("words") + F.size("hashes") + F.length("body") < 0  # reads what rules read
    run(passing)
    nothing = cheapest(passing)[0]
    counted = [(rule, max(RESOLUTION, seconds - nothing), share) for rule in of or rules() for seconds, share in [cheapest(rule.rejects)]]
    return sorted(counted, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def judge(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """One row per input row: doc_id, base counts, base_failed, kept and the rule that rejected it first (null if none did).

    Null and empty texts have no words, so they fail the base rule; rows that repeat stay repeated; a null doc_id stays null; other
    columns are ignored. order: rules as they are tried, by default as `estimate` has them.
    """
    verdict = None
    for rule in order or [r for r, _, _ in estimate(docs)]:
        verdict = (F if verdict is None else verdict).when(rule.rejects, F.lit(rule.name))
    return measured(docs).withColumn("rejected_by", verdict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; see `judge`."""
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS row FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (
  SELECT row, doc_id, body, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
win AS (SELECT row, CAST(i AS BIGINT) AS i, array_to_string(words[i:i + 7], ' ') AS k FROM m, unnest(range(1, CAST(greatest(1, n_words - 6) AS BIGINT))) AS t(i)),
rep AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT row, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM rep) GROUP BY 1),
c AS (
  SELECT m.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(body, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(body, '\P{Lu}+', '', 'g')) AS capitals,
         len(list_filter(range(2, CAST(n_words + 1 AS BIGINT)), lambda i: words[i] = words[i - 1])) AS stutters
  FROM m LEFT JOIN cov USING (row)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * len(lines)) OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 2 * letters < word_chars OR 2 * capitals > letters OR 5 * stutters > n_words) AS kept
FROM f
"""
