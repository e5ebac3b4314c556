"""Queries on texts, labels and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import strings
from vellumgrid.operators import text
from vellumgrid.plans import fixtures as fx


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names beside those of the next part, in upper case."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("w"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("w2")), "p_partkey").select("p_partkey", F.col("w").alias("observed"), F.col("w2").alias("intended"))


_PAIRS = "p AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS w FROM part), pairs AS (SELECT a.p_partkey, a.w AS observed, b.w AS intended FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1)"


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", F.levenshtein("observed", "intended").cast("long").alias("distance"))


def align_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.alignments(_pairs(spark, sf_dir)).select("p_partkey", F.col("cost").cast("long").alias("distance"))


def align_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tally(text.alignments(_pairs(spark, sf_dir)))


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.train_costs(_pairs(spark, sf_dir).select("observed", "intended"))[0]


def close_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM"]
    near = [(r[k], r[j]) for r in rows for k in range(len(r)) for j in (k - 1, k + 1) if 0 <= j < len(r)]
    return text.close_key_mass(align_tally(spark, sf_dir), spark.createDataFrame(near, "letter string, near string"))


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes are k modulo 8 of a user's events, by id; a sequence has those of 20,000 ids at most."""
    e = fx.table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 20_000).alias("part"), "event_id", (F.get_json_object("props", "$.k").cast("int") % 8).alias("t"))
    seq = e.groupBy("user_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]).alias("c"))
    return seq.select("user_id", "part", text.ctc_text(F.col("c")).alias("decoded"))


CTC_SQL = """
WITH e AS (SELECT user_id, event_id // 20000 AS part, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id, part ORDER BY event_id) AS b FROM e)
SELECT user_id, part, coalesce(string_agg(CASE WHEN t <> 0 AND (b IS NULL OR b <> t) THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', t, 1) END, '' ORDER BY event_id), '') AS decoded FROM l GROUP BY 1, 2"""


def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_list(fx.table(spark, sf_dir, "documents"))


def label_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = strings.label_of_name(F.col("url"))
    number = strings.class_of(F.upper(c))
    return fx.table(spark, sf_dir, "pages").select("page_id", c.alias("label"), F.coalesce(number, F.lit(-1)).alias("class"), F.coalesce(strings.letter_of(number), F.lit("")).alias("letter"))


def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "region").select("r_regionkey", strings.encoded(F.col("r_name"), text.ALPHABET).alias("codes"))


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation")
    return n.select("n_nationkey", strings.repeats_letter(F.col("n_name"), 2).alias("doubled"), F.col("n_name").contains("II").alias("has_ii"), strings.suffixes(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") % 7 == 0).alias("marks"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return text.dense_ids(d, "n_chars", "doc_id", buckets=32).select("doc_id", "sample_id", "image_key", "label_key")


def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("words/"), F.col("doc_id")).alias("key"), F.col("lang").alias("label"))
    labels = fx.table(spark, sf_dir, "labels").select(F.concat(F.lit("words/"), F.col("doc_id")).alias("key"), F.col("quality").cast("string").alias("label"))
    return text.merge_labels(d, labels)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.split_by_position(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "part")


def longest_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding width of batches of 32 in the order of width."""
    ids = dense_ids(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ids.groupBy(F.floor((F.col("sample_id") - 1) / 32).alias("batch")).agg(F.max("n_chars").alias("width"), F.count("*").alias("n"))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.4), (4, 0.2)], "value long, weight double")
    return text.draw(fx.table(spark, sf_dir, "documents").select("doc_id"), (F.col("doc_id") % 1000) / 1000.0 + 0.0005, weights).select("doc_id", "value")


def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap of a turn's length to the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return c.select("conv_id", "turn", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)).alias("gap"))


QUERIES = {
    "q_edit_distance": edit_distance,
    "q_align_cost": align_cost,
    "q_align_tally": align_tally,
    "q_cost_model": cost_model,
    "q_close_keys": close_keys,
    "q_ctc_decode": ctc_decode,
    "q_wordlist_normalise": wordlist,
    "q_label_from_name": label_from_name,
    "q_encode_text": encode_text,
    "q_word_rules": word_rules,
    "q_dense_ids": dense_ids,
    "q_label_merge": label_merge,
    "q_split_70_15_15": split,
    "q_batch_width": longest_in_batch,
    "q_discrete_draw": drawn,
    "q_turn_gaps": repeated_turns,
}
_ID = "row_number() OVER (ORDER BY n_chars, doc_id)"
SQL = {
    "q_edit_distance": f"WITH {_PAIRS} SELECT p_partkey, CAST(levenshtein(observed, intended) AS BIGINT) AS distance FROM pairs",
    "q_align_cost": f"WITH {_PAIRS} SELECT p_partkey, CAST(levenshtein(observed, intended) AS BIGINT) AS distance FROM pairs",
    "q_ctc_decode": CTC_SQL,
    "q_wordlist_normalise": r"WITH w AS (SELECT unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents), k AS (SELECT upper(replace(strip_accents(w), 'ß', 'ss')) AS word FROM w WHERE regexp_full_match(w, '\p{L}+')) SELECT word, count(*) AS n FROM k GROUP BY 1",
    "q_label_from_name": "WITH c AS (SELECT page_id, substr(url, -5, 1) AS l FROM pages), d AS (SELECT *, upper(l) AS u FROM c) SELECT page_id, l AS label, CASE WHEN u BETWEEN '0' AND '9' THEN ascii(u) - 48 WHEN u BETWEEN 'A' AND 'Z' THEN ascii(u) - 55 ELSE -1 END AS class, CASE WHEN u BETWEEN '0' AND '9' OR u BETWEEN 'A' AND 'Z' THEN u ELSE '' END AS letter FROM d",
    "q_encode_text": "SELECT r_regionkey, list_transform(string_split(lower(r_name), ''), lambda c: CAST(instr('0123456789abcdefghijklmnopqrstuvwxyz', c) AS INTEGER)) AS codes FROM region",
    "q_word_rules": "SELECT n_nationkey, len(list_filter(range(1, length(n_name)), lambda k: substr(n_name, k, 1) = substr(n_name, k + 1, 1))) > 0 AS doubled, contains(n_name, 'II') AS has_ii, concat(CASE WHEN n_nationkey % 2 = 0 THEN '_hn' ELSE '' END, CASE WHEN n_nationkey % 3 = 0 THEN '_st' ELSE '' END, CASE WHEN n_nationkey % 5 = 0 THEN '_cc' ELSE '' END, CASE WHEN n_nationkey % 7 = 0 THEN '_nw' ELSE '' END) AS marks FROM nation",
    "q_dense_ids": f"SELECT doc_id, {_ID} AS sample_id, printf('image-%09d', {_ID}) AS image_key, printf('label-%09d', {_ID}) AS label_key FROM documents",
    "q_label_merge": "SELECT 'words/' || d.doc_id AS key, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS label FROM documents d LEFT JOIN labels l USING (doc_id)",
    "q_split_70_15_15": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= n * 70 // 100 THEN 'train' WHEN k <= n * 85 // 100 THEN 'validation' ELSE 'test' END AS part FROM r",
    "q_batch_width": f"WITH r AS (SELECT n_chars, {_ID} AS k FROM documents) SELECT (k - 1) // 32 AS batch, max(n_chars) AS width, count(*) AS n FROM r GROUP BY 1",
    "q_discrete_draw": "WITH d AS (SELECT doc_id, (doc_id % 1000) / 1000.0 + 0.0005 AS a FROM documents) SELECT doc_id, CAST(CASE WHEN a < 0.1 THEN 1 WHEN a < 0.4 THEN 2 WHEN a < 0.8 THEN 3 ELSE 4 END AS BIGINT) AS value FROM d",
    "q_turn_gaps": "SELECT conv_id, turn, coalesce(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS gap FROM conversations",
}
