"""Text analytics over token streams: tokens, lexicon features, inverse document frequency, shingles, grounding.

Everything is built-in expressions: tokens are one regex extraction per row, counts explode and aggregate with map-side
combine, and ordered rules are windows over (group, position). Lexicons are small literal lists of our own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.registry import query, table

#: Fixed value: the token pattern (ASCII letters, digits and a few signs, with an optional decimal part).
TOKEN = r"[a-z0-9$%€£']+(?:[.,][0-9]+)?"
STOP = ("the", "of", "and", "to", "in", "a", "is", "it", "that", "for", "on", "as", "be", "la", "de", "et", "der", "die", "und", "que", "en", "los")
PHRASES = ("that the", "of the", "in the", "to be", "and the", "is that", "de la", "in der")


# ---- functions -----------------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_tokens(toks: Column, stop: Sequence[str] = STOP) -> Column:
    """Tokens that are no stop word and longer than two characters."""
    return F.filter(toks, lambda t: ~t.isin(*stop) & (F.length(t) > 2))


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How many distinct phrases occur, each after a space or at the start."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(padded, F.lit(f" {p}")).cast("int")
    return total


def shingles(toks: Column, n: int = 3) -> Column:
    """Distinct token n-grams joined by a space; a shorter text is one shingle; no tokens, none."""
    def grams_of(t: Column) -> Column:
        size = F.size(t)
        grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))
        return F.when(size >= n, F.array_distinct(grams)).when(size > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    # Bound as a lambda variable, the tokens are made once a row; written out in place they would be made for every gram.
    return F.element_at(F.transform(F.array(toks), grams_of), 1)


def set_similarity(common: Column, a: Column, b: Column) -> Column:
    """max(Jaccard, 0.9 * containment) from set sizes; an empty side gives 0."""
    value = F.greatest(common / (a + b - common), F.lit(0.9) * common / F.least(a, b))
    return F.when((a == 0) | (b == 0), 0.0).otherwise(value)


def numbers_in(text: Column) -> Column:
    """Numbers with thousands separators removed."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


#: Forms of secrets in logs; a group is what stays before the stars.
SECRET_FORMS = (
    r"ya29\.[0-9A-Za-z\-_]+",
    r"1//[0-9A-Za-z\-_]{20,}",
    r"AIza[0-9A-Za-z\-_]{35}",
    r"GOCSPX-[0-9A-Za-z\-_]+",
    r"""(?i)("?(?:access_token|refresh_token|client_secret|api_key|password|token)"?\s*[:=]\s*"?)[^\s",&]+""",
    r"(?i)(authorization:\s*bearer\s+)[^\s]+",
)


def redact_secrets(text: Column) -> Column:
    """Secrets replaced by stars, the names before them kept."""
    for p in SECRET_FORMS:
        text = F.regexp_replace(text, p, "$1***" if p.startswith("(?i)(") else "***")
    return text


def hashtag(text: Column) -> Column:
    """Letters, digits and underscores only, 2 to 30 of them, else null."""
    clean = F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")
    return F.when(F.length(clean).between(2, 30), clean)


def ends_sentence(token: Column) -> Column:
    """Terminal punctuation, closing quotes allowed; single initials and common abbreviations do not end."""
    return token.rlike("[.!?…][\"')\\]]*$") & ~F.lower(token).isin("mr.", "mrs.", "dr.", "st.", "vs.", "etc.", "e.g.", "i.e.") & ~token.rlike("^[A-Z]\\.$")


def words_of(conversations: DataFrame) -> DataFrame:
    """Words of conversations with synthetic times: 0.35 s apart, 1.5 s more before a turn."""
    turns = conversations.select("conv_id", "turn", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+"), lambda x: x != "")).alias("pos", "word"))
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    turns = turns.withColumn("idx", idx)
    return turns.select("conv_id", "idx", "turn", "word", F.round(F.lit(0.35) * F.col("idx") + F.lit(1.5) * F.col("turn"), 3).alias("start"), F.round(F.lit(0.35) * F.col("idx") + F.lit(1.5) * F.col("turn") + 0.3, 3).alias("end"))


WORDS = """(SELECT conv_id, idx, turn, word, round(0.35::DOUBLE * idx + 1.5::DOUBLE * turn, 3) AS start, round(0.35::DOUBLE * idx + 1.5::DOUBLE * turn + 0.3::DOUBLE, 3) AS "end" FROM (
  SELECT conv_id, turn, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS idx FROM (
    SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM conversations))))"""
TERMINAL = """regexp_matches(word, '[.!?…]["'')\\]]*$') AND lower(word) NOT IN ('mr.', 'mrs.', 'dr.', 'st.', 'vs.', 'etc.', 'e.g.', 'i.e.') AND NOT regexp_matches(word, '^[A-Z]\\.$')"""
SENTENCE_WORDS = f"""(SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS sentence FROM (SELECT *, CASE WHEN lag(closes) OVER w OR start - lag("end") OVER w >= 1.2 THEN 1 ELSE 0 END AS new
  FROM (SELECT *, {TERMINAL} AS closes FROM {WORDS}) WINDOW w AS (PARTITION BY conv_id ORDER BY idx)))"""


def sentence_words(words: DataFrame, pause: float = 1.2) -> DataFrame:
    """Words numbered by sentence: a new one after terminal punctuation or a pause."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    rows = words.withColumn("closes", ends_sentence(F.col("word")))
    new = F.when(F.lag("closes").over(w) | (F.col("start") - F.lag("end").over(w) >= pause), 1).otherwise(0)
    rows = rows.withColumn("new", new)
    return rows.withColumn("sentence", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sentences_of(words: DataFrame) -> DataFrame:
    """One row per sentence with its times, word range and text."""
    rows = sentence_words(words).groupBy("conv_id", "sentence").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("idx").alias("first_word"), F.max("idx").alias("last_word"), F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("ws"))
    return rows.withColumn("text", F.array_join(F.transform("ws", lambda x: x["word"]), " ")).drop("ws")


SENTENCES = f"""(SELECT conv_id, sentence, min(start) AS start, max("end") AS "end", min(idx) AS first_word, max(idx) AS last_word, string_agg(word, ' ' ORDER BY idx) AS text FROM {SENTENCE_WORDS} GROUP BY 1, 2)"""


# ---- registered queries -----------------------------------------------------------------------
_TOK = f"regexp_extract_all(lower(coalesce(text, '')), '{TOKEN.replace(chr(39), chr(39) * 2)}', 0)"
_STOP = ", ".join(f"'{x}'" for x in STOP)


@query("token_stats", f"SELECT lang, sum(len(t))::BIGINT AS tokens, sum(len(list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) > 2)))::BIGINT AS content FROM (SELECT lang, {_TOK} AS t FROM documents) GROUP BY 1")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", tokens(F.col("text")).alias("t"))
    return rows.groupBy("lang").agg(F.sum(F.size("t")).alias("tokens"), F.sum(F.size(content_tokens(F.col("t")))).alias("content"))


@query(
    "term_top6",
    f"""SELECT conv_id, token, n FROM (SELECT conv_id, token, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn * 100000 + pos)) AS k FROM (
    SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT conv_id, turn, {_TOK} AS t FROM conversations)) WHERE token NOT IN ({_STOP}) AND length(token) > 2 GROUP BY 1, 2) WHERE k <= 6""",
)
def term_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six most frequent content tokens of each conversation; earlier ones win ties."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).where(~F.col("token").isin(*STOP) & (F.length("token") > 2))
    counts = rows.groupBy("conv_id", "token").agg(F.count("*").alias("n"), F.min(F.col("turn") * 100000 + F.col("pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("k", place).where("k <= 6").select("conv_id", "token", "n")


@query("phrase_hits", "SELECT doc_id, " + " + ".join(f"contains(' ' || lower(coalesce(text, '')) || ' ', ' {p}')::INT" for p in PHRASES) + " AS hits FROM documents")
def phrase_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", phrase_hits(F.col("text"), PHRASES).alias("hits"))


@query("stutters", f"SELECT conv_id, count(*) AS n FROM (SELECT conv_id, w, lag(w) OVER k AS p, lag(w, 2) OVER k AS q FROM (SELECT conv_id, idx, trim(lower(word), '.,!?') AS w FROM {WORDS}) WINDOW k AS (PARTITION BY conv_id ORDER BY idx)) WHERE w = p AND w = q GROUP BY 1")
def stutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a word stands three times running, marks around it aside."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    rows = words_of(table(spark, sf_dir, "conversations")).withColumn("w", F.regexp_replace(F.lower("word"), r"^[.,!?]+|[.,!?]+$", ""))
    return rows.select("conv_id", "w", F.lag("w").over(w).alias("p"), F.lag("w", 2).over(w).alias("q")).where("w = p AND w = q").groupBy("conv_id").agg(F.count("*").alias("n"))


@query(
    "redaction",
    "SELECT doc_id, md5(" + "regexp_replace(" * len(SECRET_FORMS) + "text" + "".join(f", '{p}', '{chr(92)}1***', 'g')" if p.startswith("(?i)(") else f", '{p}', '***', 'g')" for p in SECRET_FORMS) + ") AS digest FROM documents",
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact_secrets(F.col("text"))).alias("digest"))


@query("sentence_rows", f"""SELECT conv_id, sentence::BIGINT AS sentence, round(start, 3) AS start, round("end", 3) AS "end", first_word, last_word, md5(text) AS digest FROM {SENTENCES}""")
def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences_of(words_of(table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", F.col("sentence").cast("long").alias("sentence"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.md5("text").alias("digest"))


@query(
    "sentence_features",
    f"""SELECT conv_id, sentence::BIGINT AS sentence, len(t) AS n_tokens, len(list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) > 2)) AS n_content, round(len(t) / greatest(0.1, "end" - start), 4) AS rate, ends FROM (
    SELECT *, {_TOK} AS t, regexp_matches(text, '[.]$') AS ends FROM {SENTENCES})""",
)
def sentence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences_of(words_of(table(spark, sf_dir, "conversations"))).withColumn("t", tokens(F.col("text")))
    return rows.select("conv_id", F.col("sentence").cast("long").alias("sentence"), F.size("t").alias("n_tokens"), F.size(content_tokens(F.col("t"))).alias("n_content"), F.round(F.size("t") / F.greatest(F.lit(0.1), F.col("end") - F.col("start")), 4).alias("rate"), F.col("text").rlike("[.]$").alias("ends"))


_DF = f"(SELECT token, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest({_TOK}) AS token FROM conversations) GROUP BY 1)"


@query("idf_table", f"SELECT token, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM {_DF}, (SELECT count(*)::DOUBLE AS n FROM conversations)")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    df = turns.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(turns.agg(F.count("*").alias("n")))).select("token", "df", F.round(F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))


@query(
    "novelty_z",
    f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM conversations), t AS (SELECT conv_id, turn, token, least(count(*), 3) AS c FROM (SELECT conv_id, turn, unnest({_TOK}) AS token FROM conversations) GROUP BY 1, 2, 3),
    s AS (SELECT conv_id, turn, sum(c * (ln((1 + n) / (1 + df)) + 1)) / sum(c) AS d FROM t JOIN {_DF} USING (token), n GROUP BY 1, 2)
    SELECT conv_id, turn, round(greatest(-2.5, least(2.5, (d - avg(d) OVER ()) / greatest(1e-6, stddev_pop(d) OVER ()))), 4) AS z FROM s""",
)
def novelty_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean inverse document frequency of a turn's tokens (counts capped at 3) as a clipped z-score over all turns."""
    turns = table(spark, sf_dir, "conversations")
    counts = turns.select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("token")).groupBy("conv_id", "turn", "token").agg(F.least(F.count("*"), F.lit(3)).alias("c"))
    df = turns.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(turns.agg(F.count("*").alias("n")))).select("token", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    score = counts.join(idf, "token").groupBy("conv_id", "turn").agg((F.sum(F.col("c") * F.col("idf")) / F.sum("c")).alias("d"))
    moments = score.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"))
    z = (F.col("d") - F.col("m")) / F.greatest(F.lit(1e-6), F.col("sd"))
    return score.crossJoin(F.broadcast(moments)).select("conv_id", "turn", F.round(F.greatest(F.lit(-2.5), F.least(F.lit(2.5), z)), 4).alias("z"))


@query("grounded_numbers", """SELECT doc_id, len(nums) AS n, list_sum(list_transform(nums, lambda x: length(x)))::BIGINT AS size FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*(?:\\.[0-9]+)?', 0), lambda x: replace(x, ',', '')) AS nums FROM documents) WHERE len(nums) > 0""")
def grounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", numbers_in(F.col("text")).alias("nums")).where(F.size("nums") > 0)
    return rows.select("doc_id", F.size("nums").alias("n"), F.aggregate("nums", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("size"))


@query("hashtags", "SELECT doc_id, count(DISTINCT h) AS tags, count(*) FILTER (length(h) > 30) AS long, max(h) FILTER (length(h) BETWEEN 2 AND 30) AS last FROM (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), ' ')), '[^\\p{L}\\p{N}_]', '', 'g') AS h FROM documents) GROUP BY 1")
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that every word of the whole texts would make: how many, how many are too long, and the last in order."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    h = words.select("doc_id", F.regexp_replace("w", r"[^\p{L}\p{N}_]", "").alias("h"), hashtag(F.col("w")).alias("tag"))
    return h.groupBy("doc_id").agg(F.count_distinct("h").alias("tags"), F.count_if(F.length("h") > 30).alias("long"), F.max("tag").alias("last"))


@query("vocab_tags", f"SELECT conv_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT conv_id, unnest({_TOK}) AS token FROM conversations) JOIN (SELECT * FROM (VALUES ('the', 'article'), ('la', 'article'), ('der', 'article'), ('and', 'link'), ('und', 'link'), ('et', 'link'), ('in', 'place'), ('to', 'place')) v(token, tag)) USING (token) GROUP BY 1")
def vocab_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a small vocabulary found in each conversation."""
    vocabulary = spark.createDataFrame([("the", "article"), ("la", "article"), ("der", "article"), ("and", "link"), ("und", "link"), ("et", "link"), ("in", "place"), ("to", "place")], "token string, tag string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(F.broadcast(vocabulary), "token")
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query(
    "chunk_labels",
    f"""SELECT conv_id, chunk, n, CASE WHEN questions > 0 THEN 'QUESTION' WHEN words > 300 THEN 'DENSE' WHEN n <= 2 THEN 'SHORT' ELSE 'MAIN' END AS label FROM (
    SELECT conv_id, floor(start / 100)::BIGINT AS chunk, count(*) AS n, sum(last_word - first_word + 1) AS words, count(*) FILTER (contains(text, '?')) AS questions FROM {SENTENCES} GROUP BY 1, 2)""",
)
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in chunks of 100 s, labelled by the first rule that holds."""
    rows = sentences_of(words_of(table(spark, sf_dir, "conversations")))
    chunks = rows.groupBy("conv_id", F.floor(F.col("start") / 100).alias("chunk")).agg(F.count("*").alias("n"), F.sum(F.col("last_word") - F.col("first_word") + 1).alias("words"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"))
    label = F.when(F.col("questions") > 0, "QUESTION").when(F.col("words") > 300, "DENSE").when(F.col("n") <= 2, "SHORT").otherwise("MAIN")
    return chunks.select("conv_id", "chunk", "n", label.alias("label"))
