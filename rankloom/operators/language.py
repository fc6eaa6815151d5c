"""Language identification by naive Bayes on character n-grams.

A text counts through its distinct words, each once. A word is padded with a
space on both sides and its runs of three characters are the grams, so they hold
one to three letters and tell where a word begins and ends. The model holds the log probability of the
most frequent grams under each language, learnt from a bounded sample, as whole
numbers, so sums and ties are the same in any order of adding. Grams that the
model does not know count for no language.

Scoring stays in the JVM and moves one row of sums per text: words and grams
are exploded in place, looked up in the model (at most ``max_grams`` rows,
broadcast) and summed before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.session import materialize

SAMPLE_PER_LANGUAGE = 40
MAX_GRAMS = 5000


def learning_sample(rows: DataFrame, id_col: str, lang_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``id_col, lang``: of each labelled language the rows of the smallest md5 of
    the id (an id labelled twice is learnt under both labels). Texts are not read."""
    place = Window.partitionBy("lang").orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col)
    known = rows.select(id_col, F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col(id_col).isNotNull()).distinct()
    return known.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= per_language).drop("_r")


def _grams(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``*keys, gram``: one row for each gram of each distinct word of each row."""
    words = rows.select(*keys, F.explode(F.array_distinct(tokens(text))).alias("w"))
    words = words.select(*keys, F.concat(F.lit(" "), F.col("w"), F.lit(" ")).alias("w"))
    at = words.select(*keys, "w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"))
    return at.select(*keys, F.substr("w", F.col("i"), F.lit(3)).alias("gram"))


class LanguageModel:
    """``languages`` (sorted; as many as the sample's labels) and the table
    ``weights``: ``gram`` and ``w0, w1, ...``, one weight per language."""

    def __init__(self, languages: list[str], weights: DataFrame | None):
        self.languages, self.weights = languages, weights


def learn(rows: DataFrame, id_col: str, text_col: str, lang_col: str,
          per_language: int = SAMPLE_PER_LANGUAGE, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """A model from at most ``per_language`` rows of each language (``learning_sample``).
    ``weight = round(1000 * ln((n + 1) / (n of the language + grams)))`` over the
    ``max_grams`` most frequent grams of the sample (ties by gram). Without
    labelled rows the model knows no language."""
    # written, so that its size is known when the join is planned: the texts of other rows are not dealt
    sample = materialize(learning_sample(rows, id_col, lang_col, per_language), "language-sample")
    texts = rows.select(id_col, F.col(text_col).alias("text")).join(sample, id_col)
    counts = materialize(_grams(texts, ["lang"], F.col("text")).groupBy("lang", "gram").agg(F.count("*").alias("n")),
                         "language-grams")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], None)
    by_gram = counts.groupBy("gram").pivot("lang", languages).agg(F.sum("n")).na.fill(0)
    n = [F.col(f"`{lang}`") for lang in languages]
    top = by_gram.orderBy(reduce(lambda a, b: a + b, n).desc(), "gram").limit(max_grams)
    top = materialize(top.select("gram", *[c.alias(f"n{i}") for i, c in enumerate(n)]), "language-model")
    sums = top.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(languages))], F.count("*").alias("grams"))
    t = sums.first()  # one number per language
    weight = [F.round(1000 * F.log((F.col(f"n{i}") + 1) / F.lit(t[f"t{i}"] + t.grams))).cast("bigint").alias(f"w{i}")
              for i in range(len(languages))]
    return LanguageModel(languages, top.select("gram", *weight))


def detect(rows: DataFrame, id_col: str, text, model: LanguageModel) -> DataFrame:
    """``id_col, detected_language`` of every row with a gram that the model knows;
    texts without letters have none. Ties go to the first language by name; rows
    of one id are one text."""
    text = F.col(text) if isinstance(text, str) else text
    if not model.languages:
        return rows.select(id_col, F.lit(None).cast("string").alias("detected_language")).limit(0)
    at = range(len(model.languages))
    # A number is looked up faster than a text, and this is done once per gram of every word; a
    # hit counts only where the texts are the same, so two grams of one hash are not mixed up.
    weights = model.weights.select(F.xxhash64("gram").alias("h"), F.col("gram").alias("known"), *[f"w{i}" for i in at])
    hits = _grams(rows.select(F.col(id_col).alias("_id"), text.alias("_text")), ["_id"], F.col("_text")) \
        .withColumn("h", F.xxhash64("gram")).join(F.broadcast(weights), "h")  # at most max_grams rows
    sums = hits.groupBy("_id").agg(*[F.sum(F.when(F.col("gram") == F.col("known"), F.col(f"w{i}"))).alias(f"s{i}") for i in at]) \
        .where(F.col("s0").isNotNull())
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("at")) for i in at]))
    names = F.array(*[F.lit(x) for x in model.languages])
    return sums.select(F.col("_id").alias(id_col), F.element_at(names, 1 - best["at"]).alias("detected_language"))
