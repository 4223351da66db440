"""n-gram TF-IDF as tables, and naive Bayes scores over them.

The texts are hashed to their key before they are taken apart, and counted inside Python tasks.
For the vocabulary, only the sums of a chunk of texts are exchanged; weights are made where a key's texts lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscope.functions.text import replace_all
from corpuscope.operators.grams import per_chunk, per_row, weighed
from corpuscope.sources.shared import stored

WORD = r"[\p{L}\p{N}_]{2,}"
MOST_PAIRS = 200_000  # 2-grams that are sent to every task


@dataclass(frozen=True)
class CharGrams:
    """Character n-grams of the lower-cased text with runs of blanks squeezed, low <= n <= high."""

    text: str
    low: int
    high: int

    kind = "characters"

    def prepared(self) -> Column:
        return replace_all(F.lower(F.col(self.text)), r"\s\s+", " ")


@dataclass(frozen=True)
class WordGrams:
    """Word n-grams joined by blanks; words have two characters or more, stop words go first."""

    text: str
    low: int
    high: int
    stop_words: tuple[str, ...] = ()

    kind = "words"

    def prepared(self) -> Column:
        words = F.regexp_extract_all(F.lower(F.col(self.text)), F.lit(WORD), F.lit(0))
        if self.stop_words:
            words = F.filter(words, lambda w: ~w.isin(*self.stop_words))
        return F.array_join(words, " ")


def _by_key(df: DataFrame, grams: CharGrams | WordGrams, key: str, keep: list[str]) -> DataFrame:
    """(key, *keep, _texts): the prepared texts, those of a repeated key together."""
    # a stated number: the texts are small next to their n-grams, so sizing by bytes would merge too much
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(key, *keep, grams.text).repartition(parts, key)
    return placed.groupBy(key, *keep).agg(F.collect_list(grams.prepared()).alias("_texts"))


def term_counts(df: DataFrame, grams: CharGrams | WordGrams, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, gram, tf)."""
    texts = _by_key(df, grams, key, keep or [])
    kept = StructType(texts.schema.fields[:-1])
    return texts.mapInArrow(
        per_row(grams.kind, grams.low, grams.high), kept.add("gram", "string").add("tf", "long"))


def gram_totals(df: DataFrame, grams: CharGrams | WordGrams, key: str | None = None) -> DataFrame:
    """(gram, total, df): occurrences, and the number of keys, or of rows without a key, that have the gram."""
    return _totals(_by_key(df, grams, key, []) if key else df.select(grams.prepared().alias("_texts")), grams.kind, grams.low, grams.high)


def _totals(texts: DataFrame, kind: str, low: int, high: int, pairs: list[str] | None = None) -> DataFrame:
    return texts.select("_texts").mapInArrow(per_chunk(kind, low, high, pairs), "gram string, total long, df long").groupBy("gram").agg(
        F.sum("total").alias("total"), F.sum("df").alias("df"))


def top_grams(df: DataFrame, grams: CharGrams | WordGrams, max_features: int, min_df: int = 1) -> DataFrame:
    """``most_frequent`` of the rows' ``gram_totals``."""
    return _top(df.select(grams.prepared().alias("_texts")), grams, max_features, min_df)


def _top(texts: DataFrame, grams: CharGrams | WordGrams, max_features: int, min_df: int) -> DataFrame:
    """The most frequent n-grams of (_texts), which are read twice for words of more than two symbols.

    Nearly every long run of words is another one, so they are not all exchanged: an n-gram occurs no more
    often, and in no more texts, than each of its 2-grams.  What the shorter n-grams alone put last bounds
    the totals from below, so longer ones count only where their 2-grams reach it.
    """
    low, high = grams.low, grams.high
    if grams.kind != WordGrams.kind or not low <= 2 < high:
        return most_frequent(_totals(texts, grams.kind, low, high), max_features, min_df)
    short = stored(_totals(texts, grams.kind, low, 2).where(F.col("df") >= min_df), "short")
    held = most_frequent(short, max_features).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    least = held["least"] if held["n"] == max_features else 0
    reach = short.where((F.col("total") >= least) & (F.instr("gram", " ") > 0)).select("gram")
    # at the bound many may be equal; then all longer n-grams count
    pairs = [r["gram"] for r in reach.limit(MOST_PAIRS + 1).collect()]
    long = _totals(texts, grams.kind, 3, high, pairs if len(pairs) <= MOST_PAIRS else None)
    return most_frequent(short.unionByName(long), max_features, min_df)


def most_frequent(grams: DataFrame, max_features: int, min_df: int = 1) -> DataFrame:
    """The ``max_features`` rows (gram, total, df) of the largest total; of equal ones the smaller gram."""
    return grams.where(F.col("df") >= min_df).orderBy(F.desc("total"), "gram").limit(max_features)


def tfidf(df: DataFrame, grams: CharGrams | WordGrams, key: str, max_features: int, min_df: int = 1,
          keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, gram, tf, weight): tf * (ln((1+N)/(1+df)) + 1), scaled to length 1 per text.

    The vocabulary has at most ``max_features`` rows, which come to the driver and go to every task.  Prepared
    texts are stored once, by key, as they are read for the vocabulary and for the weights.
    """
    keep = keep or []
    texts = stored(_by_key(df, grams, key, keep), "texts")
    whole = texts if not keep else texts.groupBy(key).agg(F.flatten(F.collect_list("_texts")).alias("_texts"))
    total = df.agg(F.count("*").alias("_texts"))
    vocab = _top(whole, grams, max_features, min_df).select("gram", (F.log((1 + total.scalar()) / (1 + F.col("df"))) + 1).alias("w")).collect()
    kept = StructType(texts.schema.fields[:-1])
    weighted = texts.mapInArrow(
        weighed(grams.kind, grams.low, grams.high, {r["gram"]: r["w"] for r in vocab}),
        kept.add("gram", "string").add("tf", "long").add("_w", "double").add("_squares", "double"))
    # without other columns a row has all texts of its key
    squares = F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)) if keep else F.col("_squares")
    return weighted.withColumn("weight", F.col("_w") / F.sqrt(squares)).select(key, *keep, "gram", "tf", "weight")


def naive_bayes_scores(train: DataFrame, test: DataFrame, key: str, label: str, alpha: float = 1.0) -> DataFrame:
    """(key, label, score): multinomial naive Bayes log scores of weighted grams.

    ``train`` is (key, label, gram, weight), ``test`` (key, gram, weight), both over one
    vocabulary.  The per-class table is summed inside the tasks first and holds at most
    classes x vocabulary rows, which are broadcast.  A gram a class has not seen adds nothing to the joined part;
    its smoothed share is in the per-class constant, so no class x gram grid is built.
    """
    a = F.lit(float(alpha))
    class_gram = train.groupBy(label, "gram").agg(F.sum("weight").alias("_w"))
    size = train.agg(F.count_distinct("gram").alias("_v"))
    prior_n = train.select(label, key).distinct().groupBy(label).agg(F.count("*").alias("_texts"))
    totals = class_gram.groupBy(label).agg(F.sum("_w").alias("_total")).join(prior_n, label)
    everything = prior_n.agg(F.sum("_texts"))
    classes = totals.select(F.struct(
        F.col(label).alias("label"),
        F.log(F.col("_texts") / everything.scalar()).alias("prior"),
        F.log(F.col("_total") + a * size.scalar()).alias("scale"),
    ).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("classes"))
    per_text = test.groupBy(key).agg(F.sum("weight").alias("_sum"))
    base = per_text.withColumn("_c", F.explode(classes.scalar())).select(
        key, F.col("_c.label").alias(label), "_sum",
        (F.col("_c.prior") + F.col("_sum") * (F.log(a) - F.col("_c.scale"))).alias("_base"))
    gains = class_gram.select(label, "gram", (F.log(F.col("_w") + a) - F.log(a)).alias("_gain"))
    seen = test.select(key, "gram", "weight").join(F.broadcast(gains), "gram").groupBy(key, label).agg(
        F.sum(F.col("weight") * F.col("_gain")).alias("_seen"))
    return base.join(seen, [key, label], "left").select(
        key, label, (F.col("_base") + F.coalesce("_seen", F.lit(0.0))).alias("score"))


def best_label(scores: DataFrame, key: str, label: str) -> DataFrame:
    """The best-scored label per text; of equal scores the smaller label."""
    return scores.groupBy(key).agg(
        F.min_by(label, F.struct(-F.round("score", 9), F.col(label))).alias("predicted"))
