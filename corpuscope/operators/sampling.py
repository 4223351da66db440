"""Caps, splits and folds that are exact and do not gather a label in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import md5_int

SLICES = 1024  # slices of the 32-bit hash range, see with_rank
MOST_CLASSES = 100_000  # of a table of cuts, which is broadcast: about 100 bytes each
BINS = 4096  # bins per pass of tail_cutoff


def hash_of(key: Column, salt: str = "") -> Column:
    return md5_int(F.concat(F.lit(salt), key.cast("string")))


def cap(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group.

    ``row_number() <= n`` lets Spark limit every group inside each task before the exchange,
    so a group holding a third of the rows sends at most n rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_rank(df: DataFrame, by: list[str], key: str, salt: str = "") -> DataFrame:
    """Add ``_rank`` (from 1) and ``_size``: the exact position of a row in its group in hash order.

    The hash range is cut into slices.  Slice counts (at most SLICES rows per group) give the
    rows before a slice, a window inside (group, slice) gives the rest.  A group with a third of
    all rows is therefore spread over SLICES window partitions.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    keyed = df.withColumn("_hash", hash_of(F.col(key), salt)).withColumns({
        "_slice": F.floor(F.col("_hash") / (2**32 // SLICES)),
        # group keys that are never NULL: a plain equality join clusters the rows as the window needs them
        **{g: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for g, c in zip(groups, by)},
    })
    counts = keyed.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_slice")
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_size": F.sum("_n").over(Window.partitionBy(*groups)),
    }).drop("_n")
    w = Window.partitionBy(*groups, "_slice").orderBy("_hash", key)
    ranked = keyed.join(counts, [*groups, "_slice"]).withColumn("_rank", F.col("_before") + F.row_number().over(w))
    return ranked.select(*df.columns, "_rank", "_size")


def tail_cutoff(df: DataFrame, key: str, fraction: float = 0.2) -> int | None:
    """Lowest key of the last ``int(fraction * n)`` rows in key order, NULL if that is no row.

    Finds the key by a few passes of fixed-size histograms over ever smaller ranges; only a
    histogram of at most BINS rows comes back per pass.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    wanted = int(n * fraction)
    if wanted == 0:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        bin_no = F.expr(f"(`{key}` - {low}L) div {width}L")
        counts = (
            df.where(F.col(key).between(low, high)).groupBy(bin_no.alias("bin")).count()
            .orderBy(F.desc("bin")).collect()
        )
        for row in counts:
            if wanted <= row["count"]:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            wanted -= row["count"]
    return low


def tail_split(df: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """The last part of the rows in key order as test set; all rows when that part is empty."""
    cutoff = tail_cutoff(df, key, fraction)
    return df if cutoff is None else df.where(F.col(key) >= cutoff)


def hash_split(df: DataFrame, key: str, percent: int = 20, salt: str = "42:") -> DataFrame:
    """Add ``split``: about ``percent`` of the rows are 'test', by hash of the key."""
    return df.withColumn("split", F.when(hash_of(F.col(key), salt) % 100 < percent, "test").otherwise("train"))


def cuts(df: DataFrame, key: str, label: str, shares: list[float], salt: str = "42:") -> DataFrame:
    """_g (the label, never NULL), _size and one _cut per share: the (hash, key) of row ceil(share * size) in hash order.

    Counts of hash slices tell which slice holds the row; only rows of those slices are ranked.
    Nothing but labels, hashes and keys is exchanged.  One row per class; more than MOST_CLASSES
    classes are an error, so that the result can be broadcast.
    """
    keyed = df.select(_group(label).alias("_g"), hash_of(F.col(key), salt).alias("_hash"), F.col(key).alias("_key")).withColumn(
        "_slice", F.floor(F.col("_hash") / (2**32 // SLICES)))
    ordered = Window.partitionBy("_g").orderBy("_slice")
    counts = keyed.groupBy("_g", "_slice").agg(F.count("*").alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_size": F.sum("_n").over(Window.partitionBy("_g")),
    })
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.ceil(F.col("_size") * share).alias("k")) for i, share in enumerate(shares)])
    holders = counts.withColumn("_w", F.explode(wanted)).where("_w.k > _before AND _w.k <= _before + _n").select(
        "_g", "_slice", "_size", F.col("_w.i").alias("_i"), (F.col("_w.k") - F.col("_before")).alias("_k"))
    ranked = keyed.join(holders, ["_g", "_slice"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_g", "_slice", "_i").orderBy("_hash", "_key"))).where("_rank = _k")
    place = F.struct("_hash", "_key")
    found = ranked.groupBy("_g").agg(
        F.max("_size").alias("_size"), *[F.max(F.when(F.col("_i") == i, place)).alias(f"_cut{i}") for i in range(len(shares))])
    many = found.agg(F.count("*")).scalar() > MOST_CLASSES
    return found.where(F.when(many, F.raise_error(F.lit("too many classes to split by"))).otherwise(F.lit(True)))


def _group(label: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))


def _with_cuts(df: DataFrame, key: str, label: str, shares: list[float], salt: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its class's cuts, and whether a row lies up to each; rows stay where they are."""
    table = F.broadcast(cuts(df, key, label, shares, salt))
    own = F.struct(hash_of(F.col(key), salt).alias("_hash"), F.col(key).alias("_key"))
    joined = df.withColumn("_g", _group(label)).join(table, "_g")
    return joined, [own <= F.col(f"_cut{i}") for i in range(len(shares))]


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.2, salt: str = "42:",
                     require_two: bool = False) -> DataFrame:
    """Add ``split``: of every class, ceil(fraction * size) rows in hash order are 'test'.

    With ``require_two`` a class with one member is an error, raised by the query itself.
    """
    joined, (within,) = _with_cuts(df, key, label, [fraction], salt)
    split = F.when(within, "test").otherwise("train")
    if require_two:
        lonely = F.raise_error(F.concat(F.lit("class with a single member: "), F.col(label)))
        split = F.when(F.col("_size") < 2, lonely).otherwise(split)
    return joined.withColumn("split", split).select(*df.columns, "split")


def three_way_split(df: DataFrame, key: str, label: str, validation: float = 0.1, test: float = 0.2,
                    salt: str = "42:") -> DataFrame:
    """Add ``split`` with the values test, validation and train, per class in one hash order."""
    joined, (first, second) = _with_cuts(df, key, label, [test, test + validation], salt)
    split = F.when(first, "test").when(second, "validation").otherwise("train")
    return joined.withColumn("split", split).select(*df.columns, "split")


def folds(df: DataFrame, key: str, label: str, k: int, iterations: int = 1, salt: str = "42:") -> DataFrame:
    """Add ``fold`` (0..k-1), balanced per class; with several iterations ``fold_1``, ``fold_2``, ..."""
    for i in range(1, iterations + 1):
        ranked = with_rank(df, [label], key, salt if iterations == 1 else f"{salt}{i}:")
        name = "fold" if iterations == 1 else f"fold_{i}"
        df = ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")
    return df


def budget_per_source(df: DataFrame, key: str, source: str, most: int, salt: str = "42:") -> DataFrame:
    """At most ``most // number of sources`` rows of every source, chosen in hash order."""
    sources = df.agg(F.count_distinct(F.coalesce(F.col(source), F.lit("")))).first()[0]
    budget = most // max(sources, 1)
    hashed = df.withColumn("_hash", hash_of(F.col(key), salt))
    return cap(hashed, [source], [F.asc("_hash"), F.asc(key)], budget).drop("_hash")
