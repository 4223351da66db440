"""Quality classification by hierarchical empirical Bayes.

A logistic model gives every document evidence for each target (well written; not toxic).  The
share of good documents of a host, and of each path on it, is a posterior mean: a site's own mean
evidence shrunk towards its parent's by a weight that is fitted to how much sites really differ,
so sparse sites stay near the global prior and large ones speak for themselves.  A document's
posterior combines its path's share with its own evidence.

Sites are only ever summed: partial sums in each task, then one row per site.  The model alone is
fitted on a bounded sample of labelled rows; everything else uses all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded, in_row, out_of_row, row_schema
from corpuscope.llm.shingles import text_chunks, word_hashes
from corpuscope.sources.shared import stored

MOST_LABELLED = 12_000  # labelled rows that the model is fitted on, by hash of their id
MOST_WORDS = 512
LEAST_Z = 4.5
TARGETS = ("quality", "clean")
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "bang": [33], "bar": [124], "sign": [*b"#$%&*<>=@^_~\\{}[]"], "stop": [*b".,;:?"],
            "line": [10]}
STYLES = len(_CLASSES) + 3
_CLASS_OF = np.zeros((len(_CLASSES), 256), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[_i, list(_bytes)] = 1


@dataclass
class Model:
    """Weights of the style features and words, for each target."""
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # (targets, 1 + style features + words)
    prior: np.ndarray  # log odds of each target in the sample

    def evidence(self, column) -> np.ndarray:
        """Log likelihood ratio of each text, for each target."""
        out = []
        for style, row, word in features(column, self.words):
            own = np.zeros((len(self.weights), len(style)))
            own += self.weights[:, :1] + self.weights[:, 1:1 + style.shape[1]] @ style.T
            for k, w in enumerate(self.weights[:, 1 + style.shape[1]:]):
                own[k] += np.bincount(row, w[word], minlength=len(style))
            out.append(own - self.prior[:, None])
        return np.concatenate(out, 1) if out else np.zeros((len(self.weights), 0))


def style_of(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of character classes and words per byte and of words like the one before, and whether a text is short."""
    size = np.maximum(np.diff(offsets), 1)
    rows = []
    for table in _CLASS_OF:
        total = np.r_[0, np.cumsum(table[data])]
        rows.append(np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / size))
    rows.append(np.sqrt(np.diff(at) / size))
    again = np.r_[0, np.cumsum(np.r_[False, h[1:] == h[:-1]][: len(h)])]
    rows.append(np.sqrt((again[at[1:]] - again[at[:-1]]) / np.maximum(np.diff(at), 1)))
    rows.append((np.diff(offsets) < 40).astype(float))
    return np.stack(rows, 1)


def features(column, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(style, row, word): of some texts at a time, which of the chosen words each has."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(words >> np.uint64(48)).astype(np.int64)] = True
    for _, data, offsets in text_chunks(column):
        h, at, _ = word_hashes(data, offsets, plain=True)
        near = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(words, h[near]), max(len(words) - 1, 0))
        near, place = (x[words[place] == h[near]] for x in (near, place)) if len(words) else (near, place)
        row = np.searchsorted(at, near, "right") - 1
        pair = np.unique(row * max(len(words), 1) + place)
        yield style_of(data, offsets, h, at), pair // max(len(words), 1), pair % max(len(words), 1)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, targets, words, style of at most ``most`` labelled documents."""
    import pyarrow as pa

    chosen = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              .select("doc_id", F.array(F.col("quality") > 0, F.col("toxic") <= 0).alias("targets")))
    # at most ``most`` rows of a number and two booleans
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, style = [], []
            for _, data, offsets in text_chunks(batch.column(1)):
                h, at, _ = word_hashes(data, offsets, plain=True)
                words += [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
                style += list(style_of(data, offsets, h, at))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.int64())), pa.array(style, pa.list_(pa.float64()))],
                names=["doc_id", "targets", "words", "style"])

    return rows.select("doc_id", "text", "targets").mapInArrow(
        describe, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, targets array<boolean>, words array<long>, style array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's steps; the first is the constant."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The document model.  Without labels its evidence is 0.

    Words are those whose presence changes a target's share by ``LEAST_Z`` standard errors or more,
    at most MOST_WORDS; the design matrix has at most ``most`` rows.
    """
    rows = stored(_labelled(docs, labels, most), "labelled")
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("targets", F.lit(k)).cast("long")).alias(t) for k, t in enumerate(TARGETS)]).first()
    n = totals["n"]
    share = [(totals[t] or 0) / n if n else 1.0 for t in TARGETS]
    prior = np.array([np.log(((totals[t] or 0) + 1) / (n - (totals[t] or 0) + 1)) for t in TARGETS])
    z = [F.abs(F.sum(F.get("targets", F.lit(k)).cast("double")) - F.count("*") * s) / F.sqrt(F.count("*") * s * (1 - s) + 1e-9)
         if 0 < s < 1 else F.lit(0.0) for k, s in enumerate(share)]
    chosen = (rows.select("targets", F.explode("words").alias("word")).groupBy("word")
              .agg(F.count("*").alias("n"), F.greatest(*z).alias("z")).where(f"n >= 5 AND z >= {LEAST_Z}")
              .orderBy(F.desc("z"), "word").limit(MOST_WORDS).collect())
    words = np.sort(np.array([r["word"] for r in chosen], np.int64).view(np.uint64))
    known = F.array_intersect("words", F.array(*[F.lit(w) for w in words.view(np.int64).tolist()]).cast("array<bigint>"))
    sample = rows.select("doc_id", "targets", "style", known.alias("words")).orderBy("doc_id").collect()
    width = STYLES + len(words)
    x = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        x[i, : STYLES] = r["style"]
        x[i, STYLES + np.searchsorted(words, np.array(r["words"], np.int64).view(np.uint64))] = 1
    weights = np.zeros((len(TARGETS), width + 1))
    for k in range(len(TARGETS)):
        y = np.array([r["targets"][k] for r in sample], float)
        if 0 < y.sum() < len(y):
            weights[k] = _logistic(x, y)
        else:
            weights[k, 0] = prior[k]
    return Model(words, weights, prior)


def with_evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """``docs`` as a struct ``row`` and its text, host and path, with the log likelihood ratio of each target."""
    import pyarrow as pa

    site = [F.coalesce(c.cast("string"), F.lit("")).alias(name) for c, name in ((host, "host"), (path, "path"))]
    packed = bounded(docs).select(in_row(docs, "text"), "text", *site)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.evidence(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(e) for e in found]], names=["row", "text", "host", "path", *TARGETS])

    return packed.mapInArrow(score, row_schema(packed, "text string, host string, path string, " + ", ".join(f"{t} double" for t in TARGETS)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, model: Model) -> DataFrame:
    """host, path and the posterior share of good documents there, for each target.

    ``scored`` has host, path and each target's evidence.  One row per path.
    """
    shares = [(1 / (1 + F.exp(-(F.col(t) + float(p))))).alias(t) for t, p in zip(TARGETS, model.prior)]
    paths = stored(scored.select("host", "path", *shares).groupBy("host", "path").agg(
        F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    total = hosts.agg(F.sum("host_n").alias("n"), F.count("*").alias("sites"), *[F.sum(f"host_{t}").alias(t) for t in TARGETS]).first()
    n = total["n"] or 1
    mean = {t: min(max((total[t] or 0) / n, 1e-4), 1 - 1e-4) for t in TARGETS}

    def weight(rows: DataFrame, size: str, own: str, parent: Column, p: float) -> float:
        """Pseudo-documents of the parent that a site's own mean is weighed against (method of moments)."""
        r = rows.agg(F.count("*").alias("sites"), F.sum(F.col(size) * (F.col(own) / F.col(size) - parent) ** 2).alias("spread")).first()
        between = (r["spread"] or 0) / n - r["sites"] * p * (1 - p) / n
        return min(max(p * (1 - p) / max(between, 1e-9) - 1, 1.0), 1e6)

    for t in TARGETS:
        k = weight(hosts, "host_n", f"host_{t}", F.lit(mean[t]), mean[t])
        hosts = hosts.withColumn(f"host_{t}", (F.col(f"host_{t}") + k * mean[t]) / (F.col("host_n") + k))
    rows = paths.join(hosts, "host")
    for t in TARGETS:
        k = weight(rows, "n", t, F.col(f"host_{t}"), mean[t])
        rows = rows.withColumn(f"path_{t}", (F.col(t) + k * F.col(f"host_{t}")) / (F.col("n") + k))
    return rows.select("host", "path", *[f"{level}_{t}" for t in TARGETS for level in ("host", "path")])


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = MOST_LABELLED) -> DataFrame:
    """The columns of ``docs`` with posteriors of both targets and keep.

    ``docs`` needs doc_id and text; ``host`` and ``path`` are expressions over it, NULL counting as
    ''.  keep means that both posteriors are at least one half.  NULL texts are empty ones and are
    judged like other short texts; repeated rows get equal results; labels without a document, or
    with NULLs, are left aside, and of several for a document the worst counts; columns of ``docs``
    named like the new ones (host_*, path_*, evidence_*, posterior_*, keep) are replaced.
    """
    model = fit(docs, labels, most)
    sited = with_evidence(docs, model, host, path)
    # stored, so that Spark knows the size when it chooses how to join
    sites = stored(site_posteriors(sited, model), "sites")
    done = sited.join(sites, ["host", "path"])
    posterior = {t: 1 / (1 + F.exp(-(F.col(t) + _logit(F.col(f"path_{t}"))))) for t in TARGETS}
    new = {f"{level}_{t}": F.col(f"{level}_{t}") for t in TARGETS for level in ("host", "path")}
    new |= {f"evidence_{t}": F.col(t) for t in TARGETS} | {f"posterior_{t}": posterior[t] for t in TARGETS}
    new["keep"] = (posterior["quality"] >= 0.5) & (posterior["clean"] >= 0.5)
    return done.select(*out_of_row(docs, *new), *[c.alias(name) for name, c in new.items()])
