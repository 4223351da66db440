"""Main text of web pages by tag-path ratios.

Every text block has a root-to-leaf path of block elements.  Text length, punctuation, links and
blocks are summed per path; their ratios are fused into one score per path, smoothed over the
blocks in page order, and the mean of a path's smoothed scores against a threshold decides which
paths hold content.  Parts that are around a text by element, role or name take no part.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded
from corpuscope.llm.html_blocks import Page, blocks_of

THRESHOLD = 0.1  # of the page's best path
LINKS = 0.6  # a path with this share of its text in links scores nothing
REGION = 0.8  # share of the score that the element taken as the article holds at least
SMOOTHING = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Of each block, the score of its path and the mean of the path's smoothed scores."""
    paths, which = np.unique([b.path for b in page.blocks], return_inverse=True)
    total = lambda values: np.bincount(which, np.array(values, float), len(paths))
    blocks = total([1] * len(page.blocks))
    length = total([len(b.text) for b in page.blocks])
    marks = total([len(PUNCTUATION.findall(b.text)) for b in page.blocks])
    linked = total([b.linked for b in page.blocks])
    fused = length / blocks * (1 + marks / blocks) * np.maximum(0, 1 - linked / length / LINKS)
    scores = fused[which]
    smooth = np.convolve(scores, SMOOTHING, "same") if len(scores) >= len(SMOOTHING) else np.convolve(scores, SMOOTHING, "full")[2:2 + len(scores)]
    smooth = smooth / np.convolve(np.ones(len(scores)), SMOOTHING, "full")[2:2 + len(scores)]
    return scores, (np.bincount(which, smooth, len(paths)) / blocks)[which]


def _articles(page: Page, scores: np.ndarray) -> np.ndarray | None:
    """Blocks of the elements marked as articles that hold the page's text; None where none is marked."""
    region = np.array([b.region for b in page.blocks])
    mass = np.bincount(region[region >= 0], scores[region >= 0], len(page.ranks)) if (region >= 0).any() else np.zeros(0)
    if not mass.any():
        return region >= 0 if (region >= 0).any() else None
    rank = max(r for r, m in zip(page.ranks, mass, strict=True) if m)
    mass = np.where(np.array(page.ranks) == rank, mass, 0)
    return np.isin(region, np.flatnonzero(mass >= mass.max() / 2))


def _holder(page: Page, scores: np.ndarray) -> np.ndarray:
    """Blocks of the deepest path that holds most of the score."""
    paths = np.array([b.path for b in page.blocks])
    parents = page.parents
    mass, depth = np.bincount(paths, scores, len(parents)), np.zeros(len(parents), int)
    for k in range(1, len(parents)):  # a parent's number is smaller than its children's
        depth[k] = depth[parents[k]] + 1
    for k in range(len(parents) - 1, 0, -1):
        mass[parents[k]] += mass[k]
    best = int(np.argmax(np.where(mass >= REGION * mass[0], depth, -1)))
    inside = np.zeros(len(parents), bool)

    def below(path: int) -> np.ndarray:
        inside[path] = True
        for k in range(path + 1, len(parents)):
            inside[k] = inside[parents[k]]
        return inside[paths]

    # paragraphs alone: their parent is the article
    return below(parents[best]) if best and (paths[below(best)] == best).all() else below(best)


def main_text(html: str | None) -> str:
    """The article of one page; blocks are joined by an empty line."""
    page = blocks_of(html or "")
    if not page.blocks:
        return ""
    scores, smooth = path_scores(page)
    inside = _articles(page, scores)
    if inside is None:
        seeds = scores * (smooth >= THRESHOLD * smooth.max())
        # without any score only links are left: there is no article
        inside = _holder(page, seeds) if seeds.any() else np.zeros(len(scores), bool)
    headings = np.array([b.heading for b in page.blocks])
    # inside an article short paths are its own; only lists of links score nothing
    return "\n\n".join(b.text for b, keep in zip(page.blocks, inside & ((scores > 0) | headings), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages``, then text and n_chars (code points of the text).

    NULL, empty and text-free pages give an empty text; pages are read whole, however long; repeated
    rows are each extracted; columns text and n_chars of ``pages`` are replaced; an empty table gives
    no rows.  Pages do not depend on one another, so there is no exchange.
    """
    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda h: main_text(None if pd.isna(h) else h)).astype(object)

    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rest = [name(c) for c in pages.columns if c not in ("text", "n_chars")]
    done = bounded(pages).select(*rest, texts(name(html)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
