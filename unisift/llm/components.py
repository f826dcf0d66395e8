"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps.

Each partition first shrinks its own links to a spanning forest. A round's counts and minima are summed map-side, and
the minima of nodes with very many links are broadcast (fewer than `skew.SHARE`, once there are over `skew.PLAIN` links),
so these links aren't gathered in one task. What a round leaves is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .stage import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label != label[label]).any():
        label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size > 1_000_000:
            a, b = forest(*(np.concatenate(x) for x in zip((a, b), *held, strict=True)))
            held, size = [], 0
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip((a, b), *held, strict=True)))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node, itself left out) of links a, b (bigint)."""
    links = written(links.where("a != b").select("a", "b").mapInArrow(_shrink, "a long, b long"), "links")
    before, total = None, links.count()
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = skew.spread_join(both.where("v > u"), least, "u", "rows", total, plain=skew.PLAIN).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        small = skew.spread_join(large, least, "u", "rows", total, plain=skew.PLAIN).where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = written(small.distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, total = now, now[0]
