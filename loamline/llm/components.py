"""Connected components of links, on the executors.

Links shrink by large-star and small-star rounds until no link changes; what is
left are stars around each component's smallest id.  A round sends each node's
smallest neighbour along its links; the smallest is a partial aggregate, so a
node with very many links costs one row a task.  Every round is a written
table; only counts come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.store import Scratch


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component for links within 0..n-1: union by pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = lo < hi
        if not apart.any():
            break
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(root, hi, lo)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
    return root


def components(links: DataFrame, keep: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of a link, component being the smallest node reachable.  Null ends and loops say nothing."""
    now = keep.save(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = keep.save(large.filter("u < v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        moved = small.filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = keep.save(moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        old, now = now, small
        same = old.count() == now.count() and old.join(now, ["v", "u"], "left_anti").isEmpty()
        keep.free(old)
        keep.free(large)
        if same:
            break
    roots = now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
