"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training takes at most ``max_train`` labelled ids (by a hash of the id, so the same at each run), bins each statistic once and grows trees of fixed depth from bin histograms of
gradients and hessians. A forest is a handful of flat arrays; scoring a batch walks all trees of
all rows at once with numpy. Documents are scored in one pass without a shuffle.

Defined results: a null text scores as an empty one; an empty training set gives 0.5 for all;
repeated rows get equal scores; null labels or ids are not trained on; of several labels or texts of an
id one trains; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hash, tidy
from .textstats import FEATURES, features, stats_table


@dataclass
class Forest:
    """Trees end to end: node k tests ``feature[k]`` against ``cut[k]``; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; rows are walked in blocks so that memory stays bounded."""
        out = [1 / (1 + np.exp(-self.margin(x[i : i + 4096]))) for i in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Forest:
    """Boosted trees for log loss. ``least``: smallest hessian-free row count of a child."""
    if len(y) == 0:
        return Forest(*(np.zeros(1, t) for t in (np.int32, float, np.int32, np.int32, float)), np.zeros(1, np.int32), 0, 0.0)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    flat = binned + np.arange(m) * bins
    rate_1 = (y.sum() + 1) / (n + 2)
    margin = np.full(n, base := float(np.log(rate_1 / (1 - rate_1))))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (cut, np.inf), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(root := node())
        open_nodes = [(root, np.arange(n))]
        for level in range(depth + 1):
            deeper = []
            for k, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = float(-rate * gs / (hs + l2))
                best = None
                if level < depth and len(rows) >= 2 * least:
                    where = flat[rows].ravel()
                    hist = [np.bincount(where, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = (j, b) if gain[j, b] > 1e-6 and b < len(cuts[j]) else None
                if best is None:
                    margin[rows] += value[k]
                    continue
                j, b = best
                feature[k], cut[k], left[k], right[k] = int(j), float(cuts[j][b]), node(), node()
                low = binned[rows, j] <= b
                deeper += [(left[k], rows[low]), (right[k], rows[~low])]
            open_nodes = deeper
    as_ = lambda v, t: np.array(v, t)
    return Forest(as_(feature, np.int32), as_(cut, float), as_(left, np.int32), as_(right, np.int32), as_(value, float), as_(roots, np.int32), depth, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, **how) -> Forest:
    """A forest from at most ``max_train`` labelled ids of ``docs``, those of the least hash.

    An id trains once: with the least of its labels and, of its texts, that of the least hash. The sample's
    ids, which are sent to the executors, and its rows, which come to the driver, are ``max_train`` at most.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.min(F.col(label).cast("double")).alias("y"))
    low = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < least_hash(known.count(), max_train))  # few rows over the bound
    sample = low.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), "k").limit(max_train)

    def run(batches):
        for b in batches:
            x = features(stats_table(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "k", "y"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(text.alias("text"), F.col(id_col).alias("k")).join(F.broadcast(sample), "k")
    one = found.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t")).select("t.text", F.col("k").cast("string").alias("k"), "y")
    rows = one.mapInArrow(tidy(run), "x array<double>, k string, y double").collect()
    rows.sort(key=lambda r: (r.k, r.y, r.x))
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]), **how)


def score(docs: DataFrame, forest: Forest, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text; one pass, no shuffle."""
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches):
        for b in batches:
            s = forest.score(features(stats_table(b.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=[*keep, name])

    return docs.select(F.col(text_col).alias("_text_of_score"), *keep).mapInArrow(tidy(run), schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    forest = train(docs, labels.where(~held))
    out = score(docs, forest)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
