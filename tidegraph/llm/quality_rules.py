"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. The rules' accuracies
are not given: expectation-maximisation over the counts of vote patterns of all documents estimates
them, and a document is kept by its posterior probability of being good instead of having to pass
all rules. Pass 1 counts patterns (each task sends its distinct patterns, at most 3 to the number of
rules in all); pass 2 scores. Neither shuffles texts. ``counted`` makes the statistics, which can be written
once for both passes.

Defined results: null text has no words; texts that fail the base rules are never kept; an empty
table gives an empty result; repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy, written
from .textstats import NAMES, stats_table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(table: np.ndarray) -> np.ndarray:
    """One column of votes for each rule of RULES."""
    c = dict(zip(NAMES, table.T, strict=True))
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_up"] + c["n_low"], 1)
    some = c["n_words"] >= 10
    length = c["word_chars"] / words
    up = c["n_up"] / letters
    sym = c["n_symbols"] / words
    fn = c["n_function"] / words
    dots = c["n_dots"] / words
    return np.column_stack([
        _vote(sym < 0.05, sym > 0.3),
        _vote(c["n_bang"] / words < 0.05, c["n_bang"] / words > 0.25),
        _vote(up < 0.2, up > 0.5),
        _vote((c["n_dup_lines"] == 0) & (c["n_lines"] >= 3), c["n_dup_lines"] / lines > 0.3),
        _vote((c["n_repeat_words"] / words < 0.02) & some, c["n_repeat_words"] / words > 0.15),
        _vote((length > 3) & (length < 9) & some, (length < 2) | (length > 14)),
        _vote((fn > 0.12) & some, (fn < 0.02) & some),
        _vote((dots > 0.03) & (dots < 0.4), (dots < 0.005) & (c["n_words"] >= 30)),
        _vote(np.zeros(len(table), bool), c["n_pipe"] / words > 0.1),
        _vote((c["n_capital"] / words > 0.03) & (c["n_capital"] / words < 0.35), c["n_capital"] / words > 0.7),
        _vote(c["n_line_ends"] / lines > 0.7, (c["n_line_ends"] / lines < 0.2) & some),
    ])


RULES = ("symbols", "exclamations", "capital_letters", "repeated_lines", "repeated_words", "word_length", "function_words", "full_stops", "tables", "capitalised", "line_ends")


class LabelModel:
    """Prior of good documents and, for each rule, how often it votes bad on good and on bad ones.

    ``bad_on_good`` and ``bad_on_bad`` are the rule's two error rates where it does not abstain;
    an abstention says nothing.
    """

    def __init__(self, prior: float, bad_on_good: np.ndarray, bad_on_bad: np.ndarray):
        self.prior, self.bad_on_good, self.bad_on_bad = prior, bad_on_good, bad_on_bad

    def posterior(self, v: np.ndarray) -> np.ndarray:
        up = np.log((1 - self.bad_on_good) / (1 - self.bad_on_bad))
        down = np.log(self.bad_on_good / self.bad_on_bad)
        odds = np.log(self.prior / (1 - self.prior)) + (v > 0) @ up + (v < 0) @ down
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_em(patterns: dict[bytes, int], n_rules: int, steps: int = 300, tol: float = 1e-8) -> LabelModel:
    """Both rates of each rule and the share of good documents, by expectation-maximisation.

    Starts from rules that rarely accuse good documents. A rule is held to be better than chance
    (``bad_on_bad`` at least twice ``bad_on_good``, rates in [0.0005, 0.95]) and the prior in
    [0.05, 0.95], which keeps the two classes from changing places. No votes: the start stays.
    """
    model = LabelModel(0.8, np.full(n_rules, 0.02), np.full(n_rules, 0.4))
    if not patterns:
        return model
    order = sorted(patterns)
    v = np.array([np.frombuffer(p, np.int8) for p in order], float)
    w = np.array([patterns[p] for p in order], float)
    for _ in range(steps):
        q = model.posterior(v)
        good, bad = (w * q)[:, None], (w * (1 - q))[:, None]
        on_good = ((good * (v < 0)).sum(0) + 0.2) / ((good * (v != 0)).sum(0) + 10)
        on_bad = ((bad * (v < 0)).sum(0) + 4) / ((bad * (v != 0)).sum(0) + 10)
        on_good = np.clip(on_good, 0.0005, 0.4)
        on_bad = np.clip(np.maximum(on_bad, 2 * on_good), 0.0005, 0.95)
        prior = float(np.clip((w * q).sum() / w.sum(), 0.05, 0.95))
        moved = max(abs(prior - model.prior), float(np.abs(on_good - model.bad_on_good).max()), float(np.abs(on_bad - model.bad_on_bad).max()))
        model = LabelModel(prior, on_good, on_bad)
        if moved < tol:
            break
    return model


_STATS = "_stats_of_rules"


def counted(docs: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of ``docs`` and, last, an array of the counts of NAMES for every whole text."""
    columns = tuple(columns)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(_STATS, T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            table = stats_table(b.column(0).to_pylist()).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(NAMES)), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], flat], names=schema.fieldNames())

    return docs.select(F.col(text_col).alias("_text_of_rules"), *columns).mapInArrow(tidy(run), schema)


def _table(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)


def learn_counted(rows: DataFrame) -> LabelModel:
    """The label model of all rows of a table of ``counted``."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            seen.update(x.tobytes() for x in votes(_table(b.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    found = rows.select(_STATS).mapInArrow(tidy(count), "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit_em({bytes(r.pattern): r.n for r in found}, len(RULES))


def judge_counted(rows: DataFrame, model: LabelModel, only_kept: bool = False, least_words: int = 10, most_repeated: int = 20, threshold: float = 0.5) -> DataFrame:
    """The columns of a table of ``counted`` with the base counts, ``base_failed``, ``kept`` and ``quality_probability``.

    With ``only_kept`` the rejected rows go and nothing is added.
    """
    own = [c for c in rows.columns if c != _STATS]
    added = T.StructType().add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long").add("n_repeat_words", "long").add("base_failed", "boolean").add("kept", "boolean").add("quality_probability", "double")
    schema = T.StructType([*rows.select(*own).schema.fields, *([] if only_kept else added.fields)])
    names = schema.fieldNames()

    def run(batches):
        for b in batches:
            table = _table(b.column(0))
            c = {k: table[:, NAMES.index(k)].astype(np.int64) for k in BASE}
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
            p = model.posterior(votes(table))
            kept = ~failed & (p >= threshold)
            if only_kept:
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=names).filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(p)], names=names)

    return rows.select(_STATS, *own).mapInArrow(tidy(run), schema)


def learn(docs: DataFrame, text_col: str = "text") -> LabelModel:
    return learn_counted(counted(docs, text_col))


def judge(docs: DataFrame, model: LabelModel, text_col: str = "text", columns: tuple[str, ...] = (), **how) -> DataFrame:
    """``judge_counted`` for documents; ``columns``: those to keep, all by default."""
    return judge_counted(counted(docs, text_col, tuple(columns) or tuple(docs.columns)), model, **how)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = written(counted(docs, columns=("doc_id",)), "rule-counts")  # texts are gone through once
    return judge_counted(rows, learn_counted(rows))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    small_batches(spark)
    return judge(docs, learn(docs), columns=tuple(docs.columns), only_kept=True)
