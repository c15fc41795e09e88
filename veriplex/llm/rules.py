"""Operator 3, quality classifier: a sparse rule ensemble.

Statistics of each whole text are Spark column expressions. On a bounded sample of labelled rows (SAMPLE, by a hash of
doc_id) small regression trees are grown on residuals; every path from a root to a node becomes a conjunctive rule over
the statistics; an L1-penalised logistic regression (FISTA) weighs the rules, most of them zero; the rules that stay are
compiled back into one Spark column expression, so scoring runs without Python.

Defined cases: null text is the empty text, and is scored like any other; a null doc_id is not held out; labels that
are null, or without a document, are ignored, and of several labels of a doc_id the largest counts; with labels of one
kind only, or none, every score is the share of ones (0.5 without labels); repeated rows get equal scores; extra columns
are ignored by the query and kept by the filter; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, boxed, table, text_of, unboxed

#: Labelled rows that the ensemble is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3

_COUNTS = {
    "words": WORD,
    "letters": r"\p{L}",
    "capitals": r"\p{Lu}",
    "digits": r"[0-9]",
    "marks": r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'\"?!()-]",
    "points": r"[.,;:?!]",
    "shouts": r"[!?]{2,}",
    "lines": r"\n",
    "short": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])",
    "long": r"[^\x20\x09-\x0D]{16,}",
    "links": r"https?://|www\.|@",
}


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name; all are finite doubles, 0 for the empty text."""
    n = {k: F.regexp_count(text, F.lit(v)).cast("double") for k, v in _COUNTS.items()}
    chars, words = F.greatest(F.char_length(text), F.lit(1)).cast("double"), F.greatest(n["words"], F.lit(1.0))
    folded = F.split(F.lower(text), SPACE + "+")
    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "log_words": F.log1p(n["words"]),
        "word_length": chars / words,
        "capitals": n["capitals"] / F.greatest(n["letters"], F.lit(1.0)),
        "letters": n["letters"] / chars,
        "digits": n["digits"] / chars,
        "marks": n["marks"] / words,
        "points": n["points"] / words,
        "shouts": n["shouts"] / words,
        "lines": n["lines"] / words,
        "short": n["short"] / words,
        "long": n["long"] / words,
        "links": n["links"] / words,
        "distinct_words": F.size(F.array_distinct(folded)) / F.size(folded),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut): all must hold


def _tree(x: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grows a regression tree on y, adds the path of every node to rules, and writes the leaf means to out."""
    if path:
        rules.append(path)
    best = (1e-9, 0, 0.0)
    total, n = y[rows].sum(), len(rows)
    if depth and n >= 40:
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[rows, j], side="left")  # x <= cut[i] exactly if at <= i
            count = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
            left = np.cumsum(np.bincount(at, weights=y[rows], minlength=len(cut) + 1))[:-1]
            ok = (count >= 15) & (n - count >= 15)
            if ok.any():
                gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(cut[i]))
    if best[0] <= 1e-9:
        out[rows] = total / max(n, 1)
        return
    _, j, cut = best
    above = x[rows, j] > cut
    for side in (False, True):
        _tree(x, cuts, y, rows[above == side], depth - 1, (*path, (j, side, cut)), rules, out)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.stack([reduce(np.logical_and, [(x[:, j] > cut) == side for j, side, cut in rule]) for rule in rules], axis=1).astype(float)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 3) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]) of the sparse ensemble; deterministic."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)), []
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    rules: list[Rule] = []
    margin = np.zeros(len(y))
    for _ in range(trees):
        own = np.sort(draw.choice(len(y), max(1, int(len(y) * 0.7)), replace=False))
        leaf = np.zeros(len(y))
        paths: list[Rule] = []
        _tree(x, cuts, y - 1 / (1 + np.exp(-margin)), own, depth, (), paths, leaf)
        rules += paths
        for path in paths:  # rows out of the draw take the mean of the deepest node that they reach
            inside = holds([path], x)[:, 0] > 0
            if (inside[own]).any():
                leaf[inside] = leaf[own][inside[own]].mean()
        margin += 1.0 * leaf
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    z = holds(rules, x) if rules else np.zeros((len(y), 0))
    mean = z.mean(axis=0)
    weight, bias = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    step = 4.0 / (np.linalg.norm(np.c_[z - mean, np.ones(len(y))], 2) ** 2 / len(y))
    look_w, look_b, t = weight, bias, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-((z - mean) @ look_w + look_b)))
        new_w = look_w - step * ((z - mean).T @ (p - y)) / len(y)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = look_b - step * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_new * (new_w - weight), new_b + (t - 1) / t_new * (new_b - bias)
        weight, bias, t = new_w, new_b, t_new
    kept = [(float(w), r) for w, r in zip(weight, rules, strict=True) if w]
    return float(bias - mean @ weight), kept


def compile_rules(model: tuple[float, list[tuple[float, Rule]]], stats: list[Column]) -> Column:
    """The score, 0 to 1, as one column expression over the statistics."""
    bias, rules = model
    margin = F.lit(bias)
    for weight, rule in rules:
        margin = margin + F.when(reduce(lambda a, b: a & b, [(stats[j] > cut) if side else (stats[j] <= cut) for j, side, cut in rule]), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q"))
    ids = ids.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__q").alias("__q"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("__id"))  # SAMPLE rows at most
    stats = statistics(text_of())
    got = rows.select(F.col("__id"), F.col("__q").cast("double"), *[v.alias(f"__{k}") for k, v in stats.items()]).orderBy(F.xxhash64("__id"), "__id").limit(sample).toPandas()
    return got.iloc[:, 2:].to_numpy(float), got["__q"].to_numpy(float)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(row, id, text, score): row is a struct of the columns of docs."""
    return with_score(boxed(docs), fit_rules(*sample_of(docs.select("doc_id", "text"), labels, sample)))


def with_score(rows: DataFrame, model) -> DataFrame:
    """rows (text and what else) with a column ``score``."""
    stats = {f"st_{k}": v for k, v in statistics(F.col("text")).items()}
    used = {j for _, rule in model[1] for j, _, _ in rule}
    names = list(stats)
    out = rows.withColumns({k: v for j, (k, v) in enumerate(stats.items()) if j in used}) if used else rows
    # As the row of a generator: a filter on the score then stays above the statistics, instead of being pushed below them
    # with all their expressions written out once for every rule.
    return out.withColumn("score", F.explode(F.array(compile_rules(model, [F.col(k) for k in names])))).drop(*names)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more; same columns."""
    return unboxed(scored(docs, labels).where(F.col("score") >= THRESHOLD))
