"""A sparse rule ensemble for text quality (operator 5), compiled into Spark column expressions.

Boosted trees are grown on statistics of labelled texts; each path from a root is a rule, a conjunction of
comparisons. Lasso logistic regression keeps few rules. The score of any text is then an expression over its statistics
that runs inside Spark's generated code. Only a bounded sample of labelled rows reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty


def _times(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign)))).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Counts of a whole text. Ratios are taken from them in `ratios`."""
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "words": words,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        "digits": F.regexp_count(text, F.lit(r"\p{N}")).cast("double"),
        "signs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()|\-]")).cast("double"),
        "bangs": _times(text, "!"), "bars": _times(text, "|"), "stops": _times(text, "."), "lines": _times(text, "\n") + 1,
        "kinds": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double"),
    }


RATIOS = {
    "chars": ("chars", None), "words": ("words", None), "word_length": ("chars", "words"), "capitals": ("capitals", "chars"), "digits": ("digits", "chars"),
    "signs": ("signs", "words"), "bangs": ("bangs", "words"), "bars": ("bars", "words"), "stops": ("stops", "words"), "lines": ("lines", "words"), "kinds": ("kinds", "words"),
}


def counted(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """The kept columns and the statistics of the text, which are counted once a row: a filter on what is made of them
    goes no deeper than the generator that gives them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in statistics(text).items()]))))


def ratios(df: DataFrame) -> DataFrame:
    return df.select("*", *[(F.col(a) / F.greatest(F.col(b), F.lit(1.0)) if b else F.col(a)).alias(f"f_{k}") for k, (a, b) in RATIOS.items()])


Rule = tuple[tuple[str, bool, float], ...]  # (feature, whether above, threshold), all of which hold


@dataclass(frozen=True)
class RuleModel:
    base: float
    weights: dict[Rule, float]

    def column(self) -> Column:
        """The score as an expression over the columns that ratios() makes."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [F.col(f"f_{f}") > t if above else F.col(f"f_{f}") <= t for f, above, t in rule])

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights.items()], F.lit(self.base))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """The score of rows of features, for choosing among settings on the driver."""
        total = np.full(len(x), self.base)
        for rule, w in self.weights.items():
            total += w * reduce(np.logical_and, [(x[:, names.index(f)] > t) == above for f, above, t in rule])
        return 1 / (1 + np.exp(-total))


def _grow(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree: its paths as [(feature, above, threshold), ...], and its prediction for all rows of x."""
    paths: list[tuple] = []
    out = np.zeros(len(x))

    def split(rows: np.ndarray, everything: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        best = (1e-9, -1, 0.0)
        g = gradient[rows]
        total, n = g.sum(), len(rows)
        if len(path) < depth and n >= 2 * least:
            for f in features:
                v = x[rows, f]
                at = np.searchsorted(cuts[f], v, side="left")
                left_n = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
                left_g = np.cumsum(np.bincount(at, g, minlength=len(cuts[f]) + 1))[:-1]
                ok = (left_n >= least) & (n - left_n >= least)
                if ok.any():
                    a, b = np.maximum(left_n, 1), np.maximum(n - left_n, 1)
                    gain = np.where(ok, left_g**2 / a + (total - left_g) ** 2 / b - total**2 / n, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0] * (1 + 1e-9):
                        best = (float(gain[k]), int(f), float(cuts[f][k]))
        if best[1] < 0:
            out[everything] = total / max(n, 1)
            return
        _, f, t = best
        split(rows[x[rows, f] > t], everything[x[everything, f] > t], (*path, (f, True, t)))
        split(rows[x[rows, f] <= t], everything[x[everything, f] <= t], (*path, (f, False, t)))

    split(rows, np.arange(len(x)), ())
    return paths, out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradient."""
    n, base = len(y), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w = np.zeros(r.shape[1])
    size = 4.0 / (np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2 / n)
    v, vb, t, old, old_b = w.copy(), base, 1.0, w, base
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + vb)))
        b = vb - size * float((p - y).mean())
        w = v - size * (r.T @ (p - y)) / n
        w = np.sign(w) * np.maximum(np.abs(w) - size * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = w + (before - 1) / t * (w - old), b + (before - 1) / t * (b - old_b)
        old, old_b = w, b
    return old_b, old


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 20, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    """Without labels every score is one half; with labels of one kind only, their (smoothed) rate."""
    n = len(y)
    if n == 0:
        return RuleModel(0.0, {})
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return RuleModel(base, {})
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 99))) for f in range(x.shape[1])]
    total, rules, least = np.full(n, base), {}, max(1, min(20, n // 50))
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-total))
        rows = np.sort(rng.choice(n, max(2, n // 2), replace=False))
        features = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        paths, out = _grow(x, gradient, rows, cuts, features, depth, least)
        total += 0.5 * 4 * out
        for path in paths:
            rules.setdefault(tuple(sorted(path)), None)
    masks = {p: reduce(np.logical_and, [x[:, f] > t if above else x[:, f] <= t for f, above, t in p]) for p in rules}
    seen: dict[bytes, tuple] = {}
    for p, m in masks.items():  # rules that hold for the same rows count once: the shortest is kept
        key = np.packbits(m).tobytes()
        if 0 < m.sum() < n and (key not in seen or len(p) < len(seen[key])):
            seen[key] = p
    kept = list(seen.values())
    if not kept:
        return RuleModel(base, {})
    intercept, w = _lasso(np.column_stack([masks[p] for p in kept]).astype(float), y, penalty)
    return RuleModel(intercept, {tuple((names[f], above, t) for f, above, t in p): float(v) for p, v in zip(kept, w) if abs(v) > 1e-6})


def choose(x: np.ndarray, y: np.ndarray, names: list[str], settings: list[dict], folds: int = 5, seed: int = 3) -> dict:
    """Of the settings whose log loss over folds of the training rows is within one standard error of the best, the one
    with the fewest rules (the first of several). Rows that learning never sees take no part."""
    fold, found = np.random.default_rng(seed).integers(0, folds, len(y)), []
    for options in settings:
        loss, rules = [], []
        for k in range(folds):
            model, at = fit(x[fold != k], y[fold != k], names, **options), fold == k
            p = np.clip(model.predict(x[at], names), 1e-9, 1 - 1e-9)
            loss.append(-float(np.mean(np.where(y[at] == 1, np.log(p), np.log(1 - p)))))
            rules.append(len(model.weights))
        found.append((float(np.mean(loss)), float(np.std(loss, ddof=1)) / folds**0.5, float(np.mean(rules))))
    best, error, _ = min(found)
    return settings[min((rules, k) for k, (loss, _, rules) in enumerate(found) if loss <= best + error)[1]]


def held_out(id_col: str) -> Column:
    """The fold that learning never sees: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> RuleModel:
    """Fit on at most `sample` labels outside the held-out fold, those with the smallest hash of the id. Repeated labels
    count once; of several texts with one id, the one with the least statistics stands for all. Null labels, labels
    with a null id and those without a document teach nothing."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).distinct()
    chosen = known.orderBy(F.xxhash64(F.col("id")), "id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    names = list(RATIOS)
    rows = ratios(counted(texts, ["id", "y"], F.col("text"))).groupBy("id", "y").agg(F.min(F.struct(*[f"f_{k}" for k in names])).alias("f"))
    found = np.array(sorted(tuple(map(float, r)) for r in rows.select("id", "y", "f.*").collect())).reshape(-1, len(names) + 2)  # `sample` rows at most
    return fit(found[:, 2:], found[:, 1], names)


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold). Null texts are scored as empty. Columns of docs named
    like these two are replaced; all others, whatever their names, stay as they are."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    packed = docs.select(F.struct(*own).alias("_row"), text_or_empty(text_col).alias("_text"))
    rows = ratios(counted(packed, ["_row"], F.col("_text")))
    scored = rows.select("_row", model.column().alias("score"))
    return scored.select("_row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
