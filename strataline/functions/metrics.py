"""Text metrics. Exact match and unigram overlap over whole tables are plans; BLEU and ROUGE walk token lists in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_to_workers
from .stem import token_stem, with_stems
from .text import strip


def bleu(reference: str, hypothesis: str, order: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU with uniform weights; a precision without a match counts as epsilon over its n-grams."""
    ref, hyp = reference.lower().split(), hypothesis.lower().split()
    if not ref or not hyp:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        have = Counter(zip(*(hyp[i:] for i in range(n)), strict=False))
        want = Counter(zip(*(ref[i:] for i in range(n)), strict=False))
        hits, total = sum((have & want).values()), max(1, len(hyp) - n + 1)
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or epsilon) / total) / order
    return math.exp(logs + min(0.0, 1 - len(ref) / len(hyp)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    rows: dict[str, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & rows.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _f1(hits: int, n_ref: int, n_hyp: int) -> float:
    return 2 * hits / (n_ref + n_hyp) if hits else 0.0


def rouge1(reference: str, hypothesis: str, stem=None) -> float:
    a, b = (Counter(map(stem, _tokens(t)) if stem else _tokens(t)) for t in (reference, hypothesis))
    return _f1(sum((a & b).values()), a.total(), b.total())


def rouge_l(reference: str, hypothesis: str, stem=None) -> float:
    a, b = ([stem(x) for x in _tokens(t)] if stem else _tokens(t) for t in (reference, hypothesis))
    return _f1(lcs_length(a, b), len(a), len(b))


def text_scores(reference: Column, hypothesis: Column, stem=None) -> Column:
    """Struct bleu, rouge1, rougeL of each pair; both texts are read once. Null if either is. stem: a function of a token."""
    ship_to_workers()

    @F.pandas_udf("bleu double, rouge1 double, rougeL double")
    def run(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        known: dict[str, str] = {}

        def tokens(t: str) -> list[str]:
            return _tokens(t) if stem is None else [known.get(x) or known.setdefault(x, stem(x)) for x in _tokens(t)]

        rows = []
        for a, b in zip(ref, hyp, strict=True):
            if a is None or b is None:
                rows.append((None, None, None))
                continue
            x, y = tokens(a), tokens(b)
            hits = sum((Counter(x) & Counter(y)).values())
            rows.append((bleu(a, b), _f1(hits, len(x), len(y)), _f1(lcs_length(x, y), len(x), len(y)) if hits else 0.0))
        return pd.DataFrame(rows, columns=["bleu", "rouge1", "rougeL"]).astype("float64")

    return run(reference, hypothesis)


def batch_score(function) -> Callable[[Column, Column], Column]:
    """A scorer from a function of two lists of texts (references, hypotheses) to a list of numbers, called once per batch:
    the way in for a text encoder's score. Pairs with a null have no score."""

    @F.pandas_udf("double")
    def run(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        ok = ref.notna() & hyp.notna()
        out = pd.Series([None] * len(ref), dtype="float64")
        if ok.any():
            out[ok.to_numpy()] = [float(x) for x in function(ref[ok].tolist(), hyp[ok].tolist())]
        return out

    return run


def exact_match(a: Column, b: Column) -> Column:
    """1 or 0: equal but for white space at the ends."""
    return (strip(a) == strip(b)).cast("int")


def evaluate(predictions: DataFrame, truth: DataFrame, levels=("l0", "l1", "l2"), key: str = "id", scorers=None, stem=token_stem) -> DataFrame:
    """One row per level and metric: level, metric, value, over predictions whose id has a truth row.

    predictions: id, pred_<level>; duplicates count. truth: id, gt_<level>, ord; the last per id counts. Level `all` has the
    numbers of matched and of all predictions; without a match there is `matched` alone.
    scorers: metric name to a function of (reference, hypothesis) columns that takes the place of the default metrics, which are
    BLEU, ROUGE over stemmed tokens (stem=None: as they are) and exact match.
    """
    last = truth.groupBy(key).agg(F.max_by(F.struct(*(f"gt_{x}" for x in levels)), "ord").alias("_g")).select(key, "_g.*")
    both = predictions.join(last, key)
    cols = []
    for x in levels:
        ref, hyp = F.col(f"gt_{x}"), F.col(f"pred_{x}")
        if scorers is None:
            both = both.withColumn(f"_{x}", text_scores(ref, hyp, stem))
            cols += [F.avg(F.col(f"_{x}")[m]).alias(f"{x}/{m}") for m in ("bleu", "rouge1", "rougeL")] + [F.avg(exact_match(ref, hyp)).alias(f"{x}/exact_match")]
        else:
            cols += [F.avg(f(ref, hyp)).alias(f"{x}/{name}") for name, f in scorers.items()]
    total = predictions.agg(F.count("*").cast("double").alias("_total"))  # one row
    flat = both.agg(F.count("*").cast("double").alias("all/matched"), *cols).join(F.broadcast(total))
    flat = flat.withColumn("all/total_predictions", F.when(F.col("all/matched") > 0, F.col("_total"))).drop("_total")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in flat.columns)))
    rows = flat.select(pairs.alias("p")).select(F.split_part("p.name", F.lit("/"), F.lit(1)).alias("level"), F.split_part("p.name", F.lit("/"), F.lit(2)).alias("metric"), "p.value")
    return rows.where(F.col("value").isNotNull())


def rouge1_table(df: DataFrame, key: str, reference: str, hypothesis: str, stemmed: bool = False) -> DataFrame:
    """(key, rouge1) for texts of any length: token counts of both sides meet by token, so the work is linear in the text.

    stemmed: each distinct token is stemmed once, and counts are those of stems.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    side = lambda c, n: df.select(key, F.explode(words(c)).alias("_w"), F.lit(1 if n == 0 else 0).alias("a"), F.lit(n).alias("b"))
    counts = side(reference, 0).unionByName(side(hypothesis, 1)).groupBy(key, "_w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    if stemmed:
        counts = with_stems(counts, "_w", "_s").groupBy(key, "_s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("hits"), F.sum(F.col("a") + F.col("b")).alias("n"))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(2.0 * F.col("hits") / F.col("n"), F.lit(0.0)).alias("rouge1"))
