"""Statistics as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FACET_CAP, PAIR_CAP = 2000, 200
WEIGHTS = {"crowding": 0.45, "facet_rarity": 0.35, "llm_predictability": 0.20}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def rarity_from_df(df: Column, cap: int = FACET_CAP) -> Column:
    """1 for a count of 0, 0 from the cap on, logarithmic between."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    return clamp(1 - F.log1p(F.greatest(F.lit(0), df).cast("double")) / math.log1p(cap))


def idf(n: Column, df: Column) -> Column:
    return F.when(n > 0, F.log((n + 1) / (F.greatest(F.lit(0), df) + 1))).otherwise(0.0)


def npmi(n: Column, a: Column, b: Column, ab: Column) -> Column:
    """Normalised pointwise mutual information of counts; -1 if never together, null without documents or marginals."""
    joint = F.least(ab, a, b)
    p = joint / n
    value = F.log(p * n * n / (a * b).cast("double")) / -F.log(p)
    return F.when((n <= 0) | (a <= 0) | (b <= 0), F.lit(None)).when(joint <= 0, -1.0).when(joint >= n, 1.0).otherwise(clamp(value, -1.0, 1.0))


def atypicality(x: Column) -> Column:
    return (1 - clamp(x, -1.0, 1.0)) / 2


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def from_rerank(s: Column) -> Column:
    """Raw score of a reranker whose service made it positive: 1 + s above 0, exp(s) below."""
    return F.when(s >= 1, s - 1).when(s > 0, F.log(s)).otherwise(-1.0)


# Quantile of the calibration that a reader's grade lifts a hit to, and the share of its own score above it.
GRADE_QUANTILES, GRADE_SPREAD = {"same": 0.95, "close": 0.75}, 0.25


def graded(score: Column, grade: Column, floors: dict[str, Column]) -> Column:
    """Similarity of a hit that a reader graded: at least the floor of its grade plus a share of its own score. ``floors``: quantile values by grade."""
    floor = F.lit(None).cast("double")
    for name, value in floors.items():
        floor = F.when(grade == name, value).otherwise(floor)
    return F.when(floor.isNull(), clamp(score)).otherwise(clamp(F.greatest(score, floor + GRADE_SPREAD * score)))


# Similarity of a typical nearest neighbour, and of one closer than 95 % of them.
MATCH_MID, MATCH_HIGH = 0.156, 0.365


def match_scale(similarity: Column) -> Column:
    """Similarity on a scale where MATCH_MID is one half and MATCH_HIGH nine tenths."""
    return logistic_percentile(similarity, MATCH_MID, math.log(9) / (MATCH_HIGH - MATCH_MID))


def moments(logprobs: Column) -> Column:
    """struct(mean, variance) of log probabilities under their own renormalised weights; null below two."""
    top = F.array_max(logprobs)
    weights = F.transform(logprobs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.zip_with(weights, logprobs, lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x) / total
    square = F.aggregate(F.zip_with(weights, logprobs, lambda w, x: w * x * x), F.lit(0.0), lambda a, x: a + x) / total
    return F.when(F.size(logprobs) >= 2, F.struct(mean.alias("mean"), F.greatest(F.lit(0.0), square - mean * mean).alias("variance")))


def curvature_class(percentile: Column, fpr: float = 0.05) -> Column:
    """Machine-like above the quantile of human text that leaves a share ``fpr`` of false alarms; null without a reference."""
    return F.when(percentile.isNull(), F.lit(None)).when(percentile >= 1 - fpr, "ai").otherwise("human")


def detector_agreement(other: Column, curvature: Column) -> Column:
    """Whether two detectors agree; a mixed verdict counts as machine-written."""
    return F.when(other.isNull() | curvature.isNull(), "unknown").when(other.isin("ai", "mixed") == (curvature == "ai"), "agree").otherwise("disagree")


def resample_count(k: Column, n: Column, *key: Column) -> Column:
    """A count drawn anew, binomial by its normal limit, from a hash of the key."""
    p = k / n
    z = normal_draw(uniform(*key, F.lit("a")), uniform(*key, F.lit("b")))
    drawn = F.round(k + z * F.sqrt(k * (1 - p)))
    return F.when((n <= 0) | (k <= 0), F.lit(0)).when(k >= n, n).otherwise(F.greatest(F.lit(0), F.least(n, drawn))).cast("long")


def logistic_percentile(x: Column, mid: float = 0.5, slope: float = 8.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - mid)))


def crowding_lite(sims: Column) -> Column:
    """0.6 of the largest and 0.4 of the mean of the five largest; 0 without any."""
    top = F.slice(F.sort_array(F.filter(sims, lambda x: x.isNotNull()), asc=False), 1, 5)
    return F.when(F.size(top) > 0, 0.6 * F.element_at(top, 1) + 0.4 * F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).otherwise(0.0)


def midrank(below: Column, upto: Column, n: Column) -> Column:
    """Empirical distribution function that counts half of the ties."""
    return (below + upto) / (2 * n)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = hits / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def dkw(n: Column, alpha: float = 0.05) -> Column:
    """Half-width of the confidence band of an empirical distribution function."""
    return F.when(n > 0, F.least(F.lit(1.0), F.sqrt(F.lit(math.log(2 / alpha)) / (2 * n)))).otherwise(1.0)


def gpd_survival(x: Column, shape: Column, scale: Column) -> Column:
    """Survival function of the generalised Pareto distribution."""
    inner = 1 + shape * x / scale
    return F.when(x <= 0, 1.0).when(scale <= 0, 0.0).when(F.abs(shape) < 1e-9, F.exp(-x / scale)).when(inner <= 0, 0.0).otherwise(F.pow(inner, -1 / shape))


def erf(x: Column) -> Column:
    """Error function, after Abramowitz and Stegun 7.1.26 (fixed values)."""
    k = 1 / (1 + 0.3275911 * F.abs(x))
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    tail = 1 - poly * F.exp(-x * x)
    return F.when(x < 0, -tail).otherwise(tail)


def log_likelihood(fg: Column, fg_n: Column, bg: Column, bg_n: Column) -> Column:
    """Dunning's G2 of a term with fg of fg_n foreground and bg of bg_n background documents."""
    def term(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    rate = bg / bg_n
    rest, rest_n = bg - fg, bg_n - fg_n
    return 2 * (term(fg, fg_n * rate) + term(fg_n - fg, fg_n * (1 - rate)) + term(rest, rest_n * rate) + term(rest_n - rest, rest_n * (1 - rate)))


def combine(crowding: Column, facet_rarity: Column, predictability: Column) -> Column:
    """Weighted geometric mean of the axes that are there, each at least 1; null without crowding."""
    axes = list(zip(WEIGHTS.values(), (crowding, facet_rarity, predictability), strict=True))
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in axes), F.lit(0.0))
    logs = sum((F.when(v.isNotNull(), w * F.log(F.greatest(v, F.lit(1.0)) / 100)).otherwise(0.0) for w, v in axes), F.lit(0.0))
    return F.when(crowding.isNotNull(), 100 * F.exp(logs / total))


def crowding_axis(percentiles: Column) -> Column:
    have = F.filter(percentiles, lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, 100 * (1 - F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)))


def facet_axis(mean_rarity: Column, pair: Column, cliche: Column) -> Column:
    return 100 * (0.5 * mean_rarity + 0.3 * F.coalesce(pair, mean_rarity) + 0.2 * (1 - F.coalesce(cliche, F.lit(0.0))))


def predictability_axis(percentile: Column, hit_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 * (1 - 0.6 * percentile - 0.4 * hit_rate))


def legacy_band(std: Column, missing: Column) -> Column:
    return F.least(F.lit(30.0), 8 + 40 * std + 6 * missing)


def confidence(coverage: Column, std: Column, verified: Column, canary: Column) -> Column:
    return 0.35 * coverage + 0.25 * clamp(1 - std / 0.35) + 0.25 * verified + 0.15 * canary


def abstain(corpus_ok: Column, coverage: Column, conf: Column) -> Column:
    return F.when(~corpus_ok | (coverage < 0.5), "coverage").when(conf < 0.45, "confidence")


def normal_draw(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def uniform(*key: Column) -> Column:
    """Uniform in (0, 1) from the first 8 hex digits of an MD5: the same in every engine."""
    return (F.conv(F.md5(F.concat_ws(":", *(k.cast("string") for k in key))).substr(1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
