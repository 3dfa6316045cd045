"""Scoring queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import scoring as P
from ..sources.readers import table
from .base import Catalog

catalog = Catalog()
query = catalog.query


@query("""WITH v AS (SELECT o_orderkey AS id, round(o_totalprice, 0) AS value FROM orders), b AS (SELECT value, 0 AS n FROM v UNION ALL SELECT l_extendedprice, 1 FROM lineitem), c AS (SELECT value, sum(n) AS n FROM b GROUP BY value),
u AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM c) SELECT id, round((2 * upto - n) / (2 * total), 6) AS percentile FROM v JOIN u USING (value)""")
def empirical_cdf_midrank(spark, d):
    values = table(spark, d, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 0).alias("value"))
    return P.percentiles(values, table(spark, d, "lineitem", "l_extendedprice").withColumnRenamed("l_extendedprice", "value")).select("id", F.round("percentile", 6).alias("percentile"))


RATES = "SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def rates(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("quality").alias("n"))


@query(f"""WITH r AS ({RATES}), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM r) SELECT source, round(CASE WHEN n > 0 THEN greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)) ELSE 0 END, 6) AS lo,
round(CASE WHEN n > 0 THEN least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)) ELSE 1 END, 6) AS hi FROM z""")
def wilson(spark, d):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return rates(spark, d).select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(f"WITH r AS ({RATES}) SELECT source, round(CASE WHEN n > 0 THEN least(1, sqrt(ln(2 / 0.05) / (2 * n))) ELSE 1 END, 6) AS eps FROM r")
def dkw(spark, d):
    return rates(spark, d).select("source", F.round(S.dkw(F.col("n")), 6).alias("eps"))


EXCESS = "x AS (SELECT l_returnflag AS flag, l_extendedprice AS v FROM lineitem), q AS (SELECT flag, quantile_cont(v, 0.9) AS u FROM x GROUP BY flag), e AS (SELECT flag, v - u AS x FROM x JOIN q USING (flag) WHERE v > u)"
PWM = "w AS (SELECT flag, x, row_number() OVER (PARTITION BY flag ORDER BY x) AS i, count(*) OVER (PARTITION BY flag) AS n FROM e), m AS (SELECT flag, max(n) AS n, avg(x) AS a0, avg(x * (n - i) / (n - 1)) AS a1 FROM w GROUP BY flag)"


def excesses(spark, d):
    x = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    cut = x.groupBy("flag").agg(F.percentile("v", F.lit(0.9)).alias("u"))
    return x, cut, x.join(F.broadcast(cut), "flag").where("v > u").select("flag", (F.col("v") - F.col("u")).alias("x"))  # one row per flag


@query(f"WITH {EXCESS}, {PWM} SELECT flag, n, round(2 - a0 / (a0 - 2 * a1), 4) AS shape, round(2 * a0 * a1 / (a0 - 2 * a1), 2) AS scale FROM m")
def gpd_pwm(spark, d):
    fit = P.gpd_fit(excesses(spark, d)[2], "flag")
    return fit.select("flag", "n", F.round("shape", 4).alias("shape"), F.round("scale", 2).alias("scale"))


@query(f"""WITH {EXCESS}, {PWM}, f AS (SELECT flag, 2 - a0 / (a0 - 2 * a1) AS shape, 2 * a0 * a1 / (a0 - 2 * a1) AS scale FROM m), p AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_returnflag AS flag, l_extendedprice AS v FROM lineitem)
SELECT o, ln, round(CASE WHEN v <= u THEN -1 ELSE least(1 - 1e-9, 1 - 0.1 * CASE WHEN abs(shape) < 1e-9 THEN exp(-(v - u) / scale) WHEN 1 + shape * (v - u) / scale <= 0 THEN 0 ELSE pow(1 + shape * (v - u) / scale, -1 / shape) END) END, 5) AS tail FROM p JOIN q USING (flag) JOIN f USING (flag)""")
def tail_percentile(spark, d):
    """Percentile above the 90 % threshold by the fitted tail (-1: below it)."""
    _, cut, excess = excesses(spark, d)
    fit = P.tail_fit(excess, "flag")
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice").withColumnRenamed("l_returnflag", "flag")
    rows = rows.join(F.broadcast(cut), "flag").join(F.broadcast(fit), "flag")  # one row per flag
    tail = P.tail_percentile(F.col("l_extendedprice"), F.lit(-1.0), F.col("u"), F.col("shape"), F.col("scale"))
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.round(tail, 5).alias("tail"))


AXES = "a AS (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN doc_id * 37 % 101 END AS c, CASE WHEN doc_id % 7 > 0 THEN doc_id * 53 % 101 END AS f, CASE WHEN doc_id % 5 > 0 THEN doc_id * 71 % 101 END AS l FROM documents)"


def axes(spark, d):
    axis = lambda m, q: F.when(F.col("doc_id") % m > 0, F.col("doc_id") * q % 101)
    return table(spark, d, "documents", "doc_id").select("doc_id", axis(11, 37).alias("c"), axis(7, 53).alias("f"), axis(5, 71).alias("l"))


def _part(c: str, w: float) -> tuple[str, str]:
    return f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END", f"CASE WHEN {c} IS NOT NULL THEN {w} * ln(greatest({c}, 1) / 100) ELSE 0 END"


_P = [_part("c", 0.45), _part("f", 0.35), _part("l", 0.2)]


@query(f"WITH {AXES} SELECT doc_id, round(CASE WHEN c IS NOT NULL THEN 100 * exp(({' + '.join(x for _, x in _P)}) / ({' + '.join(x for x, _ in _P)})) END, 5) AS headline FROM a")
def geomean_headline(spark, d):
    return axes(spark, d).select("doc_id", F.round(S.combine(F.col("c"), F.col("f"), F.col("l")), 5).alias("headline"))


@query(f"""WITH {AXES}, h AS (SELECT doc_id, 100 * exp((0.45 * ln(greatest(c, 1) / 100) + 0.35 * ln(greatest(f, 1) / 100)) / 0.8) AS value FROM a WHERE c IS NOT NULL AND f IS NOT NULL), r AS (SELECT round(value, 6) AS value, doc_id FROM h)
SELECT v.doc_id AS id, round(100.0 * (count(*) FILTER (WHERE r.value < v.value) + count(*) FILTER (WHERE r.value <= v.value)) / (2 * count(*)), 6) AS rank FROM r v, r GROUP BY v.doc_id""")
def percentile_rank(spark, d):
    """Rank of each project among all, over the two axes that need no model."""
    rows = axes(spark, d).where("c is not null and f is not null").select(F.col("doc_id").alias("id"), F.round(S.combine(F.col("c"), F.col("f"), F.lit(None).cast("double")), 6).alias("value"))
    return P.percentiles(rows, rows).select("id", F.round(100 * F.col("percentile"), 6).alias("rank"))


@query("""SELECT doc_id, round(100 * (1 - (1 / (1 + exp(-8 * (doc_id % 100 / 100.0 - 0.5))) + CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 / 10.0 ELSE 0 END) / CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END), 6) AS crowding,
round(100 * (0.5 * (doc_id % 9 / 9.0) + 0.3 * CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 / 9.0 ELSE (1 - (doc_id % 5 / 5.0)) / 2 END + 0.2 * (1 - doc_id % 4 / 4.0)), 6) AS facet_rarity,
round(greatest(0, 100 * (1 - 0.6 * (doc_id % 8 / 8.0) - 0.4 * (doc_id % 3 / 2.0))), 6) AS predictability, round(least(30, 8 + 40 * (doc_id % 10 / 20.0) + 6 * (doc_id % 3)), 6) AS band,
round(0.35 * (doc_id % 5 / 4.0) + 0.25 * greatest(0, least(1, 1 - (doc_id % 10 / 20.0) / 0.35)) + 0.25 * (doc_id % 4 / 3.0) + 0.15 * (doc_id % 2), 6) AS confidence,
coalesce(CASE WHEN doc_id % 13 = 0 OR doc_id % 5 / 4.0 < 0.5 THEN 'coverage' WHEN 0.35 * (doc_id % 5 / 4.0) + 0.25 * greatest(0, least(1, 1 - (doc_id % 10 / 20.0) / 0.35)) + 0.25 * (doc_id % 4 / 3.0) + 0.15 * (doc_id % 2) < 0.45 THEN 'confidence' END, '') AS abstain FROM documents""")
def score_axes(spark, d):
    """The three axes, the band, the confidence and the reason to abstain, over synthetic inputs."""
    i = F.col("doc_id")
    part = lambda m, q: (i % m) / float(q)
    crowd = S.crowding_axis(F.array(S.logistic_percentile(part(100, 100)), F.when(i % 2 == 0, part(10, 10))))
    facet = S.facet_axis(part(9, 9), F.when(i % 3 != 0, S.atypicality(part(5, 5))), part(4, 4))
    conf = S.confidence(part(5, 4), part(10, 20), part(4, 3), (i % 2).cast("double"))
    return table(spark, d, "documents", "doc_id").select(
        "doc_id", F.round(crowd, 6).alias("crowding"), F.round(facet, 6).alias("facet_rarity"), F.round(S.predictability_axis(part(8, 8), part(3, 2)), 6).alias("predictability"),
        F.round(S.legacy_band(part(10, 20), i % 3), 6).alias("band"), F.round(conf, 6).alias("confidence"), F.coalesce(S.abstain(i % 13 != 0, part(5, 4), conf), F.lit("")).alias("abstain"),
    )


U = "(('0x' || left(md5('7:' || source || ':' || r || ':' || doc_id), 8))::BIGINT + 0.5) / 4294967296.0"
POISSON = "CASE " + " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} THEN {k}" for k in range(12)) + " ELSE 12 END"


@query(f"""WITH i AS (SELECT source, r, CAST(n_chars AS DOUBLE) AS v, {U} AS u FROM documents, (SELECT unnest(range(1, 101)) AS r)), w AS (SELECT source, r, v, {POISSON} AS w FROM i),
m AS (SELECT source, r, sum(w * v) / sum(w) AS m FROM w GROUP BY 1, 2 HAVING sum(w) > 0) SELECT source, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM m GROUP BY source""")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source", "n_chars").select("source", F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"))
    return P.bootstrap(rows, "source", 100).select("source", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""WITH p AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM p)
SELECT flag, round(corr(rx, ry), 6) AS rho FROM k GROUP BY flag""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").toDF("flag", "x", "y")
    return P.spearman(rows, "flag").select("flag", F.round("rho", 6).alias("rho"))


VOTES = "v AS (SELECT user_id % 20 AS eid, event_type AS facet, event_id % 3 AS model, round(value, 6) AS score, event_id AS seq FROM events)"


def votes(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("eid"), F.col("event_type").alias("facet"), (F.col("event_id") % 3).alias("model"), F.round("value", 6).alias("score"), F.col("event_id").alias("seq"))


JURY = f"{VOTES}, l AS (SELECT eid, facet, model, max_by(score, seq) AS score FROM v GROUP BY 1, 2, 3), j AS (SELECT eid, facet, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n FROM l GROUP BY 1, 2)"


@query(f"WITH {JURY} SELECT * FROM j")
def jury_std(spark, d):
    return P.jury(votes(spark, d)).select("eid", "facet", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"WITH {JURY} SELECT eid, facet, std FROM j WHERE std >= 0.25 ORDER BY std DESC, eid, facet LIMIT 1")
def max_disagreement(spark, d):
    return jury_std(spark, d).where("std >= 0.25").select("eid", "facet", "std").orderBy(F.desc("std"), "eid", "facet").limit(1)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_second FROM events GROUP BY event_type")
def latency_summary(spark, d):
    at = F.col("ts").cast("timestamp").cast("double")
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    rows = table(spark, d, "events", "event_type", "ts", "value").groupBy("event_type").agg(p.alias("p"), F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("s"))
    return rows.select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "n", F.round(F.col("n") / F.col("s"), 9).alias("per_second"))


@query("SELECT user_id, round(sum(value) FILTER (WHERE event_type IN ('click', 'view')) / sum(value), 6) AS coverage, round(coalesce(avg(CAST(event_type = 'click' AS INT)) FILTER (WHERE event_type IN ('click', 'error')), 0.5), 6) AS verified FROM events GROUP BY user_id")
def weighted_coverage(spark, d):
    """Weighted share of sources that answered, and the verified share (one half where there is none)."""
    kind = F.col("event_type")
    ok = F.sum(F.when(kind.isin("click", "view"), F.col("value"))) / F.sum("value")
    verified = F.coalesce(F.avg(F.when(kind.isin("click", "error"), (kind == "click").cast("int"))), F.lit(0.5))
    return table(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id").agg(F.round(ok, 6).alias("coverage"), F.round(verified, 6).alias("verified"))


@query("SELECT user_id, round(greatest(count(*) / 70.0, sum(value) / 150000, (epoch(max(ts)) - epoch(min(ts))) / 2592000), 6) AS used, round(sum(value) * 0.002 / 1000, 8) AS cost FROM events GROUP BY user_id")
def budget_fraction(spark, d):
    at = F.col("ts").cast("timestamp").cast("double")
    used = F.greatest(F.count(F.lit(1)) / 70.0, F.sum("value") / 150000, (F.max(at) - F.min(at)) / 2592000)
    return table(spark, d, "events", "user_id", "ts", "value").groupBy("user_id").agg(F.round(used, 6).alias("used"), F.round(F.sum("value") * 0.002 / 1000, 8).alias("cost"))


PLACEHOLDERS = """SELECT kind, CAST(i AS BIGINT) AS i, round(CASE kind WHEN 'crowding' THEN 0.05 + 0.9 * pow(u, 1.6) WHEN 'rcs' THEN 1.6 * u * u WHEN 'headline' THEN 100 * pow(u, 1.1) ELSE x END, 4) AS value, true AS placeholder FROM (SELECT *, (i + 0.5) / 300 AS u,
sqrt(2) * 1.2 * CASE WHEN t < 0 THEN -e ELSE e END AS x FROM (SELECT *, 1 - (0.254829592 * k - 0.284496736 * k ** 2 + 1.421413741 * k ** 3 - 1.453152027 * k ** 4 + 1.061405429 * k ** 5) * exp(-t * t) AS e FROM (SELECT *, 1 / (1 + 0.3275911 * abs(t)) AS k FROM
(SELECT *, 2 * (i + 0.5) / 300 - 1 AS t FROM (SELECT unnest(range(300)) AS i), (SELECT unnest(['crowding', 'rcs', 'headline', 'curvature']) AS kind)))))"""


@query(PLACEHOLDERS)
def placeholder_cdf(spark, d):
    """Deterministic synthetic references of 300 values for each instrument, flagged as such."""
    u, t = (F.col("i") + 0.5) / 300, 2 * (F.col("i") + 0.5) / 300 - 1
    value = F.when(F.col("kind") == "crowding", 0.05 + 0.9 * F.pow(u, F.lit(1.6))).when(F.col("kind") == "rcs", 1.6 * u * u).when(F.col("kind") == "headline", 100 * F.pow(u, F.lit(1.1))).otherwise(math.sqrt(2) * 1.2 * S.erf(t))
    kinds = F.explode(F.array(*(F.lit(k) for k in ("crowding", "rcs", "headline", "curvature"))))
    return spark.range(300).select(F.col("id").alias("i"), kinds.alias("kind")).select("kind", "i", F.round(value, 4).alias("value"), F.lit(True).alias("placeholder"))
