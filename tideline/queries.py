"""Registered queries of the time-series operators, and DuckDB SQL for those that SQL can express.

Two bases: daily extremes of ``lineitem`` prices by ship date, and daily means of
``events`` values by event type as channels.  Where posterior draws are needed for a
result that another engine can repeat, they come from a golden-ratio sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import gev, normal, scale
from tideline.operators import blocks, chunks, diagnostics, experiments, pareto, plotdata, posterior, predictive, summaries, validation
from tideline.operators import state_space as ss
from tideline.plans import model as plans
from tideline.sources import daily as source

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# ---- bases


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    return x.agg(F.max("l_extendedprice").alias("tx"), F.min("l_extendedprice").alias("tn"), F.sum("l_quantity").alias("q"))


DAILY = "daily AS (SELECT CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS tx, min(l_extendedprice) AS tn, sum(l_quantity) AS q FROM lineitem GROUP BY 1)"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, t, ts, y): mean value by event type and day."""
    x = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("channel"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("y"))
    t = F.datediff("day", F.min("day").over(Window.partitionBy("channel"))).cast("int")
    return x.select("channel", t.alias("t"), F.col("day").cast("timestamp_ntz").alias("ts"), "y")


OBS = """obs AS (
 SELECT channel, CAST(date_diff('day', min(day) OVER (PARTITION BY channel), day) AS INTEGER) AS t, day, y
 FROM (SELECT event_type AS channel, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1, 2))"""

DRAWS, CHAINS = 64, 4


def frac(x: Column) -> Column:
    return x - F.floor(x)


def pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, draw, chain, t, location, sigma, xi, y): a fixed sequence in the place of posterior draws."""
    obs = channels(spark, sf_dir)
    base = obs.groupBy("channel").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("s"), F.max("t").alias("last"))
    x = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("last"))))
    d = F.col("draw")
    u = frac(0.5 + d * 0.6180339887498949)
    x = x.select(
        "channel", "draw", F.pmod("draw", F.lit(CHAINS)).alias("chain"), "t",
        (F.col("mu") + F.col("s") * (0.2 * -F.log(-F.log(u)) + 0.05 * F.pmod("t", F.lit(7)))).alias("location"),
        (F.col("s") * (0.8 + 0.4 * frac(0.3 + d * 0.7548776662466927))).alias("sigma"), (-0.2 + 0.3 * frac(0.1 + d * 0.5698402909980532)).alias("xi"),
    )
    v = frac(0.5 + (d * 31 + F.col("t") * 7 + 1) * 0.6180339887498949)
    return x.withColumn("y", gev.ppf(v, F.col("location"), F.col("sigma"), F.col("xi")))


PSEUDO = OBS + f""",
base AS (SELECT channel, avg(y) AS mu, stddev_pop(y) AS s, max(t) AS last FROM obs GROUP BY 1),
grid AS (SELECT channel, mu, s, d.draw, k.t FROM base, (SELECT unnest(range({DRAWS})) AS draw) d, (SELECT unnest(range(1000)) AS t) k WHERE k.t <= last),
seq AS (SELECT *, 0.5 + draw * CAST(0.6180339887498949 AS DOUBLE) AS a, 0.3 + draw * CAST(0.7548776662466927 AS DOUBLE) AS b, 0.1 + draw * CAST(0.5698402909980532 AS DOUBLE) AS c,
 0.5 + (draw * 31 + t * 7 + 1) * CAST(0.6180339887498949 AS DOUBLE) AS e FROM grid),
par AS (SELECT channel, CAST(draw AS INTEGER) AS draw, CAST(draw % {CHAINS} AS INTEGER) AS chain, CAST(t AS INTEGER) AS t,
 mu + s * (0.2 * -ln(-ln(a - floor(a))) + 0.05 * (t % 7)) AS location, s * (0.8 + 0.4 * (b - floor(b))) AS sigma, -0.2 + 0.3 * (c - floor(c)) AS xi, e - floor(e) AS v FROM seq),
pseudo AS (SELECT *, location + sigma * (exp(-xi * ln(-ln(v))) - 1) / xi AS y FROM par)"""


def gev_sf_sql(y: str) -> str:
    z = f"(({y}) - location) / sigma"
    return f"(CASE WHEN 1 + xi * {z} <= 0 THEN CASE WHEN xi < 0 THEN 0.0 ELSE 1.0 END ELSE 1 - exp(-exp(-ln(1 + xi * {z}) / xi)) END)"


def horner_sql(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0]) + "::DOUBLE"
    for v in c[1:]:
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


def cdf0_sql(x: str) -> str:
    a = f"abs({x})"
    return f"(CASE WHEN {x} > 0 THEN 1 - exp(-{a} * {a} / 2) * {horner_sql(normal.CDF_OVER, a)} / {horner_sql(normal.CDF_UNDER, a)} ELSE exp(-{a} * {a} / 2) * {horner_sql(normal.CDF_OVER, a)} / {horner_sql(normal.CDF_UNDER, a)} END)"


def ppf0_sql(p: str) -> str:
    """For p within exp(-25) of the ends."""
    q, r = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    t = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner_sql(normal.PPF_A, r)} / {horner_sql(normal.PPF_B, r)} ELSE sign({q}) * {horner_sql(normal.PPF_C, t)} / {horner_sql(normal.PPF_D, t)} END)"


# ---- sources, blocks, calendars


@query(f"""WITH {DAILY} SELECT count(*) AS n_rows, count(DISTINCT day) AS n_days, min(day) AS first_day, max(day) AS last_day,
 CAST(date_diff('day', min(day), max(day)) + 1 AS BIGINT) AS n_span, CAST(sum(CASE WHEN tx IS NULL OR isnan(tx) OR isinf(tx) THEN 1 ELSE 0 END) + sum(CASE WHEN tn IS NULL OR isnan(tn) OR isinf(tn) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
 count(*) = date_diff('day', min(day), max(day)) + 1 AS complete FROM daily""")
def daily_completeness(spark, sf_dir):
    return source.completeness(daily(spark, sf_dir), ("tx", "tn"))


_START = {"monthly": "CAST(date_trunc('month', day) AS DATE)", "seasonal": "CAST(date_trunc('quarter', day + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE)"}
_LEN = {"monthly": "1 MONTH", "seasonal": "3 MONTH"}


def _blocks_sql(f: str) -> str:
    end = f"CAST(block_start + INTERVAL {_LEN[f]} - INTERVAL 1 DAY AS DATE)"
    return f"""WITH {DAILY}, b AS (SELECT {_START[f]} AS block_start, count(DISTINCT day) AS n_days, avg(tx) AS tx_mean, max(tx) AS tx_max, min(tx) AS tx_min, avg(tn) AS tn_mean, max(tn) AS tn_max, min(tn) AS tn_min FROM daily GROUP BY 1)
 SELECT {end} AS block_end, round(tx_mean, 6) AS tx_mean, tx_max, tx_min, round(tn_mean, 6) AS tn_mean, tn_max, tn_min FROM b WHERE n_days = date_diff('day', block_start, {end}) + 1"""


@query(_blocks_sql("monthly"))
def block_summaries_month(spark, sf_dir):
    return rounded(blocks.summaries(daily(spark, sf_dir), "monthly", ("tx", "tn")), "tx_mean", "tn_mean")


@query(_blocks_sql("seasonal"))
def block_summaries_qsdec(spark, sf_dir):
    return rounded(blocks.summaries(daily(spark, sf_dir), "seasonal", ("tx", "tn")), "tx_mean", "tn_mean")


@query(f"""WITH {DAILY}, b AS (SELECT {_START['seasonal']} AS block_start, count(DISTINCT day) AS n_days FROM daily GROUP BY 1),
 e AS (SELECT *, CAST(block_start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS block_end FROM b)
 SELECT block_start, block_end, n_days, CAST(date_diff('day', block_start, block_end) + 1 AS BIGINT) AS n_expected, n_days = date_diff('day', block_start, block_end) + 1 AS complete,
 block_start IN ((SELECT min(block_start) FROM b), (SELECT max(block_start) FROM b)) AS boundary FROM e""")
def incomplete_block_audit(spark, sf_dir):
    return blocks.audit(daily(spark, sf_dir), "seasonal")


@query(f"""WITH {OBS}, d AS (SELECT *, date_diff('second', lag(CAST(day AS TIMESTAMP)) OVER w, CAST(day AS TIMESTAMP)) AS s FROM obs WINDOW w AS (PARTITION BY channel ORDER BY day))
 SELECT channel, count(*) AS n, CAST(0 AS BIGINT) AS n_null, CAST(count(*) FILTER (s <= 0) AS BIGINT) AS n_not_increasing, CAST(NULL AS INTEGER) AS month_step, CASE WHEN min(s) = max(s) AND min(s) > 0 THEN min(s) END AS second_step,
 coalesce(min(s) = max(s) AND min(s) > 0, false) AS regular FROM d GROUP BY channel""")
def calendar_regularity(spark, sf_dir):
    return blocks.regularity(channels(spark, sf_dir))


@query(f"""WITH {OBS} SELECT channel, t, CAST(t % 7 AS INTEGER) AS phase, round(y - avg(y) OVER (PARTITION BY channel, t % 7), 6) AS centred FROM obs""")
def phase_centred(spark, sf_dir):
    return rounded(blocks.centred(channels(spark, sf_dir), 7).select("channel", "t", "phase", "centred"), "centred")


@query(f"""WITH {DAILY}, b AS (SELECT DISTINCT {_START['seasonal']} AS s FROM daily), e AS (SELECT CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS block_end FROM b)
 SELECT block_end, CAST(row_number() OVER (ORDER BY block_end) - 1 AS INTEGER) AS t, CAST((row_number() OVER (ORDER BY block_end) - 1) % 4 AS INTEGER) AS phase,
 CASE month(block_end) WHEN 2 THEN 'DJF' WHEN 5 THEN 'MAM' WHEN 8 THEN 'JJA' ELSE 'SON' END AS label FROM e""")
def phase_index(spark, sf_dir):
    x = blocks.number(blocks.audit(daily(spark, sf_dir), "seasonal").select("block_end"), "block_end")
    return x.select("block_end", "t", scale.phase(F.col("t"), 4).alias("phase"), blocks.phase_label(F.col("block_end"), "seasonal").alias("label"))


@query("""SELECT CAST(phase AS INTEGER) AS phase, CAST(contrast AS INTEGER) AS contrast, round(CASE WHEN phase <= contrast THEN 1 / sqrt((contrast + 1) * (contrast + 2)) WHEN phase = contrast + 1 THEN -(contrast + 1) / sqrt((contrast + 1) * (contrast + 2)) ELSE 0 END, 6) AS value
 FROM (SELECT unnest(range(12)) AS phase), (SELECT unnest(range(11)) AS contrast)""")
def seasonal_contrasts(spark, sf_dir):
    return rounded(scale.contrast_table(spark, 12), "value")


@query(f"""WITH {DAILY} SELECT channel, CAST(t AS INTEGER) AS t, y FROM (SELECT date_diff('day', (SELECT min(day) FROM daily), day) AS t, tx, tn FROM daily) UNPIVOT (y FOR channel IN (tx, tn))""")
def wide_to_long(spark, sf_dir):
    x = daily(spark, sf_dir)
    first = x.agg(F.min("day").alias("first"))
    return source.long_form(x.join(F.broadcast(first)).select(F.datediff("day", "first").alias("t"), "tx", "tn"), ["tx", "tn"])


@query(f"""WITH {OBS}, e AS (SELECT CAST(date_diff('day', min(day) OVER (), day) AS INTEGER) AS t, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1))
 SELECT o.channel, o.t, round(o.y, 6) AS y, CAST(e.n AS DOUBLE) AS x0, CAST(e.t AS DOUBLE) AS x1 FROM obs o JOIN e USING (t)""")
def covariate_alignment(spark, sf_dir):
    obs = channels(spark, sf_dir)
    x = blocks.align(obs, _exog(spark, sf_dir), ["n", "trend"])
    return x.select("channel", "t", r6("y").alias("y"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def _exog(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    x = blocks.number(x, "day")
    return x.select("t", "n", F.col("t").alias("trend"))


# ---- families


def _family(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("value").alias("y"), (30 + F.pmod("event_id", F.lit(40))).cast("double").alias("eta"), (20 + F.pmod("event_id", F.lit(7)) * 2.5).alias("sigma"), (0.02 + F.pmod("event_id", F.lit(10)) * 0.005).alias("xi"))


FAMILY = "f AS (SELECT event_id, value AS y, CAST(30 + event_id % 40 AS DOUBLE) AS eta, 20 + (event_id % 7) * CAST(2.5 AS DOUBLE) AS sigma, 0.02 + (event_id % 10) * CAST(0.005 AS DOUBLE) AS xi, value FROM events), z AS (SELECT *, (y - eta) / sigma AS z FROM f)"


@query(f"""WITH {FAMILY}, a AS (SELECT *, 1 + xi * z AS t, -ln(1 + xi * z) / xi AS a, exp(-ln(1 + xi * z) / xi) AS p FROM z)
 SELECT event_id, round(-ln(sigma) + (1 + xi) * a - p, 6) AS logpdf, round(exp(-p), 6) AS cdf, round(1 - exp(-p), 6) AS sf, round((1 + xi - p) / (sigma * t), 6) AS gradient, round((1 + xi) * (xi - p) / (sigma * t * sigma * t), 6) AS hessian FROM a""")
def gev_upper(spark, sf_dir):
    a = [F.col(c) for c in ("y", "eta", "sigma", "xi")]
    return _family(spark, sf_dir).select("event_id", *(r6(f(*a)).alias(n) for n, f in (("logpdf", gev.logpdf), ("cdf", gev.cdf), ("sf", gev.sf), ("gradient", gev.gradient), ("hessian", gev.hessian))))


@query(f"""WITH {FAMILY}, w AS (SELECT event_id, eta, sigma, xi * -1 AS xi, -z AS z FROM z), a AS (SELECT *, 1 + xi * z AS t FROM w),
 b AS (SELECT *, CASE WHEN t > 0 THEN exp(-ln(CASE WHEN t > 0 THEN t ELSE 1 END) / xi) END AS p FROM a)
 SELECT event_id, round(CASE WHEN t > 0 THEN 1 - exp(-p) ELSE 0.0 END, 6) AS cdf, round(CASE WHEN t > 0 THEN exp(-p) ELSE 1.0 END, 6) AS sf, round(coalesce(-(1 + xi - p) / (sigma * t), 0), 6) AS gradient FROM b""")
def gev_lower(spark, sf_dir):
    a = [F.col("y"), F.col("eta"), F.col("sigma"), -F.col("xi")]
    g = gev.gradient(*a, "lower")
    return _family(spark, sf_dir).select("event_id", r6(gev.cdf(*a, "lower")).alias("cdf"), r6(gev.sf(*a, "lower")).alias("sf"), r6(F.when(F.isnan(g), 0.0).otherwise(g)).alias("gradient"))


@query(f"""WITH {FAMILY}, q AS (SELECT *, (event_id % 997 + 1) / CAST(1000 AS DOUBLE) AS p FROM f)
 SELECT event_id, round(eta + sigma * (exp(-xi * ln(-ln(p))) - 1) / xi, 6) AS upper, round(-(-eta + sigma * (exp(-xi * ln(-ln(1 - p))) - 1) / xi), 6) AS lower, round(eta - sigma * ln(-ln(p)), 6) AS gumbel FROM q""")
def gev_quantile(spark, sf_dir):
    p = (F.pmod("event_id", F.lit(997)) + 1) / 1000
    a = [p, F.col("eta"), F.col("sigma")]
    return _family(spark, sf_dir).select("event_id", r6(gev.ppf(*a, F.col("xi"))).alias("upper"), r6(gev.ppf(*a, F.col("xi"), "lower")).alias("lower"), r6(gev.ppf(*a, F.lit(0.0))).alias("gumbel"))


@query(f"""WITH {FAMILY}, w AS (SELECT *, least(greatest(z, -6.0), 6.0) AS x FROM z)
 SELECT event_id, round(-0.5 * ln(2 * pi()) - ln(sigma) - z * z / 2, 6) AS logpdf, round({cdf0_sql('x')}, 6) AS cdf, round({cdf0_sql('(-x)')}, 6) AS sf, round((y - eta) / (sigma * sigma), 6) AS gradient, round(-1 / (sigma * sigma), 6) AS hessian FROM w""")
def gaussian_density(spark, sf_dir):
    a = [F.col(c) for c in ("y", "eta", "sigma")]
    x = F.least(F.greatest((a[0] - a[1]) / a[2], F.lit(-6.0)), F.lit(6.0))
    unit = (x, F.lit(0.0), F.lit(1.0))
    return _family(spark, sf_dir).select(
        "event_id", r6(normal.logpdf(*a)).alias("logpdf"), r6(normal.cdf(*unit)).alias("cdf"), r6(normal.sf(*unit)).alias("sf"), r6(normal.gradient(*a)).alias("gradient"), r6(normal.hessian(*a)).alias("hessian")
    )


@query(f"""WITH {FAMILY}, q AS (SELECT *, (event_id % 9999 + 0.5) / CAST(10000 AS DOUBLE) AS p FROM f) SELECT event_id, round(eta + sigma * {ppf0_sql('p')}, 6) AS quantile FROM q""")
def gaussian_quantile(spark, sf_dir):
    p = (F.pmod("event_id", F.lit(9999)) + 0.5) / 10000
    return _family(spark, sf_dir).select("event_id", r6(normal.ppf(p, F.col("eta"), F.col("sigma"))).alias("quantile"))


@query(f"""WITH {FAMILY}, a AS (SELECT *, 1 + xi * z AS t, exp(-ln(1 + xi * z) / xi) AS p FROM z), b AS (SELECT *, (1 + xi - p) / (sigma * t) AS g, least(1 / greatest((1 + xi) * (p - xi) / (sigma * t * sigma * t), 1e-6), 1e8) AS v FROM a)
 SELECT event_id, round(eta + greatest(least(g * v, 10 * sigma), -10 * sigma), 4) AS value, round(v, 3) AS variance FROM b""")
def pseudo_observations(spark, sf_dir):
    v, r = gev.pseudo_observation(*(F.col(c) for c in ("y", "eta", "sigma", "xi")))
    return _family(spark, sf_dir).select("event_id", F.round(v, 4).alias("value"), F.round(r, 3).alias("variance"))


@query(f"""WITH s AS (SELECT event_id, 20 + (event_id % 7) * CAST(2.5 AS DOUBLE) AS sigma, CAST(event_id % 4 AS INTEGER) AS phase FROM events), c AS (SELECT * FROM (VALUES (0, 1/sqrt(2), 1/sqrt(6), 1/sqrt(12)), (1, -1/sqrt(2), 1/sqrt(6), 1/sqrt(12)), (2, 0.0, -2/sqrt(6), 1/sqrt(12)), (3, 0.0, 0.0, -3/sqrt(12))) v(phase, a, b, c))
 SELECT event_id, s.phase, round(sigma * exp(0.1 * a - 0.2 * b + 0.3 * c), 6) AS sigma FROM s JOIN c ON s.phase = c.phase""")
def seasonal_scale(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", scale.phase(F.col("event_id"), 4).alias("phase"), (20 + F.pmod("event_id", F.lit(7)) * 2.5).alias("sigma"))
    w = F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.3))
    return x.select("event_id", "phase", r6(scale.seasonal_sigma(F.col("sigma"), w, F.col("phase"), 4)).alias("sigma"))


# ---- filters

LEVEL = plans.Model(components=(plans.LocalLevel(),), priors=plans.Priors(initial_level=plans.Normal(50.0, 10.0)))
TREND = plans.Model(components=(plans.LocalLinearTrend(),), priors=plans.Priors(initial_level=plans.Normal(50.0, 10.0), initial_slope=plans.Normal(0.0, 1.0)))


def _forward(spark, sf_dir, model, q):
    plan = plans.compile_model(model)
    x = ss.series(channels(spark, sf_dir), ["channel"])
    return plan, x.withColumn("path", ss.forward(plan, F.col("ys"), {g: F.lit(v) for g, v in q.items()}, F.lit(60.0)))


_LEVEL_CTE = f"""WITH RECURSIVE {OBS}, k AS (
 SELECT channel, -1 AS t, CAST(50 AS DOUBLE) AS m, CAST(100 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM obs WHERE t = 0
 UNION ALL SELECT o.channel, o.t, k.m + (k.p + 4.0) / (k.p + 64.0) * (o.y - k.m), (k.p + 4.0) - (k.p + 4.0) * (k.p + 4.0) / (k.p + 64.0), k.ll - 0.5 * (ln(2 * pi()) + ln(k.p + 64.0) + (o.y - k.m) * (o.y - k.m) / (k.p + 64.0)) FROM k JOIN obs o ON o.channel = k.channel AND o.t = k.t + 1)"""


@query(_LEVEL_CTE + " SELECT channel, t, round(m, 6) AS level, round(p, 6) AS variance FROM k WHERE t >= 0")
def local_level_filter(spark, sf_dir):
    _, x = _forward(spark, sf_dir, LEVEL, {"level": 4.0})
    x = x.select("channel", F.explode("path").alias("e"))
    return x.select("channel", "e.t", r6(F.col("e.m")[0]).alias("level"), r6(F.col("e.p")[0]).alias("variance"))


def prices(spark, sf_dir) -> DataFrame:
    """(channel, t, y): the highest and the lowest price of each day, numbered from the first."""
    x = daily(spark, sf_dir).select("day", F.explode(F.create_map(F.lit("tx"), F.col("tx"), F.lit("tn"), F.col("tn"))).alias("channel", "y"))
    t = F.datediff("day", F.min("day").over(Window.partitionBy("channel"))).cast("int")
    return x.select("channel", t.alias("t"), (F.col("y") / 1000).alias("y"))


#: Variances of a level and of prices around it, in thousands; a chunk has so many days.
PRICE_Q, PRICE_R, PRICE_SIZE = 2.0, 50.0, 128
_PRICE_CTE = f"""WITH RECURSIVE {DAILY}, obs AS (
 SELECT channel, CAST(date_diff('day', (SELECT min(day) FROM daily), day) AS INTEGER) AS t, y FROM (SELECT 'tx' AS channel, day, tx / 1000 AS y FROM daily UNION ALL SELECT 'tn', day, tn / 1000 FROM daily)),
k AS (
 SELECT channel, -1 AS t, CAST(50 AS DOUBLE) AS m, CAST(100 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM obs WHERE t = 0
 UNION ALL SELECT o.channel, o.t, k.m + (k.p + {PRICE_Q}) / (k.p + {PRICE_Q + PRICE_R}) * (o.y - k.m), (k.p + {PRICE_Q}) - (k.p + {PRICE_Q}) * (k.p + {PRICE_Q}) / (k.p + {PRICE_Q + PRICE_R}), k.ll - 0.5 * (ln(2 * pi()) + ln(k.p + {PRICE_Q + PRICE_R}) + (o.y - k.m) * (o.y - k.m) / (k.p + {PRICE_Q + PRICE_R})) FROM k JOIN obs o ON o.channel = k.channel AND o.t = k.t + 1)"""


def _chunked(of, spark, sf_dir):
    return of(prices(spark, sf_dir), plans.compile_model(LEVEL), {"level": PRICE_Q}, PRICE_R, PRICE_SIZE, 8)


@query(_PRICE_CTE + " SELECT channel, t, round(m, 6) AS level, round(p, 6) AS variance FROM k WHERE t >= 0")
def chunked_filter(spark, sf_dir):
    x = _chunked(chunks.filtered, spark, sf_dir)
    return x.select("channel", "t", r6(F.col("m")[0]).alias("level"), r6(F.col("p")[0]).alias("variance"))


@query(_PRICE_CTE + " SELECT channel, round(arg_max(ll, t), 5) AS loglik FROM k GROUP BY channel")
def chunked_loglik(spark, sf_dir):
    return _chunked(chunks.likelihood, spark, sf_dir).select("channel", F.round("loglik", 5).alias("loglik"))


@query(_PRICE_CTE + f""", n AS (SELECT channel, max(t) AS n FROM k GROUP BY 1), s AS (
 SELECT k.channel, k.t, k.m, k.p FROM k JOIN n ON n.channel = k.channel AND k.t = n.n
 UNION ALL SELECT k.channel, k.t, k.m + k.p / (k.p + {PRICE_Q}) * (s.m - k.m), k.p + (k.p / (k.p + {PRICE_Q})) * (k.p / (k.p + {PRICE_Q})) * (s.p - k.p - {PRICE_Q}) FROM s JOIN k ON k.channel = s.channel AND k.t = s.t - 1 WHERE k.t >= 0)
 SELECT channel, t, round(m, 6) AS level, round(p, 6) AS variance FROM s""")
def chunked_smoother(spark, sf_dir):
    x = _chunked(chunks.smoothed, spark, sf_dir)
    return x.select("channel", "t", r6(F.col("m")[0]).alias("level"), r6(F.col("v")[0]).alias("variance"))


@query(_LEVEL_CTE + " SELECT channel, round(arg_max(ll, t), 6) AS loglik FROM k GROUP BY channel")
def local_level_loglik(spark, sf_dir):
    _, x = _forward(spark, sf_dir, LEVEL, {"level": 4.0})
    return x.select("channel", r6(ss.loglik(F.col("path"))).alias("loglik"))


@query(_LEVEL_CTE + """, n AS (SELECT channel, max(t) AS n FROM k GROUP BY 1), s AS (
 SELECT k.channel, k.t, k.m AS sm, k.p AS sv FROM k JOIN n ON n.channel = k.channel AND k.t = n.n
 UNION ALL SELECT k.channel, k.t, k.m + k.p / (k.p + 4.0) * (s.sm - k.m), k.p + (k.p / (k.p + 4.0)) * (k.p / (k.p + 4.0)) * (s.sv - (k.p + 4.0)) FROM s JOIN k ON k.channel = s.channel AND k.t = s.t - 1 WHERE k.t >= 0)
 SELECT channel, t, round(sm, 6) AS level, round(sv, 6) AS variance FROM s""")
def local_level_smoother(spark, sf_dir):
    plan, x = _forward(spark, sf_dir, LEVEL, {"level": 4.0})
    x = x.select("channel", F.explode(ss.backward(plan, F.col("ys"), F.col("path"))).alias("e"))
    return x.select("channel", "e.t", r6(F.col("e.m")[0]).alias("level"), r6(F.col("e.v")[0]).alias("variance"))


@query(f"""WITH RECURSIVE {OBS}, k AS (
 SELECT channel, -1 AS t, CAST(50 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(100 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS s FROM obs WHERE t = 0
 UNION ALL SELECT o.channel, o.t,
  k.a + k.b + (k.p + 2 * k.c + k.s + 4.0) / (k.p + 2 * k.c + k.s + 64.0) * (o.y - k.a - k.b), k.b + (k.c + k.s) / (k.p + 2 * k.c + k.s + 64.0) * (o.y - k.a - k.b),
  (k.p + 2 * k.c + k.s + 4.0) * 60.0 / (k.p + 2 * k.c + k.s + 64.0), (k.c + k.s) * 60.0 / (k.p + 2 * k.c + k.s + 64.0), k.s + 0.25 - (k.c + k.s) * (k.c + k.s) / (k.p + 2 * k.c + k.s + 64.0)
  FROM k JOIN obs o ON o.channel = k.channel AND o.t = k.t + 1)
 SELECT channel, t, round(a, 6) AS level, round(b, 6) AS slope, round(p, 6) AS level_variance, round(s, 6) AS slope_variance FROM k WHERE t >= 0""")
def local_linear_filter(spark, sf_dir):
    _, x = _forward(spark, sf_dir, TREND, {"level": 4.0, "slope": 0.25})
    x = x.select("channel", F.explode("path").alias("e"))
    return x.select("channel", "e.t", r6(F.col("e.m")[0]).alias("level"), r6(F.col("e.m")[1]).alias("slope"), r6(F.col("e.p")[0]).alias("level_variance"), r6(F.col("e.p")[3]).alias("slope_variance"))


# ---- posteriors


@query(f"WITH {OBS} SELECT channel, count(*) AS n, round((sum(y) / 60.0 + 0.5) / (count(*) / 60.0 + 0.01), 6) AS mean, round(1 / (count(*) / 60.0 + 0.01), 6) AS variance FROM obs GROUP BY 1")
def static_level_posterior(spark, sf_dir):
    return rounded(posterior.static_level(channels(spark, sf_dir), plans.Normal(50.0, 10.0), 60.0), "mean", "variance")


@query(f"""WITH {OBS}, m AS (SELECT channel, count(*) / 60.0 + 0.01 AS a, sum(t / CAST(10 AS DOUBLE)) / 60.0 AS b, sum(t * t / CAST(100 AS DOUBLE)) / 60.0 + 0.01 AS d, sum(y) / 60.0 AS u, sum(y * t / CAST(10 AS DOUBLE)) / 60.0 AS v FROM obs GROUP BY 1)
 SELECT channel, CAST(0 AS INTEGER) AS coefficient, round((d * u - b * v) / (a * d - b * b), 6) AS mean, round(sqrt(d / (a * d - b * b)), 6) AS sd FROM m
 UNION ALL SELECT channel, CAST(1 AS INTEGER), round((a * v - b * u) / (a * d - b * b), 6), round(sqrt(a / (a * d - b * b)), 6) FROM m""")
def static_regression_posterior(spark, sf_dir):
    x = channels(spark, sf_dir).withColumn("x", F.array(F.lit(1.0), F.col("t") / 10))
    return rounded(posterior.static_regression(x, 2, plans.Normal(0.0, 10.0), 60.0), "mean", "sd")


_GRID = [{"level": a, "variance": v, "log_prior": -0.1 * a - 0.001 * v} for a in (0.5, 1.0, 2.0, 4.0) for v in (20.0, 60.0, 120.0)]


@query("WITH RECURSIVE " + OBS + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p['level']}, {p['variance']}, {p['log_prior']!r})" for i, p in enumerate(_GRID)) + """) v(point, a, r, lp)), k AS (
 SELECT channel, point, CAST(a AS DOUBLE) AS a, CAST(r AS DOUBLE) AS r, CAST(lp AS DOUBLE) AS lp, -1 AS t, CAST(50 AS DOUBLE) AS m, CAST(100 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM obs, g WHERE t = 0
 UNION ALL SELECT o.channel, k.point, k.a, k.r, k.lp, o.t, k.m + (k.p + k.a * k.a) / (k.p + k.a * k.a + k.r) * (o.y - k.m), (k.p + k.a * k.a) * k.r / (k.p + k.a * k.a + k.r), k.ll - 0.5 * (ln(2 * pi()) + ln(k.p + k.a * k.a + k.r) + (o.y - k.m) * (o.y - k.m) / (k.p + k.a * k.a + k.r)) FROM k JOIN obs o ON o.channel = k.channel AND o.t = k.t + 1),
 l AS (SELECT channel, point, lp, arg_max(ll, t) AS ll FROM k GROUP BY ALL), e AS (SELECT *, exp(ll + lp - max(ll + lp) OVER (PARTITION BY channel)) AS e FROM l)
 SELECT channel, CAST(point AS INTEGER) AS point, round(ll, 6) AS loglik, round(e / sum(e) OVER (PARTITION BY channel), 6) AS weight FROM e""")
def scale_grid_posterior(spark, sf_dir):
    return rounded(posterior.grid_posterior(channels(spark, sf_dir), LEVEL, _GRID), "loglik", "weight").drop("params")


@query(f"""WITH {OBS}, g AS (SELECT e.e, s.s, x.x, row_number() OVER (ORDER BY e.e, s.s, x.x) - 1 AS point FROM (SELECT unnest([44.0, 47.0, 50.0]) AS e) e, (SELECT unnest([1.6, 2.0, 2.4]) AS s) s, (SELECT unnest([-0.2, -0.1, 0.1]) AS x) x),
 z AS (SELECT channel, point, CAST(e AS DOUBLE) AS e, CAST(s AS DOUBLE) AS s, CAST(x AS DOUBLE) AS x, 1 + x * (y - e) / exp(CAST(s AS DOUBLE)) AS t FROM obs, g),
 l AS (SELECT channel, point, e, s, x, sum(CASE WHEN t > 0 THEN -s - (1 + x) * ln(CASE WHEN t > 0 THEN t ELSE 1 END) / x - exp(-ln(CASE WHEN t > 0 THEN t ELSE 1 END) / x) ELSE '-Infinity'::DOUBLE END) AS ll FROM z GROUP BY ALL),
 q AS (SELECT *, ll - 0.5 * ((e - 50) / 10) ** 2 - ln(10) - 0.5 * (x / 0.3) ** 2 - ln(0.3) - 4 * s - 2 * exp(-2 * s) AS post FROM l),
 w AS (SELECT *, exp(post - max(post) OVER (PARTITION BY channel)) AS w FROM q)
 SELECT channel, CAST(point AS INTEGER) AS point, round(w / sum(w) OVER (PARTITION BY channel), 6) AS weight FROM w""")
def gev_grid_posterior(spark, sf_dir):
    x = posterior.gev_posterior(channels(spark, sf_dir), "upper", [44.0, 47.0, 50.0], [1.6, 2.0, 2.4], [-0.2, -0.1, 0.1], plans.Normal(50.0, 10.0))
    return rounded(x.select("channel", "point", "weight"), "weight")


def _fit(spark, sf_dir, pooling=None):
    model = plans.Model(components=(plans.LocalLinearTrend(),), priors=plans.Priors(initial_level=plans.Normal(50.0, 20.0), initial_slope=plans.Normal(0.0, 0.5), level=plans.Normal(0.0, 2.0), slope=plans.Normal(0.0, 0.2), variance=plans.InverseGamma(2.0, 60.0)))
    return model, posterior.fit(channels(spark, sf_dir), model, pooling=pooling)


@query()
def posterior_fit(spark, sf_dir):
    """A local linear trend: scales by importance sampling, then paths drawn by a simulation smoother."""
    _, fit = _fit(spark, sf_dir)
    return summaries.summarize(fit["outputs"], ["channel", "component", "t"], "value")


@query()
def posterior_fit_pooled(spark, sf_dir):
    """Scales of level and slope that all channels share, summarized over draws with each channel's own amplitudes."""
    _, fit = _fit(spark, sf_dir, plans.Pooling(level=plans.HalfNormal(2.0), slope=plans.HalfNormal(0.2)))
    x = fit["draws"].select("channel", "chain", "draw", F.explode("params").alias("parameter", "value"))
    return summaries.summarize(x, ["channel", "parameter"], "value")


@query()
def posterior_fit_gev(spark, sf_dir):
    """Extreme values around a moving level, with scales by weekday."""
    model = plans.Model(plans.GEV(scale=plans.SeasonalScale(7)), (plans.LocalLevel(),), plans.Priors(initial_level=plans.Normal(50.0, 20.0), level=plans.Normal(0.0, 2.0), variance=plans.InverseGamma(2.0, 60.0)))
    fit = posterior.fit(channels(spark, sf_dir), model, draws=400, points=200)
    return summaries.summarize(fit["outputs"], ["channel", "component", "t"], "value")


@query()
def forecast(spark, sf_dir):
    model, fit = _fit(spark, sf_dir)
    n = 30
    taken = predictive.draw_index(spark, 1000, 4, 250)
    pred = predictive.predict(fit["draws"], model, n, 14, taken)
    return summaries.summarize(pred, ["channel", "t"], "y")


@query()
def prior_predictive(spark, sf_dir):
    return summaries.summarize(predictive.prior_predictive(spark, TREND, 20, 500), ["channel", "t"], "y")


@query()
def gev_path_mode(spark, sf_dir):
    m = plans.Model(plans.GEV(), LEVEL.components, LEVEL.priors)
    x = posterior.gev_path_mode(channels(spark, sf_dir), m, {"level": 1.0, "sigma": 6.0, "xi": -0.1}, 4)
    return x.select("channel", F.explode("path").alias("e")).select("channel", "e.t", "e.eta")


@query()
def systematic_draws(spark, sf_dir):
    w = posterior.grid_posterior(channels(spark, sf_dir), LEVEL, _GRID)
    return posterior.take(w, 200).select("channel", "chain", "draw", "point")


_PARETO = """WITH a AS (SELECT event_type AS channel, coalesce(value, 0) AS w, CAST(ceil(least(count(*) OVER (PARTITION BY event_type) / 5.0, 3 * sqrt(count(*) OVER (PARTITION BY event_type)))) AS INTEGER) AS m, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(value, 0) DESC) AS down FROM events),
 c AS (SELECT channel, w AS cut FROM a WHERE down = m + 1), t AS (SELECT a.channel, m, cut, m - down + 1 AS i, w - cut AS x FROM a JOIN c USING (channel) WHERE down <= m),
 b AS (SELECT channel, m, max(x) AS top, max(x) FILTER (i = CAST(floor(m / 4.0 + 0.5) AS INTEGER)) AS quarter, CAST(30 + floor(sqrt(m)) AS INTEGER) AS n FROM t GROUP BY channel, m),
 g AS (SELECT channel, m, j.j, 1 / top + (1 - sqrt(n / (j.j - 0.5))) / (3 * quarter) AS theta FROM b, (SELECT unnest(range(1, 500)) AS j) j WHERE j.j <= n),
 k AS (SELECT g.channel, g.m, g.j, g.theta, avg(ln(1 - g.theta * x)) AS k FROM g JOIN t ON t.channel = g.channel GROUP BY 1, 2, 3, 4),
 l AS (SELECT *, m * (ln(-theta / k) - k - 1) AS l FROM k), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY channel)) AS e FROM l), h AS (SELECT channel, sum(theta * e) / sum(e) AS theta FROM e GROUP BY 1),
 f AS (SELECT t.channel, t.m, h.theta, avg(ln(1 - h.theta * x)) AS k FROM t JOIN h ON h.channel = t.channel GROUP BY 1, 2, 3)
 SELECT channel, m, round((m * k + 5) / (m + 10), 6) AS shape, round(-k / theta, 6) AS scale FROM f"""


@query(_PARETO)
def pareto_shape(spark, sf_dir):
    """The tail of each event type's values, taken as weights."""
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("value").alias("weight"))
    return rounded(pareto.fit(x).drop("cut"), "shape", "scale")


@query(f"""WITH {OBS}, last AS (SELECT channel, max(t) AS t0, max(day) AS d0 FROM obs GROUP BY 1), k AS (SELECT unnest(range(1, 15)) AS k)
 SELECT channel, CAST(t0 + k AS INTEGER) AS t, CAST(d0 + CAST(k AS INTEGER) AS TIMESTAMP) AS ts FROM last, k""")
def future_calendar(spark, sf_dir):
    return predictive.future_calendar(channels(spark, sf_dir), 14, second_step=86400)


# ---- summaries over draws


@query(f"WITH {PSEUDO} SELECT channel, t, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.025), 6) AS lower, round(quantile_cont(y, 0.975), 6) AS upper FROM pseudo GROUP BY 1, 2")
def predictive_summary(spark, sf_dir):
    return rounded(summaries.summarize(pseudo(spark, sf_dir), ["channel", "t"], "y"), "mean", "lower", "upper")


@query(f"WITH {PSEUDO}, r AS (SELECT *, {gev_sf_sql('60.0')} AS risk FROM pseudo) SELECT channel, t, round(avg(risk), 6) AS mean, round(quantile_cont(risk, 0.025), 6) AS lower, round(quantile_cont(risk, 0.975), 6) AS upper FROM r GROUP BY 1, 2")
def risk_by_time(spark, sf_dir):
    return rounded(plotdata.frame("risk", pseudo(spark, sf_dir).withColumn("value", summaries.risk(F.lit(60.0), "upper"))), "mean", "lower", "upper")


@query(f"""WITH {PSEUDO}, h AS (SELECT unnest([50.0, 55.0, 60.0, 65.0, 70.0])::DOUBLE AS threshold), r AS (SELECT channel, threshold, {gev_sf_sql('threshold')} AS risk FROM pseudo, h WHERE t = 10)
 SELECT channel, threshold, round(avg(risk), 6) AS mean, round(quantile_cont(risk, 0.025), 6) AS lower, round(quantile_cont(risk, 0.975), 6) AS upper FROM r GROUP BY 1, 2""")
def risk_curve(spark, sf_dir):
    x = plotdata.frame("risk_curve", pseudo(spark, sf_dir), [50.0, 55.0, 60.0, 65.0, 70.0], lambda h: summaries.risk(h, "upper"), 10)
    return rounded(x, "mean", "lower", "upper")


@query(f"WITH {PSEUDO}, r AS (SELECT channel, t, location + sigma * (exp(-xi * ln(-ln(0.95))) - 1) / xi AS v FROM pseudo) SELECT channel, t, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM r GROUP BY 1, 2")
def return_level(spark, sf_dir):
    return rounded(plotdata.frame("return_level", pseudo(spark, sf_dir).withColumn("value", summaries.return_level(20, "upper"))), "mean", "lower", "upper")


@query(f"WITH {PSEUDO}, r AS (SELECT channel, draw, {gev_sf_sql('65.0')} AS risk FROM pseudo) SELECT channel, draw, round(CASE WHEN max(risk) >= 1 THEN 1 ELSE 1 - exp(sum(ln(1 - risk))) END, 6) AS risk FROM r GROUP BY 1, 2")
def window_risk(spark, sf_dir):
    x = pseudo(spark, sf_dir).withColumn("risk", summaries.risk(F.lit(65.0), "upper"))
    return rounded(summaries.window_risk(x, ["channel", "draw"]), "risk")


@query(f"WITH {PSEUDO} SELECT channel, draw, CAST(floor(t / 5) AS INTEGER) AS block, round(max(y), 6) AS largest, round(min(y), 6) AS smallest, count(*) AS n FROM pseudo GROUP BY 1, 2, 3")
def block_extremes(spark, sf_dir):
    return rounded(summaries.block_extremes(pseudo(spark, sf_dir), 5, ["channel", "draw"]), "largest", "smallest")


@query(f"""WITH {PSEUDO}, l AS (SELECT unnest([0.5, 0.9, 0.95])::DOUBLE AS level),
 q AS (SELECT channel, t, [quantile_cont(y, 0.25), quantile_cont(y, 0.05), quantile_cont(y, 0.025)] AS lo, [quantile_cont(y, 0.75), quantile_cont(y, 0.95), quantile_cont(y, 0.975)] AS hi FROM pseudo GROUP BY 1, 2),
 e AS (SELECT channel, t, level, lo[CASE level WHEN 0.5 THEN 1 WHEN 0.9 THEN 2 ELSE 3 END] AS lo, hi[CASE level WHEN 0.5 THEN 1 WHEN 0.9 THEN 2 ELSE 3 END] AS hi FROM q, l)
 SELECT channel, level, count(*) AS n, round(avg(CASE WHEN o.y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width, count(*) FILTER (o.y < lo) AS below, count(*) FILTER (o.y > hi) AS above FROM e JOIN obs o USING (channel, t) GROUP BY 1, 2""")
def coverage_table(spark, sf_dir):
    return rounded(summaries.coverage(pseudo(spark, sf_dir), channels(spark, sf_dir), (0.5, 0.9, 0.95)), "coverage", "width")


@query(f"""WITH {PSEUDO}, q AS (SELECT channel, t, quantile_cont(y, 0.025) AS lo, quantile_cont(y, 0.975) AS hi FROM pseudo GROUP BY 1, 2)
 SELECT channel, CAST(floor(t / 10) AS INTEGER) AS "window", count(*) AS n, round(avg(CASE WHEN o.y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM q JOIN obs o USING (channel, t) GROUP BY 1, 2""")
def coverage_by_lead(spark, sf_dir):
    return rounded(summaries.coverage_by_lead(pseudo(spark, sf_dir), channels(spark, sf_dir), -1, 10), "coverage")


@query(f"""WITH {PSEUDO}, s AS (SELECT channel, round(mu + s, 3) AS threshold FROM base), seen AS (SELECT channel, threshold, count(*) FILTER (y > threshold) AS observed FROM obs JOIN s USING (channel) GROUP BY 1, 2),
 per AS (SELECT channel, threshold, draw, sum({gev_sf_sql('threshold')}) AS expected, count(*) FILTER (y > threshold) AS n FROM pseudo JOIN s USING (channel) GROUP BY 1, 2, 3)
 SELECT channel, threshold, max(observed) AS observed, round(avg(expected), 6) AS expected, round(avg(CASE WHEN n >= observed THEN 1.0 ELSE 0.0 END), 6) AS p_at_least, round(avg(CASE WHEN n <= observed THEN 1.0 ELSE 0.0 END), 6) AS p_at_most FROM per JOIN seen USING (channel, threshold) GROUP BY 1, 2""")
def threshold_counts(spark, sf_dir):
    obs = channels(spark, sf_dir)
    spec = obs.groupBy("channel").agg(F.round(F.avg("y") + F.stddev_pop("y"), 3).alias("threshold"))
    rows = summaries.by_specification(pseudo(spark, sf_dir), spec, summaries.risk(F.col("threshold"), "upper"))
    return rounded(summaries.threshold_counts(rows, obs, spec), "expected", "p_at_least", "p_at_most")


@query(f"""WITH {PSEUDO}, s AS (SELECT channel, round(mu + s, 3) AS threshold FROM base), seen AS (SELECT channel, threshold, count(*) FILTER (y > threshold) AS observed FROM obs JOIN s USING (channel) WHERE t % 7 = 3 GROUP BY 1, 2),
 per AS (SELECT channel, threshold, draw, sum({gev_sf_sql('threshold')}) AS expected, count(*) FILTER (y > threshold) AS n FROM pseudo JOIN s USING (channel) WHERE t % 7 = 3 GROUP BY 1, 2, 3)
 SELECT channel, threshold, max(observed) AS observed, round(avg(expected), 6) AS expected, round(avg(CASE WHEN n >= observed THEN 1.0 ELSE 0.0 END), 6) AS p_at_least, round(avg(CASE WHEN n <= observed THEN 1.0 ELSE 0.0 END), 6) AS p_at_most FROM per JOIN seen USING (channel, threshold) GROUP BY 1, 2""")
def threshold_counts_of_phase(spark, sf_dir):
    obs = channels(spark, sf_dir)
    spec = obs.groupBy("channel").agg(F.round(F.avg("y") + F.stddev_pop("y"), 3).alias("threshold"))
    rows = summaries.by_specification(pseudo(spark, sf_dir), spec, summaries.risk(F.col("threshold"), "upper"))
    return rounded(summaries.threshold_counts(*(summaries.of_phase(x, 7, 3) for x in (rows, obs)), spec), "expected", "p_at_least", "p_at_most")


@query(f"WITH {PSEUDO}, m AS (SELECT channel, t, avg(y) AS m FROM pseudo GROUP BY 1, 2) SELECT channel, round(avg(m - o.y), 6) AS mean_error FROM m JOIN obs o USING (channel, t) GROUP BY 1")
def mean_error(spark, sf_dir):
    return rounded(summaries.mean_error(pseudo(spark, sf_dir), channels(spark, sf_dir)), "mean_error")


@query(f"""WITH {PSEUDO}, v AS (SELECT DISTINCT channel || '.sigma' AS parameter, draw, sigma AS v FROM pseudo UNION ALL SELECT DISTINCT channel || '.xi', draw, xi FROM pseudo UNION ALL
 SELECT channel || '.location[t=' || (t + 1) || ']', draw, location FROM pseudo p WHERE t = (SELECT max(t) FROM pseudo q WHERE q.channel = p.channel))
 SELECT parameter, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM v GROUP BY 1""")
def summary_table(spark, sf_dir):
    x = pseudo(spark, sf_dir)
    params = x.groupBy("channel", "draw").agg(F.min("sigma").alias("sigma"), F.min("xi").alias("xi")).unpivot(["channel", "draw"], ["sigma", "xi"], "parameter", "value").drop("draw")
    paths = x.select("channel", F.lit("location").alias("component"), "t", F.col("location").alias("value"))
    return rounded(summaries.summary_table(params, paths), "mean", "sd", "lower", "upper")


@query(f"WITH {PSEUDO}, m AS (SELECT channel, draw, t, location AS m FROM pseudo), v AS (SELECT channel, t, max(m) - min(m) AS d FROM m GROUP BY 1, 2) SELECT channel, round(max(d), 6) AS spread FROM v GROUP BY 1")
def path_spread(spark, sf_dir):
    x = pseudo(spark, sf_dir).select(F.col("draw").alias("variant"), "channel", "t", F.col("location").alias("mean"))
    return rounded(summaries.path_spread(x), "spread")


@query(f"""WITH {PSEUDO} SELECT channel, CAST(t % 7 AS INTEGER) AS phase, round(avg(sigma), 6) AS mean, round(quantile_cont(sigma, 0.025), 6) AS lower, round(quantile_cont(sigma, 0.975), 6) AS upper FROM pseudo GROUP BY 1, 2""")
def observation_scale_by_phase(spark, sf_dir):
    return rounded(plotdata.frame("observation_scale", pseudo(spark, sf_dir), 7), "mean", "lower", "upper")


@query(f"""WITH {PSEUDO}, c AS (SELECT channel, location AS v, CASE WHEN t < 7 THEN 'initial' WHEN t > max(t) OVER (PARTITION BY channel) - 7 THEN 'final' END AS cycle, CAST(t % 7 AS INTEGER) AS phase FROM pseudo)
 SELECT channel, cycle, phase, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM c WHERE cycle IS NOT NULL GROUP BY 1, 2, 3""")
def seasonal_cycle(spark, sf_dir):
    x = pseudo(spark, sf_dir).select("channel", "t", F.col("location").alias("value"))
    return rounded(plotdata.frame("seasonal_cycle", x, 7), "mean", "lower", "upper")


@query(f"""WITH {PSEUDO}, v AS (SELECT DISTINCT channel, draw, sigma AS v FROM pseudo), s AS (SELECT channel, quantile_cont(v, 0.001) AS a, quantile_cont(v, 0.999) AS b, stddev_samp(v) * count(*) ** -0.2 AS h, count(*) AS n FROM v GROUP BY 1), g AS (SELECT *, a + (b - a) * i / 249 AS x FROM s, (SELECT unnest(range(250)) AS i))
 SELECT channel, round(x, 6) AS x, round(sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) / max(n * h) / 2.5066282746310002, 6) AS density FROM g JOIN v USING (channel) GROUP BY channel, g.x""")
def posterior_density(spark, sf_dir):
    x = pseudo(spark, sf_dir).groupBy("channel", "draw").agg(F.min("sigma").alias("value"))
    return rounded(plotdata.frame("posterior", x, ["channel"]), "x", "density")


# ---- diagnostics


def _pit(spark, sf_dir):
    """(channel, chain, draw, t, u): distribution values of the observations under each draw."""
    obs = channels(spark, sf_dir).select("channel", "t", F.col("y").alias("obs"))
    x = pseudo(spark, sf_dir).drop("y").join(obs, ["channel", "t"])
    return x.select("channel", "chain", "draw", "t", gev.cdf(F.col("obs"), F.col("location"), F.col("sigma"), F.col("xi")).alias("u"))


PIT = PSEUDO + ", pit AS (SELECT p.channel, p.chain, p.draw, p.t, 1 - " + gev_sf_sql("o.y") + " AS u FROM pseudo p JOIN obs o USING (channel, t))"
_CLIP = "greatest(least(u, 1 - 1e-12), 1e-12)"
# scores of clipped values need the far branch of the quantile
_FAR = f"(CASE WHEN least({_CLIP}, 1 - {_CLIP}) >= 1e-10 THEN {ppf0_sql(_CLIP)} ELSE sign({_CLIP} - 0.5) * {horner_sql(normal.PPF_E, f'(sqrt(-ln(least({_CLIP}, 1 - {_CLIP}))) - 5)')} / {horner_sql(normal.PPF_F, f'(sqrt(-ln(least({_CLIP}, 1 - {_CLIP}))) - 5)')} END)".replace(">= 1e-10", ">= exp(-25)")
SCORES = PIT + f", scores AS (SELECT channel, t, avg({_FAR}) AS score FROM pit GROUP BY 1, 2)"


@query(f"WITH {PIT} SELECT channel, t, round(avg(u), 6) AS pit FROM pit GROUP BY 1, 2")
def predictive_pit(spark, sf_dir):
    return rounded(diagnostics.predictive_pit(_pit(spark, sf_dir)), "pit")


@query(f"WITH {PIT}, m AS (SELECT channel, t, avg(u) AS pit FROM pit GROUP BY 1, 2), b AS (SELECT channel, CAST(least(floor(pit * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY 1, 2) SELECT channel, bin, n, round(n * 10 / sum(n) OVER (PARTITION BY channel), 6) AS density FROM b")
def pit_histogram(spark, sf_dir):
    return rounded(plotdata.frame("pit", diagnostics.predictive_pit(_pit(spark, sf_dir))), "density")


@query(f"WITH {PIT}, k AS (SELECT channel, draw, u, row_number() OVER (PARTITION BY channel, draw ORDER BY u) AS i, count(*) OVER (PARTITION BY channel, draw) AS n FROM pit) SELECT channel, draw, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS distance FROM k GROUP BY 1, 2")
def ks_distance(spark, sf_dir):
    return rounded(diagnostics.ks_distance(_pit(spark, sf_dir), ["channel", "draw"]), "distance")


@query(f"""WITH {PIT}, rep AS (SELECT channel, draw, v AS u FROM pseudo), k AS (SELECT 0 AS r, channel, draw, u FROM pit UNION ALL SELECT 1, channel, draw, u FROM rep),
 i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY r, channel, draw) AS n FROM k WINDOW w AS (PARTITION BY r, channel, draw ORDER BY u)), d AS (SELECT r, channel, draw, max(greatest(i / n - u, u - (i - 1) / n)) AS d FROM i GROUP BY 1, 2, 3)
 SELECT a.channel, round(avg(a.d), 6) AS distance, round(avg(b.d), 6) AS replicated, round(avg(CASE WHEN b.d >= a.d THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM d a JOIN d b ON a.r = 0 AND b.r = 1 AND a.channel = b.channel AND a.draw = b.draw GROUP BY 1""")
def posterior_checks(spark, sf_dir):
    x = pseudo(spark, sf_dir)
    rep = x.select("channel", "draw", gev.cdf(F.col("y"), F.col("location"), F.col("sigma"), F.col("xi")).alias("u"))
    d = [diagnostics.ks_distance(p, ["channel", "draw"]) for p in (_pit(spark, sf_dir), rep)]
    return rounded(diagnostics.posterior_checks(*d), "distance", "replicated", "p_value")


@query(f"WITH {SCORES} SELECT channel, t, round(score, 6) AS score FROM scores")
def normal_scores(spark, sf_dir):
    return rounded(diagnostics.normal_scores(_pit(spark, sf_dir)), "score")


@query(f"WITH {SCORES}, k AS (SELECT channel, score, row_number() OVER (PARTITION BY channel ORDER BY score) AS i, count(*) OVER (PARTITION BY channel) AS n FROM scores) SELECT channel, CAST(i AS INTEGER) AS i, round({ppf0_sql('((i - 0.5) / n)')}, 6) AS theoretical, round(score, 6) AS sample FROM k")
def normal_qq_points(spark, sf_dir):
    return rounded(plotdata.frame("normal_qq", diagnostics.normal_scores(_pit(spark, sf_dir))), "theoretical", "sample")


@query(f"""WITH {SCORES}, z AS (SELECT channel, t, score - avg(score) OVER (PARTITION BY channel) AS z FROM scores), k AS (SELECT unnest(range(21)) AS lag), s AS (SELECT channel, sum(z * z) AS s FROM z GROUP BY 1)
 SELECT a.channel, CAST(k.lag AS INTEGER) AS lag, round(sum(a.z * b.z) / max(s.s), 6) AS acf FROM z a JOIN k ON true JOIN z b ON b.channel = a.channel AND b.t = a.t - k.lag JOIN s ON s.channel = a.channel GROUP BY 1, 2""")
def acf(spark, sf_dir):
    return rounded(plotdata.frame("acf", diagnostics.normal_scores(_pit(spark, sf_dir))), "acf")


@query(f"WITH {SCORES} SELECT a.channel AS channel_a, b.channel AS channel_b, round(corr(a.score, b.score), 6) AS correlation FROM scores a JOIN scores b USING (t) GROUP BY 1, 2")
def residual_correlation(spark, sf_dir):
    return rounded(diagnostics.residual_association(diagnostics.normal_scores(_pit(spark, sf_dir))), "correlation")


def _parameter(spark, sf_dir):
    """(channel, chain, draw, value): a value with ties, 16 draws a chain."""
    x = pseudo(spark, sf_dir).where("t = 0")
    return x.select("channel", "chain", F.floor(F.col("draw") / CHAINS).cast("int").alias("draw"), F.round(F.col("location"), 1).alias("value"))


_PARAM = PSEUDO + f", v AS (SELECT channel, chain, CAST(floor(draw / {CHAINS}) AS INTEGER) AS draw, round(location, 1) AS value FROM pseudo WHERE t = 0), h AS (SELECT *, CASE WHEN draw < 8 THEN 0 ELSE 1 END AS part FROM v)"


def _rhat_sql(value: str, name: str) -> str:
    n = "count(*) OVER (PARTITION BY channel)"
    r = f"(rank() OVER (PARTITION BY channel ORDER BY {value}) + (count(*) OVER (PARTITION BY channel, {value}) - 1) / 2)"
    return f"""{name}_z AS (SELECT channel, chain, part, {ppf0_sql('q')} AS z FROM (SELECT *, ({r} - 0.375) / ({n} + 0.25) AS q FROM h2)),
 {name}_p AS (SELECT channel, chain, part, avg(z) AS m, var_samp(z) AS v, count(*) AS n FROM {name}_z GROUP BY 1, 2, 3), {name} AS (SELECT channel, sqrt((max(n) - 1) / max(n) + var_samp(m) / avg(v)) AS r FROM {name}_p GROUP BY 1)"""


@query(f"WITH {_PARAM}, h2 AS (SELECT *, abs(value - med) AS folded FROM (SELECT h.*, m.med FROM h JOIN (SELECT channel, quantile_cont(value, 0.5) AS med FROM h GROUP BY 1) m USING (channel))), {_rhat_sql('value', 'bulk')}, {_rhat_sql('folded', 'fold')} SELECT channel, round(greatest(bulk.r, fold.r), 6) AS rhat FROM bulk JOIN fold USING (channel)")
def rhat_split_rank(spark, sf_dir):
    return rounded(diagnostics.rhat(_parameter(spark, sf_dir), ["channel"]), "rhat")


def _ess_sql(value: str, name: str) -> str:
    r = f"(rank() OVER (PARTITION BY channel ORDER BY {value}) + (count(*) OVER (PARTITION BY channel, {value}) - 1) / 2)"
    return f"""{name}_z AS (SELECT channel, chain, part, draw % 8 AS i, {ppf0_sql('q')} AS z FROM (SELECT *, ({r} - 0.375) / (count(*) OVER (PARTITION BY channel) + 0.25) AS q FROM h2)),
 {name}_c AS (SELECT *, z - avg(z) OVER (PARTITION BY channel, chain, part) AS c, avg(z) OVER (PARTITION BY channel, chain, part) AS m FROM {name}_z),
 {name}_a AS (SELECT a.channel, k.k, sum(a.c * b.c) / 8 / 8 AS a FROM {name}_c a JOIN (SELECT unnest(range(8)) AS k) k ON true JOIN {name}_c b ON b.channel = a.channel AND b.chain = a.chain AND b.part = a.part AND b.i = a.i + k.k GROUP BY 1, 2),
 {name}_w AS (SELECT channel, max(a) FILTER (k = 0) * 8 / 7 AS w FROM {name}_a GROUP BY 1), {name}_b AS (SELECT channel, var_samp(m) AS b FROM (SELECT DISTINCT channel, chain, part, m FROM {name}_c) GROUP BY 1),
 {name}_r AS (SELECT a.channel, k // 2 AS pair, sum(CASE WHEN k = 0 THEN 1 ELSE 1 - (w - a) / (w * 7 / 8 + b) END) AS p FROM {name}_a a JOIN {name}_w USING (channel) JOIN {name}_b USING (channel) GROUP BY 1, 2),
 {name}_m AS (SELECT channel, pair, min(p) OVER w AS low, p FROM {name}_r WINDOW w AS (PARTITION BY channel ORDER BY pair)), {name} AS (SELECT channel, least(64, 64 / (2 * sum(CASE WHEN low > 0 THEN low ELSE 0 END) - 1)) AS ess FROM {name}_m GROUP BY 1)"""


@query(f"WITH {_PARAM}, h2 AS (SELECT * FROM h), {_ess_sql('value', 'e')} SELECT channel, round(ess, 6) AS ess FROM e")
def ess_bulk(spark, sf_dir):
    return rounded(diagnostics.ess_bulk(_parameter(spark, sf_dir), ["channel"]), "ess")


@query(f"WITH {_PARAM}, h2 AS (SELECT h.*, CASE WHEN value <= a THEN 1 ELSE 0 END AS ia, CASE WHEN value <= b THEN 1 ELSE 0 END AS ib FROM h JOIN (SELECT channel, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM h GROUP BY 1) USING (channel)), {_ess_sql('ia', 'e')}, {_ess_sql('ib', 'f')} SELECT channel, round(least(e.ess, f.ess), 6) AS ess FROM e JOIN f USING (channel)")
def ess_tail(spark, sf_dir):
    return rounded(diagnostics.ess_tail(_parameter(spark, sf_dir), ["channel"]), "ess")


@query(f"""WITH {OBS}, n AS (SELECT channel, greatest(CAST(ceil(count(*) * 0.5) AS INTEGER), 3) AS k FROM obs GROUP BY 1), d AS (SELECT a.channel, a.t AS t0, b.y, CAST(b.t - a.t AS DOUBLE) AS x, row_number() OVER (PARTITION BY a.channel, a.t ORDER BY abs(b.t - a.t)) AS i FROM obs a JOIN obs b USING (channel)),
 h AS (SELECT channel, t0, max(abs(x)) AS h FROM d JOIN n USING (channel) WHERE i <= k GROUP BY 1, 2), w AS (SELECT d.channel, d.t0, y, x, (1 - least(abs(x) / h, 1.0) ** 3) ** 3 AS w FROM d JOIN h USING (channel, t0)),
 s AS (SELECT channel, t0, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM w GROUP BY 1, 2)
 SELECT channel, CAST(t0 AS INTEGER) AS t, round((wxx * wy - wx * wxy) / (w * wxx - wx * wx), 6) AS smooth FROM s""")
def loess_smooth(spark, sf_dir):
    return rounded(plotdata.loess(channels(spark, sf_dir)), "smooth")


# ---- experiments


@query("""SELECT CAST(y AS INTEGER) AS years, CAST(4 * y AS INTEGER) AS steps, round(4 * y * 0.0025, 6) AS level_variance, round(sum((4 * y - k) * (4 * y - k) * 0.000004), 6) AS slope_variance, round(4 * y * 0.0025 + sum((4 * y - k) * (4 * y - k) * 0.000004), 6) AS total
 FROM (SELECT unnest([10, 20, 30]) AS y), (SELECT unnest(range(1, 121)) AS k) WHERE k <= 4 * y GROUP BY y""")
def prior_horizon_variance(spark, sf_dir):
    return rounded(experiments.prior_horizon(spark, [10, 20, 30], 4, 0.05, 0.002), "level_variance", "slope_variance", "total")


@query("""SELECT CAST(a AS INTEGER) AS years_a, CAST(b AS INTEGER) AS years_b, round(4 * least(a, b) * 0.0025 + sum((4 * a - k) * (4 * b - k)) * 0.000004, 6) AS covariance
 FROM (SELECT unnest([10, 20, 30]) AS a), (SELECT unnest([10, 20, 30]) AS b), (SELECT unnest(range(1, 121)) AS k) WHERE k <= 4 * least(a, b) GROUP BY a, b""")
def prior_horizon_covariance(spark, sf_dir):
    return rounded(experiments.prior_horizon_covariance(spark, [10, 20, 30], 4, 0.05, 0.002), "covariance")


#: Horizons, steps a year and draws of the prior's changes; what a draw's numbers are made from: its number times these.
HORIZONS, PER_YEAR, PRIOR_DRAWS = [10, 30], 4, 400
STEPS = {name: math.sqrt(p) % 1.0 for name, p in zip(("level", "slope", "seasonal", "initial_slope", "level0", "level1", "slope0", "slope1", "seasonal0", "seasonal1"), (2, 3, 5, 7, 11, 13, 17, 19, 23, 29))}
#: Amplitudes and the slope at the start, in spreads of a channel.
SIZES = {"level": 0.1, "slope": 0.002, "seasonal": 0.1, "initial_slope": 0.01}


def _horizon_sql() -> str:
    u = lambda name: f"(0.5 + d * CAST({STEPS[name]!r} AS DOUBLE) - floor(0.5 + d * CAST({STEPS[name]!r} AS DOUBLE)))"
    roots = experiments.horizon_roots(HORIZONS, PER_YEAR)
    z = ", ".join(f"{ppf0_sql('u_' + n)} AS z_{n}" for n in STEPS)
    parts = {g: {y: f"{'abs' if g != 'initial_slope' else ''}(z_{g}) * s * {SIZES[g]}" for y in HORIZONS} for g in SIZES}
    for i, y in enumerate(HORIZONS):
        for g, root in roots.items():
            parts[g][y] = f"({parts[g][y]} * (" + " + ".join(f"z_{g}{j} * CAST({root[i][j]!r} AS DOUBLE)" for j in range(i + 1)) + "))"
        parts["initial_slope"][y] = f"({parts['initial_slope'][y]} * {y * PER_YEAR})"
    rows = []
    for y in HORIZONS:
        own = {name: parts["initial_slope" if name == "initial_rate" else name][y] for name in experiments.CONTRIBUTIONS[:-1]}
        rows += [f"SELECT channel, h, {y} AS years, '{name}' AS contribution, {v} AS v FROM z" for name, v in (own | {"combined": " + ".join(own.values())}).items()]
    return f"""WITH {OBS}, b AS (SELECT channel, stddev_pop(y) AS s, round(stddev_pop(y) / 2, 3) AS h FROM obs GROUP BY 1), n AS (SELECT channel, s, h, {", ".join(f"{u(n)} AS u_{n}" for n in STEPS)} FROM b, (SELECT unnest(range({PRIOR_DRAWS})) AS d)),
 z AS (SELECT channel, s, h, {z} FROM n), c AS ({" UNION ALL ".join(rows)})
 SELECT channel, CAST(years AS INTEGER) AS years, contribution, h AS threshold, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_disc(v, 0.025), 6) AS lower_95, round(quantile_disc(v, 0.975), 6) AS upper_95, count(*) AS draws, round(avg(CASE WHEN v > h THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY 1, 2, 3, 4"""


@query(_horizon_sql())
def prior_horizon_changes(spark, sf_dir):
    """Changes over 10 and 30 years that priors in proportion to each channel's spread imply, and how often they pass half of it."""
    base = channels(spark, sf_dir).groupBy("channel").agg(F.stddev_pop("y").alias("s"))
    d = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(PRIOR_DRAWS - 1))))
    d = d.withColumns({f"z_{n}": ss.let(frac(0.5 + F.col("draw") * v), normal.ppf0) for n, v in STEPS.items()})
    size = lambda n: (F.col(f"z_{n}") if n == "initial_slope" else F.abs(f"z_{n}")) * F.col("s") * SIZES[n]
    d = d.withColumns({n: size(n) for n in SIZES})
    thresholds = base.select("channel", F.round(F.col("s") / 2, 3).alias("threshold"))
    x = experiments.horizon_changes(d, HORIZONS, PER_YEAR, lambda g, j: F.col(f"z_{g}{j}"))
    return rounded(experiments.horizon_table(x, thresholds), "mean", "sd", "lower_95", "upper_95", "share")


@query("""SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS variant, a::DOUBLE AS level_sd, b::DOUBLE AS slope_sd, c::DOUBLE AS scale_prior_sd FROM (SELECT unnest([0.05, 0.1, 0.2]) AS a), (SELECT unnest([0.001, 0.002]) AS b), (SELECT unnest([0.15, 0.3]) AS c)""")
def sensitivity_grid(spark, sf_dir):
    return experiments.grid_table(spark, {"level_sd": [0.05, 0.1, 0.2], "slope_sd": [0.001, 0.002], "scale_prior_sd": [0.15, 0.3]})


def _carry_forward(train, horizon):
    """A benchmark forecast: the training mean and spread as a normal predictive, by quantiles."""
    m = train.groupBy("channel").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.max("t").alias("t0"))
    m = m.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(98)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return m.select("channel", "draw", (F.col("t0") + F.col("k")).cast("int").alias("t"), normal.ppf((F.col("draw") + 1) / 100, F.col("m"), F.col("s")).alias("y"))


@query(f"""WITH {OBS}, o AS (SELECT unnest([9, 14, 19]) AS origin), m AS (SELECT origin, channel, avg(y) AS m, stddev_pop(y) AS s FROM obs, o WHERE t <= origin GROUP BY 1, 2), d AS (SELECT *, m + s * {ppf0_sql('((k + 1) / CAST(100 AS DOUBLE))')} AS v FROM m, (SELECT unnest(range(99)) AS k)),
 q AS (SELECT origin, channel, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM d GROUP BY 1, 2)
 SELECT channel, CAST(0.9 AS DOUBLE) AS level, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width, count(*) FILTER (y < lo) AS below, count(*) FILTER (y > hi) AS above, CAST(origin AS VARCHAR) AS origin
 FROM q JOIN obs USING (channel) WHERE t > origin AND t <= origin + 10 GROUP BY channel, origin""")
def rolling_origins(spark, sf_dir):
    x = experiments.rolling_origins(channels(spark, sf_dir), [9, 14, 19], 10, _carry_forward, lambda p, o: summaries.coverage(p, o, (0.9,)))
    return rounded(x, "coverage", "width")


@query('SELECT origin, channel, round(max(CASE WHEN level = 0.9 THEN coverage * 100 END), 4) AS "0.9" FROM (' + ORACLE_SQL["rolling_origins"] + ") GROUP BY origin, channel")
def coverage_pivot(spark, sf_dir):
    x = summaries.coverage_pivot(rolling_origins(spark, sf_dir), (0.9,))
    return x.select("origin", "channel", F.round("`0.9`", 4).alias("0.9"))


#: Origins of the refits, and days that each forecast is held against.
ORIGINS, HORIZON = [14, 19, 24], 5


def _refits(spark, sf_dir) -> dict[str, DataFrame]:
    """Every channel fitted anew at each origin: a moving level under normal observations."""
    obs = channels(spark, sf_dir)
    priors = plans.Priors(initial_level=plans.Normal(50.0, 20.0), level=plans.Normal(0.0, 2.0), variance=plans.InverseGamma(2.0, 60.0))
    level = plans.Model(components=(plans.LocalLevel(),), priors=priors)
    models = {r["channel"]: level for r in obs.select("channel").distinct().collect()}  # a model a channel
    return validation.refits(obs, models, ORIGINS, HORIZON, draws=400, points=200, predictive_draws=400)


@query()
def refit_coverage(spark, sf_dir):
    """Coverage after each origin: window 0 is the whole horizon, the others three days each."""
    fits = _refits(spark, sf_dir)
    whole = validation.coverage(fits, HORIZON).withColumn("window", F.lit(0))
    return whole.unionByName(validation.coverage_by_window(fits, 3).withColumn("requested", F.lit(3)))


@query()
def refit_counts(spark, sf_dir):
    """How often each channel passes its mean plus a spread after each origin, against what its forecasts expect."""
    spec = channels(spark, sf_dir).groupBy("channel").agg(F.round(F.avg("y") + F.stddev_pop("y"), 3).alias("threshold"))
    return validation.threshold_counts(_refits(spark, sf_dir), spec.withColumns({"tail": F.lit("upper"), "phase": F.lit(0)}), F.lit(0))


@query(f"""WITH {PSEUDO}, s AS (SELECT channel, round(mu + s, 3) AS threshold FROM base), r AS (SELECT channel, t, threshold, {gev_sf_sql('threshold')} AS risk FROM pseudo JOIN s USING (channel))
 SELECT channel, t, threshold, round(avg(risk), 6) AS mean, round(quantile_cont(risk, 0.025), 6) AS lower, round(quantile_cont(risk, 0.975), 6) AS upper, 'upper' AS tail FROM r GROUP BY 1, 2, 3""")
def risk_probabilities(spark, sf_dir):
    spec = channels(spark, sf_dir).groupBy("channel").agg(F.round(F.avg("y") + F.stddev_pop("y"), 3).alias("threshold"))
    return rounded(summaries.risk_table(pseudo(spark, sf_dir), spec), "mean", "lower", "upper")


@query(f"""WITH {OBS}, h AS (SELECT channel, CAST(t % 7 AS INTEGER) AS phase, t, y, max(y) OVER w AS h, min(y) OVER w AS l FROM obs WINDOW w AS (PARTITION BY channel, t % 7 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT channel, phase, t, round(y, 6) AS y, round(greatest(y, h), 6) AS highest, round(least(y, l), 6) AS lowest, coalesce(y > h, true) AS new_high, coalesce(y < l, true) AS new_low FROM h""")
def phase_records(spark, sf_dir):
    return rounded(summaries.records(channels(spark, sf_dir), 7), "y", "highest", "lowest")


@query(f"""WITH {OBS}, m AS (SELECT channel, max(t) AS last, count(*) / 60.0 + 0.01 AS a, sum(t) / CAST(60 AS DOUBLE) AS b, sum(t * t) / CAST(60 AS DOUBLE) + 0.01 AS d, sum(y) / 60.0 AS u, sum(y * t) / 60.0 AS v, round(avg(y) + stddev_pop(y), 3) AS threshold FROM obs GROUP BY 1),
 f AS (SELECT channel, last + k AS t, threshold, (d * u - b * v) / (a * d - b * b) + (a * v - b * u) / (a * d - b * b) * (last + k) AS mean FROM m, (SELECT unnest(range(1, 15)) AS k))
 SELECT channel, CAST(t AS INTEGER) AS t, round(mean, 6) AS mean, round(sqrt(60.0), 6) AS sd, threshold, round({cdf0_sql('((mean - threshold) / sqrt(60.0))')}, 6) AS risk FROM f""")
def linear_benchmark(spark, sf_dir):
    obs = channels(spark, sf_dir)
    spec = obs.groupBy("channel").agg(F.round(F.avg("y") + F.stddev_pop("y"), 3).alias("threshold"))
    return rounded(experiments.linear_benchmark(obs, 14, 60.0, plans.Normal(0.0, 10.0), spec), "mean", "sd", "risk")


# ---- the flagship


@query(f"""WITH RECURSIVE {DAILY}, m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(q) / 1000 AS y FROM daily GROUP BY 1),
 b AS (SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS t, y FROM m WHERE month > (SELECT min(month) FROM m) AND month < (SELECT max(month) FROM m)), v AS (SELECT avg(y) AS a, var_pop(y) AS r FROM b),
 k AS (SELECT -1 AS t, a AS m, r * 100 AS p, a, r FROM v UNION ALL SELECT b.t, k.m + (k.p + 0.1 * r) / (k.p + 1.1 * r) * (b.y - k.m), (k.p + 0.1 * r) * r / (k.p + 1.1 * r), a, r FROM k JOIN b ON b.t = k.t + 1)
 SELECT t, round(m, 6) AS level, round(p, 6) AS variance, round(1 - {cdf0_sql('((a + sqrt(r) - m) / sqrt(p + r))')}, 6) AS risk FROM k WHERE t >= 0""")
def monthly_level_risk(spark, sf_dir):
    """Months of shipped quantity: a local level filtered by a fold, and the chance that a month passes one
    standard deviation above the mean."""
    m = daily(spark, sf_dir).groupBy(F.trunc("day", "month").alias("month")).agg((F.sum("q") / 1000).alias("y"))
    every = Window.partitionBy(F.lit(0))
    m = m.withColumn("_a", F.min("month").over(every)).withColumn("_b", F.max("month").over(every)).where("month > _a AND month < _b")
    obs = blocks.number(m.select(F.lit("q").alias("channel"), "month", "y"), "month", ["channel"])
    s = obs.groupBy("channel").agg(F.avg("y").alias("a"), F.var_pop("y").alias("r"))
    plan = plans.compile_model(LEVEL)
    x = ss.series(obs, ["channel"]).join(s, "channel")
    # a wide start at the mean: deviations from it, from N(0, 100 r); the plan's own start is N(50, 100)
    x = x.withColumn("ys", F.transform("ys", lambda e: F.struct(e["t"].alias("t"), ((e["y"] - F.col("a")) / F.sqrt("r") + 50.0).alias("y"))))
    x = x.withColumn("e", F.explode(ss.forward(plan, F.col("ys"), {"level": F.lit(0.1)}, F.lit(1.0))))
    level, var = F.col("a") + (F.col("e.m")[0] - 50.0) * F.sqrt("r"), F.col("e.p")[0] * F.col("r")
    x = x.select(F.col("e.t").alias("t"), level.alias("level"), var.alias("variance"), "a", "r")
    risk = normal.sf(F.col("a") + F.sqrt("r"), F.col("level"), F.sqrt(F.col("variance") + F.col("r")))
    return rounded(x.withColumn("risk", risk).select("t", "level", "variance", "risk"), "level", "variance", "risk")
