"""Statistical process control over each substrate's series of panel densities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut
from lotwise.operators.listing import where_equal
from lotwise.operators.ordered import CHUNK, STATE, carried, decayed_sums, followed, in_chunks, medians, numbered
from lotwise.operators.yields import DIES, panel_yield
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX

#: Moving-range limit factor (D4 for two points) and MAD scale.
D4, MAD_SCALE = 3.267, 1.4826
LAMBDA, WIDTH, SLACK, DECISION = 0.2, 3.0, 0.5, 5.0


def series(spark: SparkSession, sf_dir: str, scope: str = "substrate_type", **wanted: str | None) -> DataFrame:
    """scope, seq, panel_id, x: panels in order of their first defect, a row per panel, cut from its lineage.

    ``scope`` is substrate_type or lot_id; ``wanted`` (lot_id, substrate_type) asks for some panels only.
    """
    first = fab.defects(spark, sf_dir).groupBy("panel_id", "panel_no", "lot_id").agg(F.min("created_at").alias("t"))
    values = where_equal(panel_yield(spark, sf_dir).select("panel_id", "substrate_type", F.col("defect_density").alias("x")).join(first, "panel_id"), **wanted)
    return cut(numbered(values.withColumn("scope", F.col(scope)), "scope", ["t", "panel_no"]).select("scope", "seq", "panel_id", "x"))


def baseline(points: DataFrame) -> DataFrame:
    """scope, mean, med, sigma: robust sigma from the MAD with its fallbacks for a flat series.

    Medians are selected by ranges of values, so a scope may hold any number of points.
    """
    a = points.groupBy("scope").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    a = cut(a.join(medians(points, "scope", "x", "med"), "scope"))
    deviations = points.join(a.select("scope", "med"), "scope").withColumn("dev", F.abs(F.col("x") - F.col("med")))
    robust = F.col("dev") * MAD_SCALE
    classic = F.when(F.col("med") > 0, F.greatest("sd", 0.10 * F.col("med"))).otherwise(F.col("sd"))
    last = F.when(F.col("mean") != 0, 0.10 * F.col("mean")).otherwise(1e-10)
    return a.join(medians(deviations, "scope", "dev", "dev"), "scope").select("scope", "mean", "med", "n", F.when(robust > 0, robust).when(F.col("sd") > 0, classic).otherwise(last).alias("sigma"))


@dataclass(frozen=True)
class Chart:
    """Chart parameters: EWMA weight (0 to 1) and width, CUSUM slack and decision interval in sigmas."""

    weight: float = LAMBDA
    width: float = WIDTH
    slack: float = SLACK
    decision: float = DECISION

    def __post_init__(self):
        if not 0 < self.weight <= 1 or self.width <= 0:
            raise ValueError("the EWMA weight must be in (0, 1] and its width positive")


def control_points(points: DataFrame, chart: Chart = Chart(), chunk: int = CHUNK) -> DataFrame:  # noqa: B008
    """Shewhart, moving range, EWMA and CUSUM values with their signals, for scopes of two points or more.

    ``points`` has scope, seq (dense from 1), panel_id and x. A scope of any length is worked on in chunks of
    ``chunk`` points: within a chunk CUSUM is a running sum less its running minimum and EWMA a decayed sum by
    doubling steps; what comes before a chunk is carried in as (sums, least prefixes, decayed sum), which
    compose, so chunks are scanned like points. The runs rules look back over the seven points that lead a chunk.
    """
    base = cut(baseline(points).filter("n >= 2"))
    rest, s = 1 - chart.weight, F.col("sigma")
    w = Window.partitionBy("scope", "chunk").orderBy("seq")
    z = F.col("x") - F.col("mean")
    recent = lambda cond, back: F.sum(F.when(cond, 1).otherwise(0)).over(w.rowsBetween(-back, 0))
    rules = {
        "mr": F.when(F.col("seq") == 1, 0.0).otherwise(F.abs(F.col("x") - F.lag("x").over(w))),
        "we1": (F.abs(z) > 3 * s) | (F.col("x") > F.col("med") + 3 * s),
        "ratio": (F.col("med") > 0) & (F.col("x") > 5 * F.col("med")),
        "we2": (F.col("seq") >= 3) & ((recent(z > 2 * s, 2) >= 2) | (recent(z < -2 * s, 2) >= 2)),
        "we3": (F.col("seq") >= 5) & ((recent(z > s, 4) >= 4) | (recent(z < -s, 4) >= 4)),
        "we4": (F.col("seq") >= 8) & ((recent(z > 0, 7) == 8) | (recent(z < 0, 7) == 8)),
    }
    mine = lambda value: F.when(F.col("own"), value).otherwise(0.0)
    sums = {"s_hi": F.sum(mine(z - chart.slack * s)).over(w), "s_lo": F.sum(mine(-z - chart.slack * s)).over(w), "b": mine(chart.weight * F.col("x"))}
    dealt = in_chunks(points.join(base, "scope"), "seq", chunk, halo=7).withColumns(rules | sums)
    dealt = decayed_sums(dealt, w, "b", rest, chunk + 7).withColumns({f"m_{arm}": F.min(F.when(F.col("own"), F.col(f"s_{arm}"))).over(w) for arm in ("hi", "lo")})
    local = cut(dealt.filter("own").drop("own", "n").withColumn("n", F.col("seq") - F.col("chunk") * chunk))
    if not local.filter("chunk > 0").isEmpty():
        ends = local.groupBy("scope", "chunk").agg(F.max_by(F.struct(*STATE), "seq").alias("s")).select("scope", "chunk", *(F.col(f"s.{c}").alias(c) for c in STATE))
        before = carried(ends, "scope", rest, chunk).select("scope", "chunk", *(F.col(c).alias(f"_{c}") for c in STATE))
        local = local.join(before, ["scope", "chunk"], "left").withColumns(dict(zip(STATE, followed(rest), strict=True)))
    ranges = medians(local.filter("seq >= 2"), "scope", "mr", "mr_med")
    out = local.join(ranges, "scope").withColumns({
        "mr_limit": F.when(F.col("mr_med") > 0, D4 * F.col("mr_med")).otherwise(D4 * s),
        "ewma": F.col("b") + F.pow(F.lit(rest), F.col("seq").cast("double")) * F.col("mean"),
        "cusum_hi": F.col("s_hi") - F.least(F.lit(0.0), "m_hi"), "cusum_lo": F.col("s_lo") - F.least(F.lit(0.0), "m_lo"),
    })
    width = chart.width * s * F.sqrt(F.lit(chart.weight / (2 - chart.weight)) * (1 - F.pow(F.lit(rest), 2.0 * F.col("seq"))))
    return out.select(
        "scope", "seq", "panel_id", "x", "mean", "sigma", (F.col("med") + 3 * s).alias("ucl"), F.greatest(F.lit(0.0), F.col("med") - 3 * s).alias("lcl"), "mr", "mr_limit",
        "ewma", (F.col("mean") + width).alias("ewma_ucl"), F.greatest(F.lit(0.0), F.col("mean") - width).alias("ewma_lcl"), "cusum_hi", "cusum_lo",
        "we1", "ratio", "we2", "we3", "we4", (F.col("mr") > F.col("mr_limit")).alias("imr"), ((F.col("ewma") > F.col("mean") + width) | (F.col("ewma") < F.greatest(F.lit(0.0), F.col("mean") - width))).alias("ewma_signal"),
        ((F.col("cusum_hi") > chart.decision * s) | (F.col("cusum_lo") > chart.decision * s)).alias("cusum_signal"),
    )


def spc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_points(series(spark, sf_dir))


def spc_lot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of the wafer lots, one scope each, with a quicker EWMA and a tighter CUSUM."""
    points = control_points(series(spark, sf_dir, "lot_id", substrate_type="wafer"), Chart(weight=0.4, width=2.5, slack=0.25, decision=4.0))
    return points.select("scope", "seq", "panel_id", "x", "ewma", "ewma_ucl", "cusum_hi", "cusum_lo", "ewma_signal", "cusum_signal")


SIGNALS = [("we1", "out_of_control"), ("ratio", "out_of_control"), ("we2", "warning"), ("we3", "warning"), ("we4", "warning"), ("ewma_signal", "warning"), ("cusum_signal", "out_of_control"), ("imr", "warning")]


def alarms_of(points: DataFrame, chart: Chart = Chart()) -> DataFrame:  # noqa: B008
    """One row per signal of a point: chart, rule, value, control limit, direction, severity; values to eight digits.

    A CUSUM alarm's direction is positive if that arm is over its interval; an EWMA alarm's limit is the upper one.
    """
    rising, interval = F.col("cusum_hi") > chart.decision * F.col("sigma"), chart.decision * F.col("sigma")
    none, way = F.lit(None).cast("string"), F.when(rising, "positive").otherwise("negative")
    of = {"ewma_signal": ("ewma", F.col("ewma"), F.col("ewma_ucl"), none), "cusum_signal": ("cusum", F.greatest("cusum_hi", "cusum_lo"), interval, way), "imr": ("imr", F.col("mr"), F.col("mr_limit"), none)}
    raised = []
    for column, severity in SIGNALS:
        kind, value, limit, direction = of.get(column, ("shewhart", F.col("x"), F.col("ucl"), none))
        raised.append(F.when(F.col(column), F.struct(
            F.lit(kind).alias("chart"), F.lit(column).alias("signal"), F.round(value, 8).alias("value"), F.round(limit, 8).alias("control_limit"), direction.alias("direction"), F.lit(severity).alias("severity")
        )))
    return points.select("scope", "seq", "panel_id", F.explode(F.array_compact(F.array(*raised))).alias("a")).select("scope", "seq", "panel_id", "a.*")


def spc_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms_of(spc_points(spark, sf_dir))


def spc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process state per scope: out of control beyond the upper limit (both to eight digits) or by CUSUM, warning on any signal."""
    any_signal = F.greatest(*(F.col(c).cast("int") for c, _ in SIGNALS)) == 1
    out = F.bool_or((F.round("x", 8) > F.round("ucl", 8)) | F.col("cusum_signal"))
    return spc_points(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("points"), F.when(out, "out_of_control").when(F.bool_or(any_signal), "warning").otherwise("in_control").alias("state"))


def capability(base: DataFrame, usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """Cp and Cpk of :func:`baseline` rows at the given limits, else the natural ones."""
    upper = F.col("mean") + 3 * F.col("sigma") if usl is None else F.lit(float(usl))
    lower = F.greatest(F.lit(0.0), F.col("mean") - 3 * F.col("sigma")) if lsl is None else F.lit(float(lsl))
    base = base.withColumn("usl", upper).withColumn("lsl", lower)
    fine = (F.col("sigma") > 0) & (F.col("usl") > F.col("lsl"))
    cpk = F.least(F.col("usl") - F.col("mean"), F.col("mean") - F.col("lsl")) / (3 * F.col("sigma"))
    rated = base.select("scope", "usl", "lsl", F.when(fine, (F.col("usl") - F.col("lsl")) / (6 * F.col("sigma"))).alias("cp"), F.when(fine, cpk).alias("cpk"))
    rounded = F.round("cpk", 9)  # at the natural limits Cpk is 1 but for its last bits
    return rated.withColumn("rating", F.when(rounded >= 1.67, "excellent").when(rounded >= 1.33, "capable").when(rounded >= 1.0, "marginal").when(F.col("cpk").isNotNull(), "incapable"))


def spc_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the natural limits, and at a fixed window (rows with limits ``fixed``)."""
    base = cut(baseline(series(spark, sf_dir)))
    natural = capability(base).withColumn("limits", F.lit("natural"))
    return natural.unionByName(capability(base, usl=0.004, lsl=0.00001).withColumn("limits", F.lit("fixed")))


QUERIES = {"spc_points": spc_points, "spc_lot_points": spc_lot_points, "spc_alarms": spc_alarms, "spc_state": spc_state, "spc_capability": spc_capability}

_W = "OVER (PARTITION BY scope ORDER BY seq"


def _recent(cond: str, back: int) -> str:
    return f"count(*) FILTER ({cond}) {_W} ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"


def _points_sql(weight: float = 0.2, width: float = 3.0, slack: float = 0.5, decision: float = 5.0, far: int | None = None) -> str:
    """CTEs from sr (scope, seq, panel_id, x) to pt, the charts; EWMA by recursion, or as a sum over ``far`` points back."""
    rest = f"{1 - weight}::DOUBLE"
    ewma = f"SELECT scope, 1::BIGINT AS seq, {weight} * x + {rest} * mean AS ewma FROM j WHERE seq = 1 UNION ALL SELECT j.scope, j.seq, {weight} * j.x + {rest} * ew.ewma FROM ew JOIN j ON j.scope = ew.scope AND j.seq = ew.seq + 1"
    if far:
        ewma = f"SELECT a.scope, a.seq, sum({weight} * b.x * pow({rest}, a.seq - b.seq)) + pow({rest}, a.seq) * any_value(a.mean) AS ewma FROM j a JOIN j b ON b.scope = a.scope AND b.seq BETWEEN a.seq - {far} AND a.seq GROUP BY a.scope, a.seq"
    return f"""
b0 AS (SELECT scope, avg(x) AS mean, median(x) AS med, coalesce(stddev_samp(x), 0.0) AS sd, count(*) AS n FROM sr GROUP BY 1),
b1 AS (SELECT scope, median(abs(x - med)) AS dev FROM sr JOIN b0 USING (scope) GROUP BY 1),
bl AS (SELECT scope, mean, med, n, CASE WHEN dev * 1.4826 > 0 THEN dev * 1.4826 WHEN sd > 0 THEN CASE WHEN med > 0 THEN greatest(sd, 0.10 * med) ELSE sd END WHEN mean <> 0 THEN 0.10 * mean ELSE 1e-10 END AS sigma FROM b0 JOIN b1 USING (scope)),
j AS (SELECT *, x - mean AS z, CASE WHEN seq = 1 THEN 0.0 ELSE abs(x - lag(x) {_W})) END AS mr FROM sr JOIN bl USING (scope) WHERE n >= 2),
mm AS (SELECT scope, median(mr) AS mr_med FROM j WHERE seq >= 2 GROUP BY 1),
s1 AS (SELECT *, CASE WHEN mr_med > 0 THEN 3.267 * mr_med ELSE 3.267 * sigma END AS mr_limit, sum(z - {slack} * sigma) {_W} ROWS UNBOUNDED PRECEDING) AS s_hi, sum(-z - {slack} * sigma) {_W} ROWS UNBOUNDED PRECEDING) AS s_lo FROM j JOIN mm USING (scope)),
ew AS ({ewma}),
s2 AS (SELECT *, s_hi - least(0.0, min(s_hi) {_W} ROWS UNBOUNDED PRECEDING)) AS cusum_hi, s_lo - least(0.0, min(s_lo) {_W} ROWS UNBOUNDED PRECEDING)) AS cusum_lo,
  abs(z) > 3 * sigma OR x > med + 3 * sigma AS we1, med > 0 AND x > 5 * med AS ratio,
  seq >= 3 AND ({_recent("z > 2 * sigma", 2)} >= 2 OR {_recent("z < -2 * sigma", 2)} >= 2) AS we2,
  seq >= 5 AND ({_recent("z > sigma", 4)} >= 4 OR {_recent("z < -sigma", 4)} >= 4) AS we3,
  seq >= 8 AND ({_recent("z > 0", 7)} = 8 OR {_recent("z < 0", 7)} = 8) AS we4,
  {width} * sigma * sqrt({weight}::DOUBLE / {2 - weight}::DOUBLE * (1 - pow({rest}, 2.0 * seq))) AS width FROM s1),
pt AS (SELECT s2.scope, s2.seq, panel_id, x, mean, sigma, med + 3 * sigma AS ucl, greatest(0.0, med - 3 * sigma) AS lcl, mr, mr_limit, ewma, mean + width AS ewma_ucl, greatest(0.0, mean - width) AS ewma_lcl, cusum_hi, cusum_lo,
  we1, ratio, we2, we3, we4, mr > mr_limit AS imr, ewma > mean + width OR ewma < greatest(0.0, mean - width) AS ewma_signal, cusum_hi > {decision} * sigma OR cusum_lo > {decision} * sigma AS cusum_signal
  FROM s2 JOIN ew ON ew.scope = s2.scope AND ew.seq = s2.seq)
"""


def _charts(scope: str = "substrate_type", where: str = "true", **chart) -> str:
    return PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + f""", ft AS (SELECT panel_id, panel_no, lot_id, min(created_at) AS t FROM defects GROUP BY ALL),
sr AS (SELECT {scope} AS scope, row_number() OVER (PARTITION BY {scope} ORDER BY t, panel_no) AS seq, panel_id, defect_density AS x FROM py JOIN ft USING (panel_id) WHERE {where}),""" + _points_sql(**chart)


SPC = _charts()
_ANY = " OR ".join(c for c, _ in SIGNALS)
_SHEWHART = ("shewhart", "x", "ucl", "NULL::VARCHAR")
_OF = {
    "ewma_signal": ("ewma", "ewma", "ewma_ucl", "NULL::VARCHAR"), "imr": ("imr", "mr", "mr_limit", "NULL::VARCHAR"),
    "cusum_signal": ("cusum", "greatest(cusum_hi, cusum_lo)", "5 * sigma", "CASE WHEN cusum_hi > 5 * sigma THEN 'positive' ELSE 'negative' END"),
}
ALARMS = " UNION ALL ".join(
    f"SELECT scope, seq, panel_id, '{_OF.get(c, _SHEWHART)[0]}' AS chart, '{c}' AS signal, round({_OF.get(c, _SHEWHART)[1]}, 8) AS value, round({_OF.get(c, _SHEWHART)[2]}, 8) AS control_limit, {_OF.get(c, _SHEWHART)[3]} AS direction, '{s}' AS severity FROM pt WHERE {c}"
    for c, s in SIGNALS
)


def charts_sql(series: str, **chart) -> tuple[str, str]:
    """SQL up to pt of any series (a WITH that ends with sr), and the SELECT of its alarms."""
    return series + "," + _points_sql(**chart), ALARMS


ORACLE_SQL = {
    "spc_points": SPC + "SELECT * FROM pt",
    "spc_lot_points": _charts("lot_id", "substrate_type = 'wafer'", weight=0.4, width=2.5, slack=0.25, decision=4.0) + "SELECT scope, seq, panel_id, x, ewma, ewma_ucl, cusum_hi, cusum_lo, ewma_signal, cusum_signal FROM pt",
    "spc_alarms": SPC + ALARMS,
    "spc_state": SPC + f"SELECT scope, count(*) AS points, CASE WHEN bool_or(round(x, 8) > round(ucl, 8) OR cusum_signal) THEN 'out_of_control' WHEN bool_or({_ANY}) THEN 'warning' ELSE 'in_control' END AS state FROM pt GROUP BY 1",
    "spc_capability": SPC + """, u AS (SELECT *, 'natural' AS limits, mean + 3 * sigma AS usl, greatest(0.0, mean - 3 * sigma) AS lsl FROM bl UNION ALL SELECT *, 'fixed', 0.004::DOUBLE, 0.00001::DOUBLE FROM bl),
v AS (SELECT scope, limits, usl, lsl, CASE WHEN sigma > 0 AND usl > lsl THEN (usl - lsl) / (6 * sigma) END AS cp, CASE WHEN sigma > 0 AND usl > lsl THEN least(usl - mean, mean - lsl) / (3 * sigma) END AS cpk FROM u)
SELECT *, CASE WHEN round(cpk, 9) >= 1.67 THEN 'excellent' WHEN round(cpk, 9) >= 1.33 THEN 'capable' WHEN round(cpk, 9) >= 1.0 THEN 'marginal' WHEN cpk IS NOT NULL THEN 'incapable' END AS rating FROM v""",
}
