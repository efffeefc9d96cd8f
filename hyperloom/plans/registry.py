"""Queries over the driver's tables, each with its SQL where SQL can express it.

Queries on ``order -> part`` read lineitem, those on ``minute -> user`` read events.  Doubles are rounded on both sides, since sums
run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cores, graphs, learning, mining, sampling, scores
from ..operators.hypergraph import Closure
from ..sources import generators
from . import reports, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _hyper(raw: str) -> str:
    return f"""WITH raw AS ({raw}),
fit AS (SELECT hid, count(*) AS size FROM raw GROUP BY hid HAVING count(*) BETWEEN 2 AND 25),
mem AS (SELECT hid, list_sort(list(v)) AS members FROM raw SEMI JOIN fit USING (hid) GROUP BY hid),
hy AS (SELECT min(hid) AS hid, members, len(members) AS size FROM mem GROUP BY members),
inc AS (SELECT hid, size, unnest(members) AS v FROM hy),
edges AS (SELECT a.v AS u, b.v AS v, count(*) AS nhy, CAST(sum(a.size - 2) AS BIGINT) AS hsum, max(a.size) AS hmax FROM inc a JOIN inc b ON a.hid = b.hid AND a.v < b.v GROUP BY 1, 2),
slots AS (SELECT u AS x, v AS c, u, v FROM edges UNION ALL SELECT v, u, u, v FROM edges),
deg AS (SELECT x AS v, count(*) AS deg FROM slots GROUP BY 1),
ed AS (SELECT e.*, a.deg AS du, b.deg AS dv FROM edges e JOIN deg a ON a.v = e.u JOIN deg b ON b.v = e.v),
ori AS (SELECT CASE WHEN (du, u) < (dv, v) THEN u ELSE v END AS x, CASE WHEN (du, u) < (dv, v) THEN v ELSE u END AS y, least(du, dv) AS dx, greatest(du, dv) AS dy FROM ed),
tri AS (SELECT f.x, f.y, g.y AS z, f.dx, f.dy, g.dy AS dz FROM ori f JOIN ori g ON f.x = g.x AND (f.dy, f.y) < (g.dy, g.y) JOIN ori h ON h.x = f.y AND h.y = g.y),
cov AS (SELECT DISTINCT a.v AS a, b.v AS b, c.v AS c FROM inc a JOIN inc b ON a.hid = b.hid AND a.v < b.v JOIN inc c ON c.hid = b.hid AND b.v < c.v),
srt AS (SELECT *, least(x, y, z) AS a, greatest(x, y, z) AS c, x + y + z - least(x, y, z) - greatest(x, y, z) AS b FROM tri),
crs AS (SELECT x, y, z, dx, dy, dz FROM srt ANTI JOIN cov USING (a, b, c)),
ce AS (SELECT least(x, y) AS u, greatest(x, y) AS v FROM crs UNION ALL SELECT least(x, z), greatest(x, z) FROM crs UNION ALL SELECT least(y, z), greatest(y, z) FROM crs),
ve AS (SELECT a AS u, b AS v FROM cov UNION ALL SELECT a, c FROM cov UNION ALL SELECT b, c FROM cov),
et AS (SELECT ed.*, coalesce(t, 0) AS t, coalesce(covn, 0) AS covn FROM ed LEFT JOIN (SELECT u, v, count(*) AS t FROM ce GROUP BY 1, 2) USING (u, v) LEFT JOIN (SELECT u, v, count(*) AS covn FROM ve GROUP BY 1, 2) USING (u, v)),
st AS (SELECT count(*) AS m, CAST(sum(t) AS BIGINT) // 3 AS n_cross, CAST(sum(t + covn) AS BIGINT) // 3 AS n_triangles FROM et),
"""


ORDERS = _hyper("SELECT DISTINCT l_orderkey AS hid, l_partkey AS v FROM lineitem")
MINUTES = _hyper("SELECT DISTINCT CAST(floor(epoch(date_trunc('minute', ts)) / 60) AS BIGINT) AS hid, user_id AS v FROM events")
_WEIGHT = {"perfect": "t", "uniform": "0", "mindeg": "least(du, dv)"}


def _weighted(name: str) -> str:
    return f"""w AS (SELECT u, v, CAST({_WEIGHT[name]} AS DOUBLE) + 1 AS w FROM et),
sw AS (SELECT u AS x, w FROM w UNION ALL SELECT v, w FROM w),
dd AS (SELECT x, sum(w) AS d, sum(w * w) AS q FROM sw GROUP BY x),
tw AS (SELECT crs.*, a.w AS w_xy, b.w AS w_xz, c.w AS w_yz, d FROM crs JOIN w a ON a.u = least(x, y) AND a.v = greatest(x, y) JOIN w b ON b.u = least(x, z) AND b.v = greatest(x, z)
  JOIN w c ON c.u = least(y, z) AND c.v = greatest(y, z) JOIN dd USING (x)),
"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Queries that ask their closure several questions, so that its tables are computed once and kept.
_KEPT = {"profile", "p_succ_uniform", "p_succ_perfect", "p_succ_mindeg", "p_first_edge", "second_moment", "weighted_cost", "localized_cost", "weighted_wedge_cost", "edge_local_cost", "heavy_storage"}


def _over(view: str, build: Callable[[Closure], DataFrame], keep: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = tables.closure(spark, sf_dir, view)
        return build(c.persisted() if keep else c)

    return query


def _both(name: str, sql: str, build: Callable[[Closure], DataFrame], view: str = "orders") -> None:
    """A query over a closure, and the SQL after the closure's common tables."""
    prefix = ORDERS if view == "orders" else MINUTES
    _query(name, prefix.rstrip().rstrip(",") + "\n" + sql if not sql.startswith("+") else prefix + sql[1:])(_over(view, build, name in _KEPT))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _round_sql(columns: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in columns.items())


def _always(df: DataFrame, keys: dict[str, list], empty: dict) -> DataFrame:
    """A row for each of the keys' values, as SQL's aggregates give it where the view has no hyperedge: ``empty`` fills its columns, all others are null."""
    every = df.sparkSession.range(1).select()
    for k, values in keys.items():
        every = every.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(k))
    d = every.join(df.withColumn("_found", F.lit(True)), list(keys), "left")
    return d.select(*[F.when(F.col("_found").isNull(), F.lit(empty[c])).otherwise(F.col(c)).alias(c) if c in empty else F.col(c) for c in df.columns])


_both("hyperedge_sizes", "SELECT CAST(size AS BIGINT) AS size, count(*) AS n FROM hy GROUP BY 1", lambda c: c.hyperedges.groupBy(F.col("size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n")))
_both("vertex_degree", "SELECT v, deg FROM deg", lambda c: c.degrees.select("v", "deg"))
_both("vertex_table", "SELECT v, deg, n_hyper, row_number() OVER (ORDER BY deg, v) - 1 AS rk FROM deg JOIN (SELECT v, count(*) AS n_hyper FROM inc GROUP BY v) USING (v)", lambda c: c.vertices.select("v", "deg", "n_hyper", "rk"))
_both("edge_nhy", "SELECT nhy, count(*) AS n FROM edges GROUP BY nhy", lambda c: c.edges.groupBy("nhy").agg(F.count(F.lit(1)).alias("n")))
_both("edge_hstats", "SELECT u, v, nhy, hsum, CAST(hmax AS BIGINT) AS hmax FROM edges", lambda c: c.edges.drop("graph"))
_both("triangle_count", "SELECT count(*) AS n FROM tri", lambda c: c.triangle_count)
_both("cross_triangle_count", "SELECT m, n_cross, n_triangles FROM st", lambda c: c.stats.drop("graph"))
_both("edge_cross_t", "SELECT u, v, t FROM et", lambda c: c.edge_cross.select("u", "v", "t"))
_both("edge_covered", "SELECT u, v, covn FROM et", lambda c: c.edge_t.select("u", "v", "covn"))
_both("cross_triangles", "SELECT x, y, z FROM crs", lambda c: c.cross.select("x", "y", "z"), "minutes")
_both("top_edges", "SELECT u, v, t FROM et ORDER BY t DESC, u, v LIMIT 100", lambda c: c.edge_cross.select("u", "v", "t").orderBy(F.desc("t"), "u", "v").limit(100))
_SCORES = "vs AS (SELECT x AS v, CAST(sum(t) AS BIGINT) // 2 AS score FROM slots JOIN et USING (u, v) GROUP BY x)\n"
_both("vertex_scores", "+" + _SCORES + "SELECT v, score FROM vs", lambda c: mining.vertex_scores(c).drop("graph"))
_both("top100_share", "+" + _SCORES + "SELECT round(sum(CASE WHEN r <= 100 THEN score ELSE 0 END) / sum(score), 9) AS share FROM (SELECT *, row_number() OVER (ORDER BY score DESC, v) AS r FROM vs)", lambda c: mining.top_share(mining.vertex_scores(c)).select(F.round("share", 9).alias("share")))
_both(
    "profile",
    """+pm AS (SELECT least(a.nhy, b.nhy, c.nhy) AS k FROM crs JOIN edges a ON a.u = least(x, y) AND a.v = greatest(x, y) JOIN edges b ON b.u = least(x, z) AND b.v = greatest(x, z) JOIN edges c ON c.u = least(y, z) AND c.v = greatest(y, z)),
pp AS (SELECT count(*) FILTER (k >= 2) AS n_persistent FROM pm)
SELECT n_triangles, n_cross, n_persistent, round(n_cross / n_triangles, 9) AS f_cross, round(n_persistent / n_cross, 9) AS f_persistent, round(1 - n_persistent / n_cross, 9) AS f_transient FROM st, pp""",
    lambda c: _rounded(mining.profile(c).drop("graph"), {"f_cross": 9, "f_persistent": 9, "f_transient": 9}),
)
_both("wedge_total", "SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM deg", lambda c: scores.wedge_totals(c).drop("graph"))
_both("p_base", "SELECT round(n_cross / pow(2.0 * m, 1.5), 12) AS p FROM st", lambda c: scores.p_base(c).select(F.round("p", 12).alias("p")))
for _w in ("uniform", "perfect", "mindeg"):
    _both(f"p_succ_{_w}", "+" + _weighted(_w).rstrip().rstrip(",") + "\nSELECT round(sum(w_xy * w_xz / d) / (SELECT sum(w) FROM w), 10) AS p FROM tw", lambda c, w=_w: scores.p_succ(c, scores.weighting(c, w)).select(F.round("p", 10).alias("p")))
_P = _weighted("perfect").rstrip().rstrip(",") + "\n"
_U = _weighted("uniform").rstrip().rstrip(",") + "\n"
_both("p_first_edge", "+" + _P + "SELECT round(sum(w_xy / dx) / (SELECT sum(w) FROM w), 10) AS p FROM tw", lambda c: scores.p_succ(c, scores.weighting(c, "perfect"), True).select(F.round("p", 10).alias("p")))
_M2 = "m2 AS (SELECT sum((SELECT sum(w) FROM w) * d / (w_xy * w_xz)) AS m2 FROM tw)\n"
_both("second_moment", "+" + _P.rstrip() + ",\n" + _M2 + "SELECT round(m2 / 1e6, 3) AS m2 FROM m2", lambda c: scores.second_moment(c, scores.weighting(c, "perfect")).select(F.round(F.col("m2") / 1e6, 3).alias("m2")))
_VAR = "greatest(m2 - CAST(n_cross AS DOUBLE) * n_cross, 0)"
_both(
    "weighted_cost",
    "+" + _P.rstrip() + ",\n" + _M2 + f"SELECT round({_VAR} / 1e6, 3) AS var, round({_VAR} / pow(0.1 * n_cross, 2), 6) AS samples FROM m2, st",
    lambda c: scores.weighted_cost(c, scores.weighting(c, "perfect")).select(F.round(F.col("var") / 1e6, 3).alias("var"), F.round("samples", 6).alias("samples")),
)
_both(
    "localized_cost",
    "+" + _U.rstrip() + ",\n" + _M2 + f"SELECT round({_VAR} / pow(0.1 * n_cross, 2), 6) AS samples FROM m2, st",
    lambda c: scores.weighted_cost(c, scores.weighting(c, "uniform")).select(F.round("samples", 6).alias("samples")),
)
_both("baseline_cost", "SELECT round((n_cross * pow(2.0 * m, 1.5) - CAST(n_cross AS DOUBLE) * n_cross) / pow(0.1 * n_cross, 2), 6) AS samples FROM st", lambda c: scores.baseline_cost(c).select(F.round("samples", 6).alias("samples")))
_both(
    "wedge_cost",
    "+wt AS (SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM deg), wp AS (SELECT *, 3.0 * n_cross / wedges AS p FROM wt, st)\nSELECT wedges, round(p, 9) AS p, round(pow(wedges / 3.0, 2) * p * (1 - p) / pow(0.1 * n_cross, 2), 6) AS samples FROM wp",
    lambda c: scores.wedge_cost(c).select("wedges", F.round("p", 9).alias("p"), F.round("samples", 6).alias("samples")),
)
_both(
    "weighted_wedge_cost",
    "+" + _P.rstrip() + ",\nbt AS (SELECT sum(d * d - q) AS big_t FROM dd), iv AS (SELECT sum(1 / (w_xy * w_xz) + 1 / (w_xy * w_yz) + 1 / (w_xz * w_yz)) AS s FROM tw), m2 AS (SELECT big_t, s * big_t / 18 AS m2 FROM bt, iv)\n"
    f"SELECT round(big_t, 1) AS big_t, round({_VAR} / pow(0.1 * n_cross, 2), 6) AS samples FROM m2, st",
    lambda c: scores.wedge_weighted_cost(c, scores.weighting(c, "perfect")).select(F.round("big_t", 1).alias("big_t"), F.round("samples", 6).alias("samples")),
)
_both(
    "edge_local_cost",
    "SELECT round(var_pop(m * t / 3.0) / pow(0.1 * any_value(n_cross), 2), 5) AS samples, round(var_pop(m * t / 3.0) / pow(0.1 * any_value(n_cross), 2) * avg(du + dv), 3) AS words FROM et, st",
    lambda c: scores.edge_local_cost(c).select(F.round("samples", 5).alias("samples"), F.round("words", 3).alias("words")),
)
_both(
    "heavy_storage",
    """+grid AS (SELECT DISTINCT least(greatest(CAST(round_even(exp(ln(greatest(m, 2)) * i / 24), 0) AS BIGINT), 1), m) AS tau FROM st, range(25) r(i)),
rk AS (SELECT *, row_number() OVER (ORDER BY t DESC, u, v) AS r FROM et),
rest AS (SELECT tau, count(r) AS n, coalesce(var_pop(CAST(t AS DOUBLE)), 0) AS vp, avg(du + dv) AS loc FROM grid LEFT JOIN rk ON r > tau GROUP BY tau),
cost AS (SELECT tau, CASE WHEN n = 0 THEN CAST(tau AS DOUBLE) ELSE tau + vp * pow(n / 3.0, 2) / pow(0.1 * n_cross, 2) * loc END AS words FROM rest, st)
SELECT round(words, 3) AS words, tau FROM cost ORDER BY cost.words, tau LIMIT 1""",
    lambda c: scores.heavy_storage_cost(c).select(F.round("words", 3).alias("words"), "tau"),
)
_both(
    "normalizer_inflation",
    "+" + _P.rstrip() + """,
mw AS (SELECT avg(w) AS mean, stddev_pop(w) / avg(w) AS weight_cv FROM w),
d0 AS (SELECT x, count(*) AS d0 FROM sw GROUP BY x),
dr AS (SELECT avg(d / mean / d0) AS d_mean_inflation, max(d / mean / d0) AS d_max_inflation, sum((d * d - q) / mean / mean) / sum(d0 * d0 - d0) AS t_inflation FROM dd JOIN d0 USING (x), mw)
SELECT (SELECT m FROM st) AS m, round(weight_cv, 8) AS weight_cv, round(d_mean_inflation, 8) AS d_mean_inflation, round(d_max_inflation, 8) AS d_max_inflation, round(t_inflation, 8) AS t_inflation FROM mw, dr""",
    lambda c: scores.normalizer_inflation(c, gains=False).select("m", *[F.round(x, 8).alias(x) for x in ("weight_cv", "d_mean_inflation", "d_max_inflation", "t_inflation")]),
)
_CD = "cd AS (SELECT p.c AS a, q.c AS b, count(*) AS codegree FROM slots p JOIN slots q ON p.x = q.x AND p.c < q.c GROUP BY 1, 2)\n"
_both("codegree", "+" + _CD + "SELECT codegree, count(*) AS n FROM cd GROUP BY codegree", lambda c: graphs.codegrees(c.edges).groupBy("codegree").agg(F.count(F.lit(1)).alias("n")), "minutes")
_both("c4_total", "+" + _CD + "SELECT CAST(sum(codegree * (codegree - 1) // 2) AS BIGINT) // 2 AS n_c4 FROM cd", lambda c: graphs.c4_total(graphs.codegrees(c.edges)).drop("graph"), "minutes")
_C4 = """wd AS (SELECT p.x AS x, p.c AS a, q.c AS b FROM slots p JOIN slots q ON p.x = q.x AND p.c < q.c),
qd AS (SELECT p.a, p.b, p.x AS x, q.x AS y FROM wd p JOIN wd q ON p.a = q.a AND p.b = q.b AND p.x < q.x WHERE (p.a, p.b) <= (p.x, q.x)),
hq AS (SELECT DISTINCT a.v AS v1, b.v AS v2, c.v AS v3, d.v AS v4 FROM inc a JOIN inc b ON a.hid = b.hid AND a.v < b.v JOIN inc c ON c.hid = a.hid AND b.v < c.v JOIN inc d ON d.hid = a.hid AND c.v < d.v),
qs AS (SELECT *, list_sort([a, b, x, y]) AS l FROM qd),
q4 AS (SELECT a, b, x, y, (least(a, x), greatest(a, x)) AS ax, (least(b, y), greatest(b, y)) AS b_y, (least(x, b), greatest(x, b)) AS xb, (least(y, a), greatest(y, a)) AS ya FROM qs WHERE NOT EXISTS (SELECT 1 FROM hq WHERE v1 = l[1] AND v2 = l[2] AND v3 = l[3] AND v4 = l[4])),
mt AS (SELECT *, least(ax, b_y) <= least(xb, ya) AS f FROM q4),
m4 AS (SELECT CASE WHEN f THEN ax ELSE xb END AS e FROM mt UNION ALL SELECT CASE WHEN f THEN b_y ELSE ya END FROM mt)
"""
_both("c4_cross", "+" + _C4 + "SELECT count(*) AS n_cross FROM q4", lambda c: c.c4.agg(F.count(F.lit(1)).alias("n_cross")), "minutes")
_both("c4_edge_t", "+" + _C4 + "SELECT u, v, coalesce(k, 0) AS t4 FROM edges LEFT JOIN (SELECT e[1] AS u, e[2] AS v, count(*) AS k FROM m4 GROUP BY 1, 2) USING (u, v)", lambda c: c.c4_edge_t.drop("graph"), "minutes")
_both("c4_success_uniform", "+" + _C4 + "SELECT round(count(*) / pow((SELECT m FROM st), 2), 10) AS p FROM q4", lambda c: scores.c4_success(c, scores.weighting(c, "uniform")).select(F.round("p", 10).alias("p")), "minutes")
_both("copy_bearing_k3", "+be AS (SELECT least(x, y) AS u, greatest(x, y) AS v FROM tri UNION ALL SELECT least(x, z), greatest(x, z) FROM tri UNION ALL SELECT least(y, z), greatest(y, z) FROM tri)\nSELECT u, v, count(*) AS copies FROM be GROUP BY 1, 2", lambda c: c.copy_bearing.drop("graph"))
_both(
    "copy_bearing_c4",
    "+" + _CD.rstrip() + ", hv AS (SELECT a AS x, b AS w FROM cd WHERE codegree >= 2 UNION ALL SELECT b, a FROM cd WHERE codegree >= 2)\nSELECT DISTINCT least(s.x, s.c) AS u, greatest(s.x, s.c) AS v FROM slots s JOIN slots k ON k.c = s.c AND k.x <> s.x JOIN hv ON hv.x = s.x AND hv.w = k.x",
    lambda c: graphs.copy_bearing_c4(c.edges).drop("graph"),
    "minutes",
)
_both("floor_degree", "SELECT max(least(dx, dy, dz)) AS tau FROM tri", lambda c: c.floor_degree.drop("graph"))
_both("incidence_graph", "SELECT DISTINCT least('v:' || v, 'e:' || hid) AS u, greatest('v:' || v, 'e:' || hid) AS v FROM inc", lambda c: graphs.incidence_graph(c.incidence).drop("graph"))
_both("gini_t", "SELECT round(sum((2 * r - n - 1) * t) / (any_value(n) * sum(t)), 9) AS gini FROM (SELECT t, row_number() OVER (ORDER BY t) AS r, count(*) OVER () AS n FROM et)", lambda c: mining.gini(c.edge_cross, "t").select(F.round("gini", 9).alias("gini")))
_both("t_spread", "SELECT round(avg(t), 8) AS t_mean, round(stddev_pop(t), 8) AS t_std, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE 0 END), 8) AS frac_zero, round(corr(ln(1 + nhy), ln(1 + t)), 8) AS corr_nhy FROM et", lambda c: c.edge_cross.agg(F.round(F.avg("t"), 8).alias("t_mean"), F.round(F.stddev_pop("t"), 8).alias("t_std"), F.round(F.avg((F.col("t") == 0).cast("double")), 8).alias("frac_zero"), F.round(F.corr(F.log1p("nhy"), F.log1p("t")), 8).alias("corr_nhy")))
#: Rounds of peeling in SQL, more than the view's cores take; each drops, for every k at once, the vertices with fewer than k neighbours left.
_PEEL = 150
_CORES = f"""core_at(it, k, v) AS (SELECT 0, CAST(k AS INTEGER), v FROM deg, range(1, 200) r(k) WHERE deg >= k
UNION ALL SELECT a.it + 1, a.k, a.v FROM core_at a JOIN slots s ON s.x = a.v JOIN core_at b ON b.k = a.k AND b.v = s.c WHERE a.it < {_PEEL} GROUP BY a.it, a.k, a.v HAVING count(*) >= a.k),
core AS (SELECT v, max(k) AS core FROM core_at WHERE it = {_PEEL} GROUP BY v)
"""
_RECURSIVE = MINUTES.replace("WITH raw", "WITH RECURSIVE raw", 1)
_F = [f"f{i}" for i in range(1, 14)] + ["y"]


@_query("core_numbers", _RECURSIVE + _CORES + "SELECT 'minute_user' AS graph, v, CAST(core AS BIGINT) AS core FROM core")
def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cores.core_numbers(tables.closure(spark, sf_dir, "minutes").edges.select("graph", "u", "v")).select("graph", "v", F.col("core").cast("long").alias("core"))


@_query(
    "feature_columns",
    _RECURSIVE + _CORES.rstrip() + """,
hk AS (SELECT v, count(*) AS k FROM inc GROUP BY v),
fe AS (SELECT et.*, a.core AS cu, b.core AS cv, p.k AS ku, q.k AS kv FROM et JOIN core a ON a.v = u JOIN core b ON b.v = et.v JOIN hk p ON p.v = u JOIN hk q ON q.v = et.v),
fx AS (SELECT u, v, ln(1 + least(du, dv)) AS f1, ln(1 + greatest(du, dv)) AS f2, ln(1 + du) + ln(1 + dv) AS f3, abs(ln(1 + du) - ln(1 + dv)) AS f4, ln(1 + least(cu, cv)) AS f5, ln(1 + greatest(cu, cv)) AS f6, ln(1 + cu) + ln(1 + cv) AS f7,
  ln(1 + least(ku, kv)) AS f8, ln(1 + greatest(ku, kv)) AS f9, ln(1 + nhy) AS f10, ln(1 + hsum) AS f11, ln(1 + hmax) AS f12, ln(1 + covn) AS f13, ln(1 + t) AS y FROM fe)
"""
    + f"SELECT u, v, {_round_sql({x: 9 for x in _F})} FROM fx",
)
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.closure(spark, sf_dir, "minutes").persisted()
    feats = mining.features(c, cores.core_numbers(c.edges.select("graph", "u", "v")))
    return _rounded(feats.select("u", "v", *_F), {x: 9 for x in _F})


_both("first_hyperedges", "+top AS (SELECT hid, size FROM hy ORDER BY hid LIMIT 1000)\nSELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS members FROM top", lambda c: reports.first_hyperedges(c.hyperedges, 1000).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("members")))


@_query(
    "window_counts",
    """WITH t AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_custkey * 2 AS u, l_partkey * 2 + 1 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM t), l AS (SELECT unnest([604800, 2592000]) AS len),
w AS (SELECT DISTINCT least(len, t1 - t0) AS span, CAST(floor(t0 + (greatest(t0, t1 - least(len, t1 - t0)) - t0) * CAST(i AS DOUBLE) / 5) AS BIGINT) AS s FROM b, l, range(6) r(i))
SELECT s, CAST(span AS BIGINT) AS span, count(DISTINCT (u, v)) AS m FROM w JOIN t ON ts >= s AND ts < s + span GROUP BY 1, 2""",
)
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.user_days(spark, sf_dir)
    b = cores.window_bounds(t, [604800, 2592000]).withColumnRenamed("graph", "g")
    rows = t.join(F.broadcast(b), (F.col("ts") >= F.col("s")) & (F.col("ts") < F.col("e")))
    return graphs.canonical(rows.select(F.concat_ws(":", F.col("s").cast("string"), F.col("span").cast("string")).alias("graph"), "u", "v")).groupBy("graph").agg(F.count(F.lit(1)).alias("m")).select(F.split("graph", ":")[0].cast("long").alias("s"), F.split("graph", ":")[1].cast("long").alias("span"), "m")


def _plain(name: str, sql: str, make: Callable[[SparkSession], DataFrame]) -> None:
    _query(name, sql)(lambda spark, sf_dir: graphs.canonical(make(spark)).select("u", "v"))


_DEDUP = "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e WHERE u <> v"
_plain("affine_plane", f"WITH e AS (SELECT 'P_' || x || '_' || ((a * x + b) % 7) AS u, 'L_' || a || '_' || b AS v FROM range(7) p(a), range(7) q(b), range(7) r(x) UNION ALL SELECT 'P_' || c || '_' || y, 'V_' || c FROM range(7) s(c), range(7) t(y)) {_DEDUP}", lambda s: generators.affine_plane(s, 7))
_plain("hubs", f"WITH e AS (SELECT 'h' AS u, 'leaf_' || i AS v FROM range(512) r(i) UNION ALL SELECT 'leaf_' || (2 * j), 'leaf_' || (2 * j + 1) FROM range(64) s(j)) {_DEDUP}", lambda s: generators.hubs(s, 4, 64))
_plain("friendship", f"WITH e AS (SELECT 'h' AS u, 'a_' || i AS v FROM range(64) r(i) UNION ALL SELECT 'h', 'b_' || i FROM range(64) r(i) UNION ALL SELECT 'a_' || i, 'b_' || i FROM range(64) r(i) UNION ALL SELECT 'L_' || i, 'R_' || j FROM range(8) p(i), range(8) q(j)) {_DEDUP}", lambda s: generators.friendship_and_decoy(s, 64))
_plain(
    "set_disjointness",
    f"WITH f AS (SELECT unnest([0, 1, 2]) AS k, unnest([1, 0, 1]) AS x, unnest([1, 1, 0]) AS y), e AS (SELECT 'A_' || i AS u, 'B_' || j AS v FROM range(5) p(i), range(5) q(j) UNION ALL SELECT 'A_' || i, 'V_' || k || '_' || t FROM f, range(5) p(i), range(2) r(t) WHERE x = 1 UNION ALL SELECT 'B_' || i, 'V_' || k || '_' || t FROM f, range(5) p(i), range(2) r(t) WHERE y = 1) {_DEDUP}",
    lambda s: generators.set_disjointness(s, 5, 2, [1, 0, 1], [1, 1, 0]),
)

_plain(
    "plane_and_butterflies",
    "WITH e AS (SELECT 'P_' || x || '_' || ((a * x + b) % 7) AS u, 'L_' || a || '_' || b AS v FROM range(7) p(a), range(7) q(b), range(7) r(x) UNION ALL SELECT 'P_' || c || '_' || y, 'V_' || c FROM range(7) s(c), range(7) t(y) "
    f"UNION ALL SELECT x || '_' || g || '_' || i, 'H_' || g || '_' || t FROM range(130) o(g), range(2) h(t), (SELECT unnest(['G', 'G', 'F']) AS x, unnest([0, 1, -1]) AS k), LATERAL (SELECT CASE WHEN k < 0 THEN t || '_0' ELSE CAST(k AS VARCHAR) END AS i)) {_DEDUP}",
    lambda s: generators.plane_and_butterflies(s, 7, 130),
)


def _sql(prefix: str, *parts: str) -> str:
    """One statement from a closure's common tables and what follows them."""
    return prefix.rstrip().rstrip(",") + "".join(f",\n{x.strip().rstrip(',')}" for x in parts[:-1]) + "\n" + parts[-1]


def _success(prefix: str, name: str, inner: str = "w_xz / d") -> str:
    return "(" + _sql(prefix, _weighted(name), f"SELECT sum(w_xy * {inner}) / (SELECT sum(w) FROM w) FROM tw") + ")"


_STATS = _sql(MINUTES, "SELECT * FROM st")
_both("cross_second_form", "SELECT u, v, t FROM et", lambda c: c.edge_difference.select("u", "v", "t"))
_T4 = "t4 AS (SELECT u, v, coalesce(k, 0) + 1.0 AS w FROM edges LEFT JOIN (SELECT e[1] AS u, e[2] AS v, count(*) AS k FROM m4 GROUP BY 1, 2) USING (u, v)), q2 AS (SELECT CASE WHEN f THEN ax ELSE xb END AS e1, CASE WHEN f THEN b_y ELSE ya END AS e2 FROM mt), w4 AS (SELECT a.w AS w1, b.w AS w2 FROM q2 JOIN t4 a ON a.u = e1[1] AND a.v = e1[2] JOIN t4 b ON b.u = e2[1] AND b.v = e2[2])"
_both(
    "c4_success_perfect",
    "+" + _C4.rstrip() + ",\n" + _T4 + "\nSELECT round(sum(w1 * w2) / pow((SELECT sum(w) FROM t4), 2), 10) AS p, round(sum(w1) / ((SELECT sum(w) FROM t4) * (SELECT m FROM st)), 10) AS first FROM w4",
    lambda c: scores.c4_success(c, _t4(c)).join(scores.c4_success(c, _t4(c), True).withColumnRenamed("p", "first"), "graph").select(F.round("p", 10).alias("p"), F.round("first", 10).alias("first")),
    "minutes",
)


def _t4(c: Closure) -> DataFrame:
    return c.c4_edge_t.select("graph", "u", "v", F.col("t4").cast("double").alias("w"))


_both(
    "c4_guard",
    "+" + _CD.rstrip() + """,
gd AS (SELECT count(*) AS n, sum(deg * deg) AS s FROM deg), gc AS (SELECT coalesce(CAST(sum(codegree * (codegree - 1) // 2) AS BIGINT) // 2, 0) AS n_c4 FROM cd),
gr AS (SELECT CASE WHEN n > 3500 THEN 'vertices' WHEN s > 5e7 THEN 'sum of squared degrees' WHEN n_c4 > 15000000 THEN 'four-cycles' END AS r, n_c4 FROM gd, gc)
SELECT 'minute_user' AS graph, r IS NULL AS ok, coalesce(r, '') AS reason, CASE WHEN r IS NULL OR r = 'four-cycles' THEN n_c4 END AS n_c4 FROM gr""",
    lambda c: _always(c.c4_guard(), {"graph": ["minute_user"]}, {"ok": True, "reason": "", "n_c4": 0}),
    "minutes",
)
_CAPS = (200, 400)
ORACLE_SQL["cap_sensitivity"] = "\nUNION ALL\n".join(
    "SELECT * FROM (" + _sql(MINUTES.replace("FROM mem GROUP BY members)", f"FROM mem GROUP BY members ORDER BY hid LIMIT {k})"), _weighted("uniform"), f"SELECT 'minute_user' AS graph, CAST({k} AS INTEGER) AS cap, m, n_cross, round((SELECT sum(w_xy * w_xz / d) / (SELECT sum(w) FROM w) FROM tw) / (n_cross / pow(2.0 * m, 1.5)), 9) AS loc_x FROM st") + ")"
    for k in _CAPS
)
QUERIES["cap_sensitivity"] = _over("minutes", lambda c: _always(_rounded(reports.cap_sensitivity(c.hyperedges, list(_CAPS)), {"loc_x": 9}), {"graph": ["minute_user"], "cap": list(_CAPS)}, {"m": 0}))
_GAINS = {x: 8 for x in ("copy_density", "loc_x", "perfect_x", "firstedge_x", "perfect_over_loc", "mindeg_over_loc", "mindeg_capture")}
ORACLE_SQL["gains"] = (
    f"WITH s AS ({_STATS}), n AS ({_sql(MINUTES, 'SELECT count(*) AS n FROM deg')}), p AS (SELECT {_success(MINUTES, 'uniform')} AS unif, {_success(MINUTES, 'perfect')} AS perf, {_success(MINUTES, 'mindeg')} AS mind, {_success(MINUTES, 'perfect', '1.0 / dx')} AS first), "
    "r AS (SELECT *, n_cross / pow(2.0 * m, 1.5) AS base FROM s, n, p) SELECT 'minute_user' AS graph, n, m, n_cross, round(n_cross / m, 8) AS copy_density, round(unif / base, 8) AS loc_x, round(perf / base, 8) AS perfect_x, round(first / base, 8) AS firstedge_x, "
    "round(perf / unif, 8) AS perfect_over_loc, round(mind / unif, 8) AS mindeg_over_loc, round((mind / unif - 1) / (perf / unif - 1), 8) AS mindeg_capture FROM r"
)
QUERIES["gains"] = _over("minutes", lambda c: _rounded(reports.gains(c), _GAINS))


def _words(view: str, graph: str) -> str:
    """The comparison of a view's graph, with a statement per method."""
    prefix = ORDERS if view == "orders" else MINUTES
    var = "greatest(m2 - CAST(n_cross AS DOUBLE) * n_cross, 0) / pow(0.1 * n_cross, 2)"
    weighted = lambda w: _sql(prefix, _weighted(w), _M2, f"SELECT {var} FROM m2, st")
    heavy = ORACLE_SQL["heavy_storage"].removeprefix(ORDERS)
    each = {
        "baseline": _sql(prefix, "SELECT (n_cross * pow(2.0 * m, 1.5) - CAST(n_cross AS DOUBLE) * n_cross) / pow(0.1 * n_cross, 2) FROM st"),
        "wedge": _sql(prefix, "wt AS (SELECT CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS wedges FROM deg), wp AS (SELECT *, 3.0 * n_cross / wedges AS p FROM wt, st)", "SELECT pow(wedges / 3.0, 2) * p * (1 - p) / pow(0.1 * n_cross, 2) FROM wp"),
        "localized": weighted("uniform"),
        "weighted": weighted("perfect"),
        "edge_local": _sql(prefix, "SELECT var_pop(m * t / 3.0) / pow(0.1 * any_value(n_cross), 2) * avg(du + dv) FROM et, st"),
        "heavy": "SELECT words FROM (" + prefix + heavy + ")",
    }
    columns = ", ".join(f"({q}) AS {k}" for k, q in each.items())
    least = ", ".join(each)
    best = " ".join(f"WHEN {k} <= least({least}) THEN '{k}'" for k in each)
    return f"SELECT '{graph}' AS graph, m, n_cross, {least}, CASE {best} END AS best FROM ({_sql(prefix, 'SELECT m, n_cross FROM st')}), (SELECT {columns})"


_METHODS = ("baseline", "wedge", "localized", "weighted", "edge_local", "heavy")
ORACLE_SQL["comparison"] = f"SELECT graph, m, n_cross, {_round_sql({k: 3 for k in _METHODS})}, best FROM ({_words('orders', 'order_part')})"
QUERIES["comparison"] = _over("orders", lambda c: _rounded(scores.comparison(c), {k: 3 for k in _METHODS}))


@_query("method_wins", f"SELECT best, count(*) AS graphs FROM ({_words('orders', 'order_part')} UNION ALL {_words('minutes', 'minute_user')}) GROUP BY best")
def method_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [scores.comparison(tables.closure(spark, sf_dir, v)).select("graph", "best") for v in ("orders", "minutes")]
    return reports.wins(both[0].unionByName(both[1]))


# the types' hypergraphs side by side in one, told apart by the last two digits of their numbers
_TYPES = _hyper("SELECT DISTINCT CAST(floor(epoch(date_trunc('minute', ts)) / 60) AS BIGINT) * 100 + code AS hid, user_id * 100 + code AS v FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS code FROM events GROUP BY event_type) USING (event_type)")
_PER_TYPE = (
    _TYPES.rstrip().rstrip(",") + ",\nnm AS (SELECT event_type AS graph, row_number() OVER (ORDER BY event_type) AS code FROM events GROUP BY event_type), "
    "rep AS (SELECT graph, count(*) AS m, CAST(sum(t) AS BIGINT) // 3 AS n_cross, CAST(sum(t + covn) AS BIGINT) // 3 AS n_triangles FROM et JOIN nm ON u % 100 = code GROUP BY graph)\n"
)


@_query("graph_stats", _PER_TYPE + "SELECT * FROM rep")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Closure.of(tables.minutes_by_type(spark, sf_dir)).stats


@_query(
    "domain_summary",
    _PER_TYPE + "SELECT graph[1] AS domain, count(*) AS graphs, min(m) AS m_min, max(m) AS m_max, round(avg(m), 6) AS m_mean, round(stddev_pop(m), 6) AS m_std, min(n_cross) AS n_cross_min, max(n_cross) AS n_cross_max, round(avg(n_cross), 6) AS n_cross_mean, round(stddev_pop(n_cross), 6) AS n_cross_std FROM rep GROUP BY 1",
)
def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = Closure.of(tables.minutes_by_type(spark, sf_dir)).stats
    return _rounded(reports.summary(report, tables.event_domains(spark, sf_dir), ["m", "n_cross"]), {f"{c}_{k}": 6 for c in ("m", "n_cross") for k in ("mean", "std")})


# Without SQL: fixpoints, flows, draws and fits. tests/ hold them against known values or another way.


QUERIES["oracle_width"] = _over("minutes", lambda c: cores.oracle_width(c.copy_edges))
QUERIES["diagnostic"] = _over("minutes", reports.diagnostic)
QUERIES["evaluate"] = _over("minutes", lambda c: reports.evaluate(c, ["minute_user"], 20))
QUERIES["evaluate_c4"] = _over("minutes", lambda c: reports.evaluate_c4(c, ["minute_user"], 20))
QUERIES["wedge_report"] = _over("minutes", lambda c: reports.wedge_report(c, ["minute_user"], 20))
QUERIES["simulation"] = _over("minutes", lambda c: reports.simulation(c, [2000], 5))
QUERIES["simulated_profile"] = _over("minutes", lambda c: sampling.simulate_profile(c, scores.weighting(c, "perfect"), 2000, 5))
QUERIES["monte_carlo_check"] = _over("minutes", lambda c: sampling.monte_carlo_check(c, scores.weighting(c, "perfect"), 20000))
QUERIES["ranking"] = _over("minutes", lambda c: reports.ranking(c, [2000], 2))
QUERIES["triple_sensitivity"] = _over("minutes", lambda c: reports.triple_sensitivity(c, [10_000, 100]))
QUERIES["feature_diagnosis"] = _over("minutes", lambda c: mining.feature_diagnosis(c, mining.features(c, cores.core_numbers(c.edges.select("graph", "u", "v")))))


@_query("ridge_weights")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.closure(spark, sf_dir, "minutes")
    feats = mining.features(c, cores.core_numbers(c.edges.select("graph", "u", "v")))
    return learning.ridge_weights(learning.ridge_fit(feats, "ABC", 0.1)["minute_user"], feats)


@_query("hard_instances")
def hard_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hard_instances(spark, small=False)


@_query("object_scan")
def object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.object_scan(spark, (7, 11, 13, 17, 19))


@_query("window_sweep")
def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cores.window_sweep(tables.user_days(spark, sf_dir), cores.WINDOWS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that close the most cross triangles."""
    return QUERIES["top_edges"](spark, sf_dir)
