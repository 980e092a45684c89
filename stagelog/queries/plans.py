"""Queries that expand plan rows made from ``part``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelog import adapters as A
from stagelog.functions.units import rotate_move
from stagelog.plans import schedule as Sch, trajectories as Tr
from stagelog.queries import query

B = "bigint"

# Fixed expressions: the same plan table in both dialects.
PLAN_SQL = """plans AS (SELECT p_partkey AS plan_id, p_partkey*37%1001-500 AS x0, p_partkey*53%1001-500 AS y0,
  CASE WHEN p_partkey%2=0 THEN 'x' ELSE 'y' END AS axis, CAST(p_size AS BIGINT) AS size, p_partkey%5+2 AS n, p_partkey%3+1 AS reps FROM part)"""


def plans(spark, folder):
    k = F.col("p_partkey")
    return A.table(spark, folder, "part").select(
        k.alias("plan_id"), (k * 37 % 1001 - 500).alias("x0"), (k * 53 % 1001 - 500).alias("y0"),
        F.when(k % 2 == 0, "x").otherwise("y").alias("axis"), F.col("p_size").cast(B).alias("size"),
        (k % 5 + 2).alias("n"), (k % 3 + 1).alias("reps"))


_ON_AXIS = """x0 + CASE WHEN axis = 'x' THEN o ELSE 0 END AS x_nm, y0 + CASE WHEN axis = 'x' THEN 0 ELSE o END AS y_nm"""


@query("sawtooth_waypoints", f"""WITH {PLAN_SQL}, q AS (SELECT *, CAST(ceil(CAST(size*100 AS DOUBLE)/700) AS BIGINT) AS m FROM plans),
r AS (SELECT q.*, t.t AS seq FROM q, LATERAL (SELECT unnest(range(2*m*reps)) AS t) t),
s AS (SELECT *, CASE WHEN seq%(2*m) < m THEN seq%(2*m)+1 ELSE 2*m-seq%(2*m)-1 END*700 AS o FROM r)
SELECT plan_id, seq, {_ON_AXIS} FROM s""")
def sawtooth_waypoints(spark, folder):
    p = plans(spark, folder).withColumns({"range_nm": F.col("size") * 100, "step_nm": F.lit(700).cast(B)})
    return Tr.expand_plans(p, "sawtooth")


@query("square_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plans.*, t.t AS seq, n*size*10 AS side, size*10 AS d FROM plans, LATERAL (SELECT unnest(range(4*n)) AS t) t),
s AS (SELECT *, seq // n AS leg, seq % n * d AS o FROM r)
SELECT plan_id, seq, x0 + CASE leg WHEN 0 THEN 0 WHEN 1 THEN o WHEN 2 THEN side ELSE side-o END AS x_nm,
  y0 + CASE leg WHEN 0 THEN o WHEN 1 THEN side WHEN 2 THEN side-o ELSE 0 END AS y_nm FROM s""")
def square_waypoints(spark, folder):
    return Tr.expand_plans(plans(spark, folder).withColumn("range_nm", F.col("n") * F.col("size") * 10), "square")


@query("circle_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plans.*, t.t AS seq FROM plans, LATERAL (SELECT unnest(range(n+6)) AS t) t),
s AS (SELECT *, CASE WHEN reps = 1 THEN -1 ELSE 1 END * (2*pi()*seq/(n+5)) AS a FROM r)
SELECT plan_id, seq, x0 + CAST(trunc(size*997*cos(a)) AS BIGINT) AS x_nm, y0 + CAST(trunc(size*997*sin(a)) AS BIGINT) AS y_nm FROM s""")
def circle_waypoints(spark, folder):
    p = plans(spark, folder).select("plan_id", "x0", "y0", (F.col("n") + 5).alias("n"), (F.col("size") * 997).alias("radius_nm"),
                                    (F.col("reps") == 1).alias("clockwise"))
    return Tr.expand_plans(p, "circle")


def _uniform_sql(rows: str, seed: int, **salts: int) -> str:
    """``rows`` (plan_id and seq not negative) with a column of numbers in [0, 1) for each salt."""
    m, a = Tr.FIELD, f"((x + y) % {Tr.FIELD})"
    fifth = f"({a} * {a} % {m}) * ({a} * {a} % {m}) % {m} * {a} % {m}"

    def number(salt: int) -> str:
        keys = [seed, 0, salt, 0, f"plan_id % {m}", f"plan_id // {m}", f"seq % {m}", f"seq // {m}", *Tr.FINISH]
        return f"CAST(list_reduce([{', '.join(f'CAST({k} AS BIGINT)' for k in [0, *keys])}], lambda x, y: {fifth}) AS DOUBLE) / CAST({m} AS DOUBLE)"

    return f"SELECT *, {', '.join(f'{number(salt)} AS {name}' for name, salt in salts.items())} FROM {rows}"


@query("random_walk_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plan_id, x0, y0, size, t.t AS seq FROM plans, LATERAL (SELECT unnest(range(n+1)) AS t) t),
u AS ({_uniform_sql("r", 7, angle=Tr.ANGLE, radius=Tr.RADIUS)}), s AS (SELECT *, angle*CAST(2 AS DOUBLE)*pi() AS a, radius*(size*1000) AS d FROM u)
SELECT plan_id, seq, x0 + CASE WHEN seq > 0 THEN CAST(trunc(d*cos(a)) AS BIGINT) ELSE 0 END AS x_nm,
  y0 + CASE WHEN seq > 0 THEN CAST(trunc(d*sin(a)) AS BIGINT) ELSE 0 END AS y_nm FROM s""")
def random_walk_waypoints(spark, folder):
    """I4: the same random numbers in both engines."""
    return Tr.expand_plans(plans(spark, folder).withColumn("radius_nm", F.col("size") * 1000), "random_walk", seed=7)


@query("poi_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plan_id, x0, y0, t.t AS seq FROM plans, LATERAL (SELECT unnest(range(n)) AS t) t),
u AS ({_uniform_sql("r", 7, pick=Tr.PICK)}), s AS (SELECT *, CAST(floor(pick*3) AS BIGINT)*100 AS d FROM u)
SELECT plan_id, seq, x0+d AS x_nm, y0-d AS y_nm FROM s""")
def poi_waypoints(spark, folder):
    """Random picks from three points per plan."""
    point = [F.struct((F.col("x0") + d).alias("x"), (F.col("y0") - d).alias("y")) for d in (0, 100, 200)]
    return Tr.expand_plans(plans(spark, folder).withColumn("points", F.array(*point)), "poi", seed=7)


@query("major_minor_waypoints", f"""WITH {PLAN_SQL}, p AS (SELECT plan_id, x0, y0, axis, i, (3-i)*size*100 AS major, 150 AS minor, CASE WHEN i = 0 THEN 200 ELSE 0 END AS extra
  FROM plans, range(3) s(i)),
u AS (SELECT *, CAST(ceil(CAST(major+extra AS DOUBLE)/minor) AS BIGINT) AS up, CAST(ceil(CAST(major AS DOUBLE)/minor) AS BIGINT) AS lo FROM p),
r AS (SELECT u.*, t.t AS t FROM u, LATERAL (SELECT unnest(range(up + (up+lo) + lo)) AS t) t),
s AS (SELECT *, minor * CASE WHEN t < up THEN t+1 WHEN t < up+up+lo THEN up-(t-up)-1 ELSE -lo+(t-up-up-lo)+1 END AS o FROM r)
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY i, t) - 1 AS seq, {_ON_AXIS} FROM s""")
def major_minor_waypoints(spark, folder):
    pairs = F.array(*[F.struct((F.col("size") * 100 * k).alias("major"), F.lit(150).cast(B).alias("minor")) for k in (3, 2, 1)])
    return Tr.expand_plans(plans(spark, folder).withColumns({"pairs": pairs, "first_offset": F.lit(200).cast(B)}), "major_minor")


@query("loop_warmup_waypoints", f"""WITH {PLAN_SQL}, s AS (SELECT *, CASE WHEN reps = 2 THEN size*100 ELSE -size*100 END AS o FROM plans)
SELECT plan_id, CAST(0 AS BIGINT) AS seq, {_ON_AXIS} FROM s""")
def loop_warmup_waypoints(spark, folder):
    p = plans(spark, folder).withColumns({"range_nm": F.col("size") * 100, "reset": F.col("reps") == 2})
    return Tr.expand_plans(p, "loop_warmup")


@query("spiral_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plans.*, t.t AS seq, n+9 AS m FROM plans, LATERAL (SELECT unnest(range(n+9)) AS t) t),
s AS (SELECT *, CAST(seq AS DOUBLE)/m*(4*pi()) AS a, CAST(2000 AS DOUBLE)+CAST(1000 AS DOUBLE)*(CAST(seq AS DOUBLE)/(m-1)) AS radius FROM r)
SELECT plan_id, seq, CAST(trunc(x0+radius*cos(a)) AS BIGINT) AS x_nm, CAST(trunc(y0+radius*sin(a)) AS BIGINT) AS y_nm FROM s""")
def spiral_waypoints(spark, folder):
    return Tr.expand_plans(plans(spark, folder).withColumn("n", F.col("n") + 9), "spiral_warmup")


@query("linear_warmup_waypoints", f"""WITH {PLAN_SQL}, r AS (SELECT plans.*, t.t AS seq, n-1 AS m FROM plans, LATERAL (SELECT unnest(range(n-1)) AS t) t),
s AS (SELECT *, CASE WHEN m > 1 THEN CAST(1 AS DOUBLE)-CAST(seq AS DOUBLE)/(m-1) ELSE CAST(0 AS DOUBLE) END AS f FROM r)
SELECT plan_id, seq, CAST(trunc(x0+CAST(3000 AS DOUBLE)*f) AS BIGINT) AS x_nm, CAST(trunc(y0-CAST(3000 AS DOUBLE)*f) AS BIGINT) AS y_nm FROM s""")
def linear_warmup_waypoints(spark, folder):
    return Tr.expand_plans(plans(spark, folder).withColumn("n", F.col("n") - 1), "linear_warmup")


@query("angle_grid_tasks", f"""WITH {PLAN_SQL} SELECT plan_id, CAST(a*45 AS DOUBLE) AS r_target, (b-1)*1500000 AS x_nm, (c-1)*1500000 AS y_nm,
  a AS angle_no, b AS x_no, c AS y_no FROM plans, range(4) t1(a), range(3) t2(b), range(3) t3(c)""")
def angle_grid_tasks(spark, folder):
    mm = F.array(*[F.lit(v).cast(B) for v in (-1500000, 0, 1500000)])
    p = plans(spark, folder).select("plan_id", F.array(*[F.lit(float(a)) for a in (0, 45, 90, 135)]).alias("angles"),
                                    mm.alias("xs"), mm.alias("ys"))
    return Tr.angle_grid(p)


@query("stepwise_line_tasks", f"""WITH {PLAN_SQL}, s AS (SELECT *, t.t AS seq, CASE WHEN t.t = 0 THEN -900000 ELSE size*t.t*1000 END AS o
  FROM plans, LATERAL (SELECT unnest(range(4)) AS t) t) SELECT plan_id, seq, {_ON_AXIS} FROM s""")
def stepwise_line_tasks(spark, folder):
    p = plans(spark, folder).withColumns({
        "start": F.lit(-900000), "offsets": F.array(*[F.col("size") * k * 1000 for k in (1, 2, 3)])})
    return Tr.expand_plans(p, "lines")


@query("out_and_back_steps", f"""WITH {PLAN_SQL}, m AS (SELECT *, CAST(trunc(size*100*cos(radians(CAST(reps*30+5 AS DOUBLE)))) AS BIGINT) AS mx,
  CAST(trunc(size*100*sin(radians(CAST(reps*30+5 AS DOUBLE)))) AS BIGINT) AS my FROM plans),
r AS (SELECT m.*, t.t AS seq FROM m, LATERAL (SELECT unnest(range(2*n+1)) AS t) t),
s AS (SELECT *, CASE WHEN seq < n THEN seq+1 WHEN seq < 2*n THEN 2*n-seq-1 ELSE 0 END AS k FROM r)
SELECT plan_id, seq, CASE WHEN seq = 2*n THEN 'final' ELSE CAST(seq AS VARCHAR) END AS step, x0+mx*k AS x_nm, y0+my*k AS y_nm FROM s""")
def out_and_back_steps(spark, folder):
    p = plans(spark, folder).withColumns({"move": F.col("size") * 100, "r_target": (F.col("reps") * 30 + 5).cast("double")})
    return Tr.expand_plans(rotate_move(p), "out_and_back")


_EXPOSE = """x AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_idx, CAST(sum(l_quantity) AS BIGINT) AS exposure_s FROM lineitem GROUP BY 1, 2)"""


def exposures(spark, folder):
    return A.table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_idx")).agg(
        F.sum("l_quantity").cast(B).alias("exposure_s"))


@query("exposure_schedule", f"""WITH {_EXPOSE}, c AS (SELECT *, CAST(sum(exposure_s) OVER (PARTITION BY plan_id ORDER BY step_idx) AS BIGINT) AS e FROM x),
s AS (SELECT *, e - exposure_s AS b FROM c),
k AS (SELECT s.*, t.t AS cell FROM s, LATERAL (SELECT unnest(range(b//20+1, (e+19)//20+1)) AS t) t WHERE exposure_s > 0),
j AS (SELECT plan_id, step_idx, 0 AS a, 0 AS z, 'UPDATE_REFERENCE' AS task_type, CAST(NULL AS DOUBLE) AS exposure_s FROM s
 UNION ALL SELECT plan_id, step_idx, cell, 0, 'EXPOSURE', CAST(least(e, cell*20)-greatest(b, (cell-1)*20) AS DOUBLE) FROM k
 UNION ALL SELECT plan_id, step_idx, cell, 1, 'CORRECTION', NULL FROM k WHERE cell*20 <= e)
SELECT plan_id, CAST(step_idx AS BIGINT) AS step_idx, row_number() OVER (PARTITION BY plan_id, step_idx ORDER BY a, z) - 1 AS seq, task_type, exposure_s FROM j""")
def exposure_schedule(spark, folder):
    """Every order as a plan, its line quantities as exposures."""
    return Sch.expand_schedule(exposures(spark, folder), 20).withColumn("step_idx", F.col("step_idx").cast(B))


@query("filled_magnifications", """WITH d AS (SELECT o_orderkey AS plan_id, CAST(o_orderkey%4*1000 AS BIGINT) AS e, CAST(o_orderkey%3*500 AS BIGINT) AS c FROM orders),
x AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_idx, CASE WHEN l_linenumber%2=0 THEN CAST(l_linenumber*1000 AS BIGINT) END AS m, count(*) AS lines FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT plan_id, step_idx, lines, coalesce(m, e) AS exposure_mag, c AS correction_mag FROM x JOIN d USING (plan_id))
SELECT plan_id, CAST(step_idx AS BIGINT) AS step_idx, lines, exposure_mag, correction_mag, CAST(exposure_mag IN (SELECT n_nationkey*500 FROM nation) AND correction_mag IN (SELECT n_nationkey*500 FROM nation) AS BIGINT) AS known FROM f""")
def filled_magnifications(spark, folder):
    """Step overrides, plan defaults and a check against known settings."""
    k = F.col("o_orderkey")
    defaults = A.table(spark, folder, "orders").select(
        k.alias("plan_id"), (k % 4 * 1000).cast(B).alias("exposure_mag"), (k % 3 * 500).cast(B).alias("correction_mag"))
    line = F.col("l_linenumber")
    mags = A.table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("plan_id"), line.alias("step_idx"),
        F.when(line % 2 == 0, (line * 1000).cast(B)).alias("exposure_mag")).agg(F.count("*").alias("lines")).withColumn(
        "correction_mag", F.lit(None).cast(B))
    known = A.table(spark, folder, "nation").select((F.col("n_nationkey") * 500).cast(B).alias("mag"))
    out = Sch.fill_defaults(mags, defaults, known, strict=False)
    return out.select("plan_id", F.col("step_idx").cast(B).alias("step_idx"), "lines", "exposure_mag", "correction_mag",
                      F.col("known").cast(B).alias("known"))
