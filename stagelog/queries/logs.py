"""Queries over measurement-log views of ``events`` and small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stagelog import adapters as A
from stagelog.functions import rows as R, units as U
from stagelog.operators import features as Fe, quality as Q, scoring as Sc, segments as S
from stagelog.operators.cluster import agreement_cluster
from stagelog.queries import query
from stagelog.session import cut_lineage, shared_folder
from stagelog.sources import logs as L
from stagelog.sources.sinks import write_positions, write_steps
from stagelog.workflows import recalculate_and_segment

T = 0.3  # segmentation threshold that gives segments of mixed length
B, D = "bigint", "double"


def steps(spark, folder):
    return A.steps_from_events(A.table(spark, folder, "events"))


def positions(spark, folder):
    return A.positions_from_events(A.table(spark, folder, "events"))


def tasks(spark, folder):
    return A.tasks_from_events(A.table(spark, folder, "events"))


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"


@query("position_attachment", f"""WITH {A.STEPS_SQL}, {A.POSITIONS_SQL}
SELECT s.run_id, source_index, replace(s.img_path, 'temp\\', '') AS filename, p.x AS x, p.y AS y, p.confidence AS position_confidence
FROM steps s LEFT JOIN positions p ON s.run_id = p.run_id AND replace(s.img_path, 'temp\\', '') = p.filename""")
def position_attachment(spark, folder):
    out = Q.attach_positions(steps(spark, folder), positions(spark, folder))
    return out.select("run_id", "source_index", "filename", "position.x", "position.y", "position_confidence")


_RECALC_SQL = f"""WITH {A.STEPS_SQL}, {A.POSITIONS_SQL}, joined AS (
  SELECT s.*, p.x AS px, p.y AS py FROM steps s LEFT JOIN positions p
  ON s.run_id = p.run_id AND replace(s.img_path, 'temp\\', '') = p.filename),
ref AS (SELECT run_id, px AS rpx, py AS rpy, x_target_abs AS rx, y_target_abs AS ry FROM joined WHERE step = 0 AND px IS NOT NULL),
recalculated AS (SELECT j.run_id, source_index, step, x_target_abs, y_target_abs,
  coalesce(CAST(round_even(rx + CAST(-1 AS DOUBLE)*(px-rpx)*CAST(12.40234 AS DOUBLE), 0) AS BIGINT), x_actual_abs) AS x_actual_abs,
  coalesce(CAST(round_even(ry + CAST(1 AS DOUBLE)*(py-rpy)*CAST(12.40234 AS DOUBLE), 0) AS BIGINT), y_actual_abs) AS y_actual_abs,
  px IS NOT NULL AND rpx IS NOT NULL AS updated FROM joined j LEFT JOIN ref USING (run_id))"""


def _recalculated(spark, folder):
    return Q.recalculate_positions(steps(spark, folder), positions(spark, folder), missing_reference="keep")


@query("recalculated_positions", _RECALC_SQL + """
SELECT run_id, source_index, x_actual_abs, y_actual_abs, CAST(updated AS BIGINT) AS updated FROM recalculated""")
def recalculated_positions(spark, folder):
    return _recalculated(spark, folder).select(
        "run_id", "source_index", "x_actual_abs", "y_actual_abs", F.col("updated").cast(B).alias("updated"))


@query("update_counts", _RECALC_SQL + """
SELECT run_id, count(*) FILTER (updated) AS updated, count(*) FILTER (NOT updated) AS skipped FROM recalculated GROUP BY 1""")
def update_counts(spark, folder):
    return Q.update_counts(_recalculated(spark, folder))


def _agreement_sql(source: str) -> str:
    return f""", ref0 AS (SELECT run_id, x_target_abs AS rx, y_target_abs AS ry FROM {source} WHERE step = 0),
d AS (SELECT run_id, CASE WHEN step <> 0 THEN CAST(x_target_abs-rx AS DOUBLE) END AS tx, CASE WHEN step <> 0 THEN CAST(y_target_abs-ry AS DOUBLE) END AS ty,
  CASE WHEN step <> 0 THEN CAST(x_actual_abs-rx AS DOUBLE) END AS ax, CASE WHEN step <> 0 THEN CAST(y_actual_abs-ry AS DOUBLE) END AS ay FROM {source} LEFT JOIN ref0 USING (run_id)),
g AS (SELECT run_id, count(tx) AS n, count(*) FILTER (tx*ax > 0) AS x_agree, count(*) FILTER (ty*ay > 0) AS y_agree,
  coalesce(CASE WHEN stddev_pop(tx)*stddev_pop(ax) = 0 THEN 0 ELSE covar_pop(tx,ax)/(stddev_pop(tx)*stddev_pop(ax)) END, 0) AS x_r,
  coalesce(CASE WHEN stddev_pop(ty)*stddev_pop(ay) = 0 THEN 0 ELSE covar_pop(ty,ay)/(stddev_pop(ty)*stddev_pop(ay)) END, 0) AS y_r,
  avg(abs(tx-ax)) AS x_mae, avg(abs(ty-ay)) AS y_mae FROM d GROUP BY 1)
SELECT run_id, n, x_agree, y_agree, round(x_r,6) AS x_r, round(y_r,6) AS y_r, round(x_mae,6) AS x_mae, round(y_mae,6) AS y_mae,
  CASE WHEN n > 0 THEN round(CAST(100 AS DOUBLE)*x_agree/n,6) END AS x_agree_pct, CASE WHEN n > 0 THEN round(CAST(100 AS DOUBLE)*y_agree/n,6) END AS y_agree_pct,
  CASE WHEN n <= 1 THEN 'INSUFFICIENT' WHEN x_r < 0.3 OR y_r < 0.3 THEN 'LOW' WHEN x_r > 0.8 AND y_r > 0.8 THEN 'GOOD' ELSE 'MODERATE' END AS verdict
FROM g"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_AGREEMENT = ("x_r", "y_r", "x_mae", "y_mae", "x_agree_pct", "y_agree_pct")


@query("agreement_report", f"WITH {A.STEPS_SQL}" + _agreement_sql("steps"))
def agreement_report(spark, folder):
    return _rounded(Q.agreement_report(steps(spark, folder)), *_AGREEMENT)


@query("agreement_after_recalculation", _RECALC_SQL + _agreement_sql("recalculated"))
def agreement_after_recalculation(spark, folder):
    return _rounded(Q.agreement_report(_recalculated(spark, folder)), *_AGREEMENT)


def _segments_sql(min_length: int = 1) -> str:
    return f"""WITH {A.STEPS_SQL}, marked AS (
  SELECT *, position_confidence IS NULL OR position_confidence < {T} AS rejected,
    CAST(sum(CASE WHEN position_confidence IS NULL OR position_confidence < {T} THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id ORDER BY source_index) AS BIGINT) AS segment FROM steps),
whole AS (SELECT run_id, segment, count(*) AS records, min(source_index) AS first_index, max(source_index) AS last_index,
  min_by(step, source_index) AS first_step, max_by(step, source_index) AS last_step FROM marked WHERE NOT rejected GROUP BY 1, 2),
summary AS (SELECT *, CASE WHEN records >= {min_length} THEN CAST(sum(CASE WHEN records >= {min_length} THEN 1 ELSE 0 END)
  OVER (PARTITION BY run_id ORDER BY first_index) AS BIGINT) END AS part FROM whole)"""


@query("segmented_records", _segments_sql(2) + """
SELECT m.run_id, source_index, part, m.position_confidence FROM marked m JOIN summary s ON m.run_id = s.run_id AND m.segment = s.segment
WHERE NOT rejected AND part IS NOT NULL""")
def segmented_records(spark, folder):
    rows, _ = S.segment_runs(steps(spark, folder), min_confidence=T, min_length=2)
    return rows.select("run_id", "source_index", "part", "position_confidence")


@query("trusted_stretches", f"""WITH {A.STEPS_SQL}, {A.POSITIONS_SQL}, marked AS (
  SELECT s.run_id, source_index, step, p.confidence IS NULL OR p.confidence < {T} AS rejected,
    sum(CASE WHEN p.confidence IS NULL OR p.confidence < {T} THEN 1 ELSE 0 END) OVER (PARTITION BY s.run_id ORDER BY source_index) AS segment
  FROM steps s LEFT JOIN positions p ON s.run_id = p.run_id AND replace(s.img_path, 'temp\\', '') = p.filename),
whole AS (SELECT run_id, segment, count(*) AS records, min(source_index) AS first_index, min(step) AS first_step, max(step) AS last_step
  FROM marked WHERE NOT rejected GROUP BY 1, 2)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first_index) AS part, records, first_step, last_step FROM whole""")
def trusted_stretches(spark, folder):
    """C1 → E1 → D3: which contiguous stretches of each run can be trusted."""
    marked = S.mark_segments(steps(spark, folder), positions(spark, folder), T)
    return S.segment_summary(marked).select("run_id", "part", "records", "first_step", "last_step")


@query("segment_summary", _segments_sql(3) + """
SELECT run_id, records, first_index, last_index, first_step, last_step, part FROM summary""")
def segment_summary(spark, folder):
    return S.segment_summary(S.mark_segments(steps(spark, folder), min_confidence=T), 3).drop("segment")


@query("discard_reasons", _segments_sql() + """
SELECT run_id, CASE WHEN position_confidence IS NULL THEN 'missing-position' ELSE 'below-threshold' END AS reason, count(*) AS records
FROM marked WHERE rejected GROUP BY 1, 2""")
def discard_reasons(spark, folder):
    return S.discard_reasons(S.discarded_records(S.mark_segments(steps(spark, folder), min_confidence=T)))


_FILE_SQL = """run_id || '_part' || lpad(CAST(part AS VARCHAR), CAST(greatest(3, length(CAST(part AS VARCHAR))) AS INTEGER), '0') || '_steps'
  || lpad(CAST(first_step AS VARCHAR), CAST(greatest(4, length(CAST(first_step AS VARCHAR))) AS INTEGER), '0') || '-'
  || lpad(CAST(last_step AS VARCHAR), CAST(greatest(4, length(CAST(last_step AS VARCHAR))) AS INTEGER), '0')"""


@query("recalculated_segments", _RECALC_SQL + f""", marked AS (SELECT r.*, coalesce(p.confidence, 0) < {T} OR p.confidence IS NULL AS rejected,
  CAST(sum(CASE WHEN p.confidence IS NULL OR p.confidence < {T} THEN 1 ELSE 0 END) OVER (PARTITION BY r.run_id ORDER BY r.source_index) AS BIGINT) AS segment
  FROM recalculated r JOIN steps s ON s.run_id = r.run_id AND s.source_index = r.source_index
  LEFT JOIN positions p ON s.run_id = p.run_id AND replace(s.img_path, 'temp\\', '') = p.filename),
whole AS (SELECT run_id, min(source_index) AS first_index, count(*) AS records, count(*) FILTER (updated) AS updated, CAST(sum(x_actual_abs) AS BIGINT) AS x_sum,
  CAST(sum(y_actual_abs) AS BIGINT) AS y_sum FROM marked WHERE NOT rejected GROUP BY run_id, segment HAVING count(*) >= 2)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first_index) AS part, records, updated, x_sum, y_sum FROM whole""")
def recalculated_segments(spark, folder):
    """Recalculation, then segments by the confidence of the measured positions."""
    found = recalculate_and_segment(steps(spark, folder), positions(spark, folder), min_confidence=T, min_length=2)
    return found.rows.groupBy("run_id", "part").agg(
        F.count("*").alias("records"), F.count_if("updated").alias("updated"), F.sum("x_actual_abs").alias("x_sum"), F.sum("y_actual_abs").alias("y_sum"))


@query("segment_plan", _segments_sql() + f"""
SELECT run_id, part, {_FILE_SQL} AS segment_file, records, first_step, last_step FROM summary WHERE part IS NOT NULL""")
def segment_plan(spark, folder):
    return S.plan_segments(S.segment_summary(S.mark_segments(steps(spark, folder), min_confidence=T)))


@query("manifest_counts", _segments_sql(2) + f""", {A.POSITIONS_SQL},
c AS (SELECT run_id, count(*) AS input_records, count(*) FILTER (rejected) AS discarded_count FROM marked GROUP BY 1),
k AS (SELECT run_id, count(*) FILTER (part IS NOT NULL) AS segment_count, count(*) FILTER (part IS NULL) AS omitted_count,
  CAST(sum(CASE WHEN part IS NOT NULL THEN records ELSE 0 END) AS BIGINT) AS written_records FROM summary GROUP BY 1),
e AS (SELECT run_id, count(DISTINCT filename) AS position_entries FROM positions GROUP BY 1)
SELECT run_id, input_records, discarded_count, coalesce(segment_count, 0) AS segment_count, coalesce(omitted_count, 0) AS omitted_count,
  coalesce(written_records, 0) AS written_records, coalesce(position_entries, 0) AS position_entries, 'jsonl' AS source_format,
  CAST({T} AS DOUBLE) AS min_confidence, 'position_confidence' AS confidence_field, CAST(2 AS BIGINT) AS min_segment_length
FROM c LEFT JOIN k USING (run_id) LEFT JOIN e USING (run_id)""")
def manifest_counts(spark, folder):
    marked = S.mark_segments(steps(spark, folder), min_confidence=T)
    return S.build_manifest(marked, S.segment_summary(marked, 2), T, 2, position_entries=positions(spark, folder))


@query("manifest_entries", _segments_sql(2) + f"""
SELECT run_id, 'discarded_records' AS section, source_index AS ordinal, step AS a, source_index AS b, CAST(NULL AS VARCHAR) AS file FROM marked WHERE rejected
UNION ALL SELECT run_id, 'omitted_short_segments', first_index, first_step, last_step, NULL FROM summary WHERE part IS NULL
UNION ALL SELECT run_id, 'segments', part, first_step, last_step, {_FILE_SQL} || '.jsonl' FROM summary WHERE part IS NOT NULL""")
def manifest_entries(spark, folder):
    marked = S.mark_segments(steps(spark, folder), min_confidence=T)
    rows = S.manifest_entries(S.discarded_records(marked), S.segment_summary(marked, 2))
    kind = "step bigint, source_index bigint, first_step bigint, last_step bigint, file string"
    e = F.from_json("entry", kind)
    return rows.select("run_id", "section", "ordinal", F.coalesce(e["step"], e["first_step"]).alias("a"),
                       F.coalesce(e["source_index"], e["last_step"]).alias("b"), e["file"].alias("file"))


@query("written_segments", _segments_sql(2) + f""", files AS (SELECT run_id, segment, {_FILE_SQL} AS segment_file FROM summary WHERE part IS NOT NULL)
SELECT m.run_id, f.segment_file, count(*) AS records, CAST(sum(m.x_target_abs) AS BIGINT) AS x_sum, min(m.step) AS first_step, max(m.step) AS last_step
FROM marked m JOIN files f ON m.run_id = f.run_id AND m.segment = f.segment WHERE NOT rejected GROUP BY 1, 2""")
def written_segments(spark, folder):
    """Write all segments, then read the written lines back."""
    log = cut_lineage(steps(spark, folder))
    plan = S.plan_segments(S.segment_summary(cut_lineage(S.mark_segments(log, min_confidence=T)), 2))
    rows, _ = S.segment_runs(log, min_confidence=T, min_length=2)
    out = _new_folder(spark)
    S.write_segments(rows, plan, out)
    return L.read_segment_lines(spark, out, "step bigint, x_target_abs bigint").groupBy("run_id", "segment_file").agg(
        F.count("*").alias("records"), F.sum("x_target_abs").alias("x_sum"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("log_replayed_from_lines", f"""WITH {A.STEPS_SQL}
SELECT run_id, step AS source_index, step, x_target_abs, y_target_abs, x_actual_abs, y_actual_abs, confidence,
  'img_' || CAST(source_index AS VARCHAR) || '.bmp' AS filename FROM steps""")
def log_replayed_from_lines(spark, folder):
    """A1, B1, B2: the log written as JSON lines and read through the log reader."""
    out = _new_folder(spark)
    written = steps(spark, folder).withColumn("confidence_text", F.format_string("%.4f", "confidence"))
    write_steps(written, out)
    rows = L.read_steps(spark, out + "/*/*.json", layout="jsonl", run_from="folder")
    return rows.select("run_id", "source_index", "step", "x_target_abs", "y_target_abs", "x_actual_abs",
                       "y_actual_abs", "confidence", "filename")


@query("position_map_read", f"WITH {A.POSITIONS_SQL} SELECT run_id, filename, x, y, w, h, confidence FROM positions".replace(
    "w, h,", "CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h,"))
def position_map_read(spark, folder):
    """A3: position maps written as one JSON object per run and read back."""
    out = _new_folder(spark)
    write_positions(positions(spark, folder), out)
    return L.read_positions(spark, out + "/*/*.txt", run_from="folder").drop("entry")


@query("sampled_steps", f"""WITH {A.STEPS_SQL} SELECT run_id, step FROM steps WHERE step % 3 = 0 AND step < 30""")
def sampled_steps(spark, folder):
    """Every third record of each run, then the first ten."""
    log = steps(spark, folder).select("run_id", F.col("step").alias("source_index"))
    return Q.sample_steps(log, 3, 10).select("run_id", F.col("source_index").alias("step"))


@query("position_errors", f"""WITH {A.STEPS_SQL} SELECT run_id, source_index, x_target_abs-x_actual_abs AS x_error,
  y_target_abs-y_actual_abs AS y_error, round(sqrt(CAST((x_target_abs-x_actual_abs)*(x_target_abs-x_actual_abs) AS DOUBLE)
  + CAST((y_target_abs-y_actual_abs)*(y_target_abs-y_actual_abs) AS DOUBLE)), 6) AS error_nm FROM steps""")
def position_errors(spark, folder):
    return _rounded(R.position_error(steps(spark, folder)).select(
        "run_id", "source_index", "x_error", "y_error", "error_nm"), "error_nm")


@query("error_percentiles", f"""WITH {A.STEPS_SQL}, e AS (SELECT run_id, sqrt(CAST((x_target_abs-x_actual_abs)*(x_target_abs-x_actual_abs) AS DOUBLE)
  + CAST((y_target_abs-y_actual_abs)*(y_target_abs-y_actual_abs) AS DOUBLE)) AS e FROM steps)
SELECT run_id, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90 FROM e GROUP BY 1""")
def error_percentiles(spark, folder):
    """Exact percentiles of the position error."""
    return _rounded(Q.residual_summary(R.position_error(steps(spark, folder)), "error_nm"), "median", "p90")


@query("quality_flags", f"""WITH {A.STEPS_SQL} SELECT run_id, source_index, CASE WHEN confidence >= 0.8 THEN 'OK' ELSE 'LOW' END AS status,
  round(confidence, 4) AS confidence, CAST(confidence < 0.2 AS BIGINT) AS low_confidence, CAST(confidence < 0.5 AS BIGINT) AS bad_measurement FROM steps""")
def quality_flags(spark, folder):
    out = R.match_status(R.flag_quality(steps(spark, folder), min_conf=0.5))
    return out.select("run_id", "source_index", "status", "confidence", F.col("low_confidence").cast(B).alias("low_confidence"),
                      F.col("bad_measurement").cast(B).alias("bad_measurement"))


@query("confidence_profile", f"""WITH {A.STEPS_SQL} SELECT run_id, CAST(floor(position_confidence*10) AS BIGINT) + 1 AS bin, count(*) AS records,
  count(*) FILTER (position_confidence < 0.8) AS below FROM steps WHERE position_confidence IS NOT NULL GROUP BY 1, 2""")
def confidence_profile(spark, folder):
    return Q.confidence_profile(steps(spark, folder))


@query("approach_directions", f"""WITH {A.STEPS_SQL} SELECT run_id, source_index,
  CAST(coalesce(sign(x_target_abs - lag(x_target_abs) OVER w), 0) AS BIGINT) AS dir_x,
  CAST(coalesce(sign(y_target_abs - lag(y_target_abs) OVER w), 0) AS BIGINT) AS dir_y
FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY source_index)""")
def approach_directions(spark, folder):
    return Fe.approach_direction(steps(spark, folder)).select(
        "run_id", "source_index", F.col("dir_x").cast(B).alias("dir_x"), F.col("dir_y").cast(B).alias("dir_y"))


def _windows_sql(source: str, keys: str, pos: str, w: int, lag: int) -> str:
    on = " AND ".join(f"e.{k} = a.{k}" for k in keys.split(", "))
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    on0 = on.replace("e.", "f.")
    onm = on.replace("e.", "m.")
    return f"""SELECT {ka}, a.source_index, e.{pos} - a.{pos} + {w - 1} AS k,
  CAST(e.x_target_abs - f.x_target_abs AS DOUBLE) AS tx, CAST(e.y_target_abs - f.y_target_abs AS DOUBLE) AS ty,
  CAST(m.x_actual_abs - f.x_target_abs AS DOUBLE) AS ax, CAST(m.y_actual_abs - f.y_target_abs AS DOUBLE) AS ay
FROM {source} a JOIN {source} e ON {on} AND e.{pos} BETWEEN a.{pos} - {w - 1} AND a.{pos}
JOIN {source} f ON {on0} AND f.{pos} = a.{pos} - {w - 1} JOIN {source} m ON {onm} AND m.{pos} = e.{pos} - {lag}
WHERE a.{pos} >= {w - 1 + lag}"""


def _flat_windows(df, *keys):
    return df.select(*keys, "source_index", F.posexplode("window").alias("k", "e")).select(
        *keys, "source_index", F.col("k").cast(B).alias("k"), "e.*")


@query("model_windows", f"WITH {A.STEPS_SQL} " + _windows_sql("steps", "run_id", "step", 5, 1))
def model_windows(spark, folder):
    return _flat_windows(Fe.model_windows(steps(spark, folder), 5), "run_id")


@query("model_windows_same_step", f"WITH {A.STEPS_SQL} " + _windows_sql("steps", "run_id", "step", 4, 0))
def model_windows_same_step(spark, folder):
    return _flat_windows(Fe.model_windows(steps(spark, folder), 4, actual_lag=0), "run_id")


@query("segment_windows", _segments_sql(1) + """, rows0 AS (SELECT m.*, s.part, row_number() OVER (PARTITION BY m.run_id, s.part ORDER BY source_index) - 1 AS pos
FROM marked m JOIN summary s ON m.run_id = s.run_id AND m.segment = s.segment WHERE NOT rejected) """
       + _windows_sql("rows0", "run_id, part", "pos", 3, 1))
def segment_windows(spark, folder):
    """Windows that never cross a segment."""
    rows, _ = S.segment_runs(steps(spark, folder), min_confidence=T)
    return _flat_windows(Fe.model_windows(rows, 3, by=("run_id", "part")), "run_id", "part")


@query("accumulated_drift", f"""WITH {A.TASKS_SQL}, m AS (SELECT 'accumulate' AS mode UNION ALL SELECT 'accumulate_gated' UNION ALL SELECT 'replace'),
g AS (SELECT t.*, mode, task_type = 'CORRECTION' AND (mode = 'accumulate' OR confidence >= 0.5) AS hit FROM tasks t CROSS JOIN m),
d AS (SELECT *, CASE WHEN mode = 'replace' THEN coalesce(-last_value(CASE WHEN hit THEN dx END IGNORE NULLS) OVER w, 0)
    ELSE coalesce(sum(CASE WHEN hit THEN dx ELSE 0 END) OVER w, 0) END AS drift_x,
  CASE WHEN mode = 'replace' THEN coalesce(-last_value(CASE WHEN hit THEN dy END IGNORE NULLS) OVER w, 0)
    ELSE coalesce(sum(CASE WHEN hit THEN dy ELSE 0 END) OVER w, 0) END AS drift_y FROM g
  WINDOW w AS (PARTITION BY mode, run_id ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT mode, run_id, source_index, CAST(drift_x AS BIGINT) AS drift_x, CAST(drift_y AS BIGINT) AS drift_y,
  CAST(x_target + drift_x AS BIGINT) AS x_drifted, CAST(y_target + drift_y AS BIGINT) AS y_drifted FROM d""")
def accumulated_drift(spark, folder):
    log, out = tasks(spark, folder), None
    for mode in ("accumulate", "accumulate_gated", "replace"):
        one = Fe.accumulate_drift(log, mode, 0.5).select(
            F.lit(mode).alias("mode"), "run_id", "source_index", "drift_x", "drift_y", "x_drifted", "y_drifted")
        out = one if out is None else out.unionByName(one)
    return out


@query("running_reference", f"""WITH {A.TASKS_SQL}, s AS (SELECT run_id, source_index,
  sum(CASE WHEN task_type = 'UPDATE_REFERENCE' THEN dx ELSE 0 END) OVER w AS sx, sum(CASE WHEN task_type = 'UPDATE_REFERENCE' THEN dy ELSE 0 END) OVER w AS sy
  FROM tasks WINDOW w AS (PARTITION BY run_id ORDER BY source_index))
SELECT run_id, source_index, CAST(1000 - sx AS BIGINT) AS ref_x, CAST(-500 - sy AS BIGINT) AS ref_y FROM s""")
def running_reference(spark, folder):
    return Fe.running_reference(tasks(spark, folder), F.lit(1000).cast(B), F.lit(-500).cast(B)).select(
        "run_id", "source_index", "ref_x", "ref_y")


@query("reference_pairs", f"""WITH {A.TASKS_SQL}, f AS (SELECT run_id, min(source_index) AS ref_index FROM tasks GROUP BY 1),
u AS (SELECT run_id, source_index, max(CASE WHEN task_type = 'UPDATE_REFERENCE' THEN source_index END)
  OVER (PARTITION BY run_id ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref_index FROM tasks)
SELECT 'first' AS policy, t.run_id, source_index, ref_index, 'temp/img_' || CAST(ref_index AS VARCHAR) || '.bmp' AS ref_img_path
FROM tasks t JOIN f USING (run_id) WHERE ref_index < source_index
UNION ALL SELECT 'latest_update', run_id, source_index, ref_index, 'temp/img_' || CAST(ref_index AS VARCHAR) || '.bmp' FROM u WHERE ref_index IS NOT NULL""")
def reference_pairs(spark, folder):
    """C9 under both policies."""
    log, out = tasks(spark, folder), None
    for policy in ("first", "latest_update"):
        one = Fe.pair_with_reference(log, policy, by=("run_id",)).select(
            F.lit(policy).alias("policy"), "run_id", "source_index", "ref_index", "ref_img_path")
        out = one if out is None else out.unionByName(one)
    return out


@query("cadence", f"""WITH {A.STEPS_SQL}, g AS (SELECT run_id, source_index,
  (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY run_id ORDER BY source_index)) / CAST(1000000 AS DOUBLE) AS gap FROM steps)
SELECT run_id, source_index, round(gap, 6) AS gap_s, CAST(coalesce(gap > 20000, false) AS BIGINT) AS slow FROM g""")
def cadence(spark, folder):
    out = Q.cadence(steps(spark, folder), 20000.0)
    return out.select("run_id", "source_index", F.round("gap_s", 6).alias("gap_s"), F.col("slow").cast(B).alias("slow"))


_IMAGES = "event_id % 7 <> 0"


@query("commanded_layout", f"""WITH {A.STEPS_SQL}, a AS (SELECT run_id, min_by(x_target_abs, source_index) AS ax, min_by(y_target_abs, source_index) AS ay FROM steps GROUP BY 1)
SELECT run_id, source_index, row_number() OVER (PARTITION BY run_id ORDER BY source_index) - 1 AS tile_id,
  round(-CAST(x_target_abs-ax AS DOUBLE)/CAST(12.40234 AS DOUBLE), 6) AS x_px, round(CAST(y_target_abs-ay AS DOUBLE)/CAST(12.40234 AS DOUBLE), 6) AS y_px
FROM steps JOIN a USING (run_id) WHERE source_index % 7 <> 0""")
def commanded_layout(spark, folder):
    """Layout from the first record even where its image is missing."""
    images = A.table(spark, folder, "events").where(_IMAGES).select(
        F.col("user_id").cast("string").alias("run_id"), F.format_string("img_%d.bmp", "event_id").alias("filename"))
    out = Q.layout_px(steps(spark, folder), images)
    return out.select("run_id", "source_index", "tile_id", (F.round("x_px", 6) + 0.0).alias("x_px"), F.round("y_px", 6).alias("y_px"))


@query("records_by_image", f"""WITH {A.STEPS_SQL} SELECT run_id, source_index, CAST(source_index % 7 <> 0 AS BIGINT) AS present FROM steps""")
def records_by_image(spark, folder):
    images = A.table(spark, folder, "events").where(_IMAGES).select(
        F.col("user_id").cast("string").alias("run_id"), F.format_string("img_%d.bmp", "event_id").alias("filename"))
    have, lack = Q.split_by_image(steps(spark, folder), images)
    cols = ["run_id", "source_index"]
    return have.select(*cols, F.lit(1).cast(B).alias("present")).unionByName(lack.select(*cols, F.lit(0).cast(B).alias("present")))


@query("backlash_summary", """WITH b AS (SELECT CAST(event_id%4*45 AS DOUBLE) AS r_target, (event_id%3-1)*1500000 AS x_target, (event_id%5-2)*1500000 AS y_target,
  event_id*31%401-200 AS dx, event_id*57%301-150 AS dy FROM events)
SELECT r_target, x_target, y_target, count(*) AS tasks, round(avg(dx), 6) AS dx_mean, round(avg(dy), 6) AS dy_mean,
  round(avg(sqrt(CAST(dx*dx AS DOUBLE)+CAST(dy*dy AS DOUBLE))), 6) AS residual_mean, round(max(sqrt(CAST(dx*dx AS DOUBLE)+CAST(dy*dy AS DOUBLE))), 6) AS residual_max
FROM b GROUP BY 1, 2, 3""")
def backlash_summary(spark, folder):
    """A4 + D12: backlash lines written, read and summarised."""
    e = F.col("event_id")
    out = _new_folder(spark)
    A.table(spark, folder, "events").select(
        e.cast("int").alias("task"), ((e % 3 - 1) * 1500000).alias("x_target"), ((e % 5 - 2) * 1500000).alias("y_target"),
        (e % 4 * 45).cast(D).alias("r_target"), (e * 31 % 401 - 200).alias("dx_measured"),
        (e * 57 % 301 - 150).alias("dy_measured"), F.lit("0.9000").alias("conf")).write.json(out)
    return _rounded(Q.backlash_summary(L.read_backlash(spark, out + "/*.json")), "dx_mean", "dy_mean", "residual_mean", "residual_max")


@query("image_metadata", """SELECT CAST(p_partkey AS VARCHAR) AS path, p_retailprice AS pixel_size, CAST(p_size*16 AS BIGINT) AS width, CAST(p_size*12 AS BIGINT) AS height FROM part""")
def image_metadata(spark, folder):
    """A5: sidecar texts made from parts, parsed back."""
    size = F.col("p_size")
    text = F.concat(F.lit("[Other]\r\nPixelSize=1\r\n[SemImageFile]\r\nPixelSize="), F.col("p_retailprice").cast("string"),
                    F.lit("\r\nDataSize="), (size * 16).cast("string"), F.lit("x"), (size * 12).cast("string"), F.lit("\r\n"))
    out = L.image_meta(A.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))
    return out.withColumns({"width": F.col("width").cast(B), "height": F.col("height").cast(B)})


@query("image_shapes", """WITH n AS (SELECT p_brand AS run_id, CAST(p_size*16 AS BIGINT) AS w, CAST(p_size*12 AS BIGINT) AS h, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, w, h) AS place FROM n)
SELECT run_id, CAST(sum(n) AS BIGINT) AS images, count(*) AS shapes, max(w) FILTER (place = 1) AS width, max(h) FILTER (place = 1) AS height,
  CAST(coalesce(sum(n) FILTER (place > 1), 0) AS BIGINT) AS others, CAST(count(*) = 1 AS BIGINT) AS uniform FROM r GROUP BY 1""")
def image_shapes(spark, folder):
    """Image shapes of each run, the commonest one and how many differ from it."""
    images = A.table(spark, folder, "part").select(
        F.col("p_brand").alias("run_id"), (F.col("p_size") * 16).cast(B).alias("w"), (F.col("p_size") * 12).cast(B).alias("h"))
    return Q.shape_report(images).withColumn("uniform", F.col("uniform").cast(B))


@query("file_labels", r"""WITH n AS (SELECT page_id, regexp_extract(url, '[^/\\]*$', 0) AS filename FROM pages)
SELECT page_id, filename, CASE WHEN regexp_full_match(filename, '\d+') THEN lpad(filename, CAST(greatest(4, length(filename)) AS INTEGER), '0')
    ELSE regexp_replace(filename, '[^A-Za-z0-9_.-]+', '_', 'g') END AS label,
  lpad(CAST(page_id AS VARCHAR), CAST(greatest(4, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') AS number_label FROM n""")
def file_labels(spark, folder):
    name = U.filename(F.col("url"))
    return A.table(spark, folder, "pages").select(
        "page_id", name.alias("filename"), U.safe_label(name).alias("label"), U.safe_label(F.col("page_id")).alias("number_label"))


@query("unit_strings", """SELECT p_partkey, CAST(p_size AS BIGINT) AS nm, CAST(p_size AS BIGINT)*1000 AS um, CAST(p_size AS BIGINT)*500000 AS mm,
  CAST(p_size AS DOUBLE) AS deg, round(degrees(CAST(p_size AS DOUBLE)/CAST(10 AS DOUBLE)), 6) AS rad FROM part""")
def unit_strings(spark, folder):
    size = F.col("p_size")
    text = size.cast("string")

    def with_unit(value, unit):
        return F.concat(value.cast("string"), F.lit(unit))

    return A.table(spark, folder, "part").select(
        "p_partkey", U.to_nm(with_unit(text, "nm")).alias("nm"), U.to_nm(with_unit(text, " um")).alias("um"),
        U.to_nm(with_unit(size.cast(D) / 2, "mm")).alias("mm"), U.to_degrees(with_unit(text, "deg")).alias("deg"),
        F.round(U.to_degrees(with_unit(size.cast(D) / 10, " rad")), 6).alias("rad"))


@query("drift_lengths", """SELECT event_id, CAST(round((event_id*31%401-200) * CAST(12.5 AS DOUBLE)) AS BIGINT) AS dx_nm, CAST(round((event_id*57%301-150)*CAST(12.40234 AS DOUBLE)) AS BIGINT) AS dy_nm FROM events""")
def drift_lengths(spark, folder):
    """Pixel drift to nanometres, halves away from zero."""
    e = F.col("event_id")
    return A.table(spark, folder, "events").select(
        "event_id", U.px_to_nm(e * 31 % 401 - 200, 12.5).alias("dx_nm"), U.px_to_nm(e * 57 % 301 - 150).alias("dy_nm"))


@query("rotated_moves", """SELECT p_partkey, CAST(trunc(p_size*100*cos(radians(CAST(p_partkey%8*45+10 AS DOUBLE)))) AS BIGINT) AS x_move,
  CAST(trunc(p_size*100*sin(radians(CAST(p_partkey%8*45+10 AS DOUBLE)))) AS BIGINT) AS y_move FROM part""")
def rotated_moves(spark, folder):
    plan = A.table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 100).alias("move"),
                                                 (F.col("p_partkey") % 8 * 45 + 10).cast(D).alias("r_target"))
    return U.rotate_move(plan).select("p_partkey", "x_move", "y_move")


@query("fields_of_view", """WITH e AS (SELECT p_partkey AS k, p_size*16 AS w, p_size*12 AS h, CAST(2.5 AS DOUBLE) AS s FROM part),
c AS (SELECT p_partkey AS k, 640 AS w, 480 AS h, CAST(5.25 AS DOUBLE) AS s FROM part),
r AS (SELECT k, round(e.w*e.s)/round(c.w*c.s) AS rx, round(e.h*e.s)/round(c.h*c.s) AS ry, c.w AS cw, c.h AS ch FROM e JOIN c USING (k))
SELECT k, round(rx, 6) AS ratio_x, round(ry, 6) AS ratio_y, round(sqrt((rx*cw/2)*(rx*cw/2)+(ry*ch/2)*(ry*ch/2)), 6) AS radius_px FROM r""")
def fields_of_view(spark, folder):
    part = A.table(spark, folder, "part").withColumnRenamed("p_partkey", "k")
    exposure = part.select("k", (F.col("p_size") * 16).alias("width"), (F.col("p_size") * 12).alias("height"), F.lit(2.5).alias("pixel_size"))
    correction = part.select("k", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(5.25).alias("pixel_size"))
    return _rounded(U.field_of_view(exposure, correction, ["k"]).select("k", "ratio_x", "ratio_y", "radius_px"), "ratio_x", "ratio_y", "radius_px")


_PLACE_SQL = f"""WITH {A.POSITIONS_SQL}, q AS (SELECT run_id, filename, x - 500 AS x, y - 300 AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, confidence FROM positions)"""


def _shifted(spark, folder):
    return positions(spark, folder).withColumns({"x": F.col("x") - 500, "y": F.col("y") - 300})


@query("clipped_placements", _PLACE_SQL + """, r AS (SELECT *, greatest(0, x) AS dst_x1, greatest(0, y) AS dst_y1, least(3000, x+w) AS dst_x2, least(2000, y+h) AS dst_y2 FROM q WHERE confidence >= 0.2)
SELECT run_id, filename, dst_x1, dst_y1, dst_x2, dst_y2, dst_x1-x AS src_x1, dst_y1-y AS src_y1, dst_x2-x AS src_x2, dst_y2-y AS src_y2
FROM r WHERE dst_x1 < dst_x2 AND dst_y1 < dst_y2""")
def clipped_placements(spark, folder):
    return R.clip_placement(_shifted(spark, folder), 3000, 2000, 0.2).drop("entry", "x", "y", "w", "h", "confidence")


@query("numbered_placements", _PLACE_SQL + """, n AS (SELECT run_id, filename, confidence, row_number() OVER (PARTITION BY run_id ORDER BY filename) AS ordinal FROM q)
SELECT run_id, filename, ordinal, CASE WHEN confidence >= 0.8 THEN 'OK' ELSE 'LOW' END AS status,
  format('{:04d}_{}_{:.4f}_{}', ordinal, CASE WHEN confidence >= 0.8 THEN 'OK' ELSE 'LOW' END, confidence, replace(filename, '.bmp', '')) AS output_name FROM n""")
def numbered_placements(spark, folder):
    return Q.number_placements(_shifted(spark, folder)).select("run_id", "filename", "ordinal", "status", "output_name")


@query("agreement_clusters", """WITH p AS (SELECT user_id AS g, event_id AS o, CAST(event_id*31%97 AS DOUBLE)/CAST(10 AS DOUBLE) AS x, CAST(event_id*57%89 AS DOUBLE)/CAST(10 AS DOUBLE) AS y,
  CAST(event_id%7+1 AS DOUBLE) AS q FROM events),
s AS (SELECT a.g, a.o, a.x AS sx, a.y AS sy, count(*) AS support, round(sum(b.q), 9) AS quality FROM p a JOIN p b ON a.g = b.g AND sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) <= 1.5 GROUP BY 1, 2, 3, 4),
w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY support DESC, quality DESC, o) AS rn FROM s)
SELECT w.g, round(sum(p.x*p.q)/sum(p.q), 8) AS x, round(sum(p.y*p.q)/sum(p.q), 8) AS y, count(*) AS support, round(sum(p.q), 6) AS quality
FROM w JOIN p ON w.g = p.g AND sqrt((p.x-w.sx)*(p.x-w.sx)+(p.y-w.sy)*(p.y-w.sy)) <= 1.5 WHERE rn = 1 AND w.support >= 3 GROUP BY 1""")
def agreement_clusters(spark, folder):
    """D10 over the points of every user."""
    e = F.col("event_id")
    pts = A.table(spark, folder, "events").select(
        F.col("user_id").alias("g"), e.alias("o"), ((e * 31 % 97).cast(D) / 10.0).alias("x"), ((e * 57 % 89).cast(D) / 10.0).alias("y"),
        (e % 7 + 1).cast(D).alias("q"))
    out = agreement_cluster(pts, ["g"], "x", "y", "q", "q", 1.5, 3, "o")
    return out.withColumns({"x": F.round("x", 8), "y": F.round("y", 8), "quality": F.round("quality", 6)})




def play_model(tensor):
    """A linear stand-in for a trained model: three quarters command, one quarter last position."""
    return 0.75 * tensor[:, -1, :2] + 0.25 * tensor[:, -1, 2:]


@query("scored_windows", f"""WITH {A.STEPS_SQL} SELECT a.run_id, a.source_index, CAST(0.75 AS DOUBLE)*a.x_target_abs + CAST(0.25 AS DOUBLE)*b.x_actual_abs AS x_predicted,
  CAST(0.75 AS DOUBLE)*a.y_target_abs + CAST(0.25 AS DOUBLE)*b.y_actual_abs AS y_predicted FROM steps a JOIN steps b ON a.run_id = b.run_id AND b.step = a.step - 1 WHERE a.step >= 5""")
def scored_windows(spark, folder):
    """J1 with the linear stand-in model."""
    return Sc.score_windows(Fe.model_windows(steps(spark, folder), 5), play_model).select(
        "run_id", "source_index", "x_predicted", "y_predicted")


_BEST_SQL = f"""WITH {A.STEPS_SQL}, t AS (SELECT a.run_id, a.source_index, a.x_target_abs AS tx, a.y_target_abs AS ty, b.x_actual_abs AS ax, b.y_actual_abs AS ay
  FROM steps a JOIN steps b ON a.run_id = b.run_id AND b.step = a.step - 1 WHERE a.step >= 3),
c AS (SELECT i*20+j AS ord, (i-10)*100 AS ox, (j-10)*100 AS oy FROM range(20) r(i), range(20) s(j)),
e AS (SELECT run_id, source_index, tx + ox AS cx, ty + oy AS cy, tx, ty, ord, CAST(0.75 AS DOUBLE)*(tx+ox)+CAST(0.25 AS DOUBLE)*ax-tx AS ex,
  CAST(0.75 AS DOUBLE)*(ty+oy)+CAST(0.25 AS DOUBLE)*ay-ty AS ey FROM t CROSS JOIN c),
b AS (SELECT *, sqrt(ex*ex+ey*ey) AS err, row_number() OVER (PARTITION BY run_id, source_index ORDER BY ex*ex+ey*ey, ord) AS rn FROM e)"""


@query("best_commands", _BEST_SQL + " SELECT run_id, source_index, cx AS x_command, cy AS y_command, CAST(trunc(err) AS BIGINT) AS error_nm FROM b WHERE rn = 1")
def best_commands(spark, folder):
    """J2 with the predictor called in batches inside the task."""
    windows = Sc.command_windows(steps(spark, folder), 3).select(
        "run_id", "source_index", "ref_x", "ref_y", "x_target", "y_target", "window")
    return Sc.best_command(windows, play_model, lo=-10, hi=10).select("run_id", "source_index", "x_command", "y_command", "error_nm")


@query("gated_commands", _BEST_SQL + """ SELECT run_id, source_index, CAST(trunc(err) AS BIGINT) <= 20 AS ok0,
  CASE WHEN CAST(trunc(err) AS BIGINT) > 20 THEN tx ELSE cx END AS x_command, CASE WHEN CAST(trunc(err) AS BIGINT) > 20 THEN ty ELSE cy END AS y_command,
  CAST(CAST(trunc(err) AS BIGINT) <= 20 AS BIGINT) AS compensated FROM b WHERE rn = 1""".replace("CAST(trunc(err) AS BIGINT) <= 20 AS ok0,\n  ", ""))
def gated_commands(spark, folder):
    """C8, I13, J2 with the predictor as columns, then the J3 gate."""
    log = steps(spark, folder)
    last = F.element_at("window", -1)
    t = Sc.command_windows(log, 3).select(
        "run_id", "source_index", "x_target", "y_target", (last["ax"] + F.col("ref_x")).alias("ax"), (last["ay"] + F.col("ref_y")).alias("ay"))
    best = Sc.best_command_expr(t, ["run_id", "source_index"], 0.75 * F.col("x_command") + 0.25 * F.col("ax"),
                                0.75 * F.col("y_command") + 0.25 * F.col("ay"), lo=-10, hi=10)
    return R.gate_command(best, 20).select("run_id", "source_index", "x_command", "y_command", F.col("compensated").cast(B).alias("compensated"))
