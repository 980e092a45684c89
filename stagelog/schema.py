"""Table schemas, fixed parameter values and the one place for coordinate signs.

Lengths are integer nanometres, image positions are pixels (x right, y down).
Every table carries ``run_id``; the ordered tables carry ``source_index``, the
0-based position of the record in its source, unique within the run.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults every operator shares (units in the name or comment).
NM_PER_PX = 12.40234
MIN_OVERLAP_PX = 128
NEIGHBOURS = 4
NEIGHBOURS_SAME_DIRECTION = 6
NEIGHBOURS_RECENT = 2
RECENT_WINDOW = 30
CLOSURE_PX = 1.5
MIN_CYCLE_SUPPORT = 3
MAX_SEEDS = 80
AGREE_PX = 1.5
MAX_CORRECTION_NM = 6000.0
MIN_NEIGHBOURS = 3
MAX_RESIDUAL_PX = 1.5
POSE_PRIOR = 0.02
POSE_ANCHOR = 2.0
HUBER_PX = 6.0
IRLS_ROUNDS = 5
CG_ITERATIONS = 600
CG_TOLERANCE = 1e-7
CANVAS_MARGIN_PX = 32
FEATHER_PX = 64
CROP_PADDING_PX = 10
CROP_BOTTOM_PX = 60
MATCH_THRESHOLD = 0.8
LOW_CONFIDENCE = 0.2
IMAGE_EXTENSIONS = ("png", "tif", "tiff", "bmp", "jpg", "jpeg", "raw")


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_L, _D, _I, _S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()

# One record as written by the logger; `step` may hold a word in the last row.
RAW_STEP = _s(
    ("timestamp", _D), ("experiment_name", _S), ("iteration", _I), ("step", _S),
    ("x_target_abs", _L), ("y_target_abs", _L), ("x_actual_abs", _L), ("y_actual_abs", _L),
    ("confidence", _S), ("img_path", _S), ("position_confidence", _D),
)

POSITION_VALUE = _s(("x", _L), ("y", _L), ("w", _L), ("h", _L), ("confidence", _D))

BACKLASH_FLAT = _s(
    ("task", _I), ("x_target", _L), ("y_target", _L), ("r_target", _D), ("move", _L),
    ("dx_measured", _L), ("dy_measured", _L), ("conf", _S), ("img_path", _S), ("meta_path", _S),
)

BACKLASH_STEP = _s(
    ("step", _S), ("r_target", _D), ("x_target", _L), ("y_target", _L), ("x_move", _L),
    ("y_move", _L), ("dx_measured", _L), ("dy_measured", _L), ("conf", _S),
    ("img_path", _S), ("meta_path", _S),
)

BACKLASH_NESTED = _s(
    ("task_id", _I), ("total_tasks", _I), ("x_target", _L), ("y_target", _L), ("r_target", _D),
    ("move", _L), ("steps", _I), ("sub_history", T.ArrayType(BACKLASH_STEP)),
)

# Streams and replays carry the order explicitly.
STREAM_STEP = _s(
    ("run_id", _S), ("source_index", _L), ("event_time", T.TimestampType()), ("step", _L),
    ("x_target_abs", _L), ("y_target_abs", _L), ("x_actual_abs", _L), ("y_actual_abs", _L),
    ("confidence", _D), ("position_confidence", _D),
)

TILES = "run_id string, tile_id bigint, w int, h int, pixels binary"
EDGES = (
    "run_id string, i bigint, j bigint, dx double, dy double, score double, "
    "peak_margin double, base_weight double"
)
POSES = "run_id string, tile_id bigint, x double, y double"
