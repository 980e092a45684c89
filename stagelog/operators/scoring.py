"""Scoring windows with a user's predictor and searching the best command.

``predict`` is a Python callable: float32 array (batch, window, 4) of scaled
relative (tx, ty, ax, ay) rows to (batch, 2) scaled relative positions.  With
``loader=True`` it takes no argument and returns such a callable; it is then
called once per task, which suits a model that has to be loaded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stagelog.functions.rows import distance
from stagelog.operators.features import model_windows
from stagelog.session import cut_lineage

_FIELDS = ("tx", "ty", "ax", "ay")


def _flat(window: str = "window") -> Column:
    """A window as one plain number array, which reaches Python as one buffer per row."""
    return F.flatten(F.transform(window, lambda e: F.array(*[e[c] for c in _FIELDS])))


def _tensor(flat: pd.Series) -> np.ndarray:
    return np.stack(flat.to_list()).reshape(len(flat), -1, len(_FIELDS)) if len(flat) else np.empty((0, 1, 4))


def score_windows(
    windows: DataFrame, predict: Callable, mean: float = 0.0, scale: float = 1.0, loader: bool = False,
) -> DataFrame:
    """Scale, predict, undo the scale, and return absolute predicted positions."""
    schema = "x double, y double"

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = predict() if loader else predict
        for batch in batches:
            scaled = ((_tensor(batch) - mean) / scale).astype(np.float32)
            yield pd.DataFrame(np.asarray(model(scaled), dtype=float) * scale + mean, columns=["x", "y"])

    out = windows.withColumn("__p", score(_flat()))
    return out.withColumns({
        "x_predicted": F.col("__p.x") + F.col("ref_x"), "y_predicted": F.col("__p.y") + F.col("ref_y")}).drop("__p")


def command_windows(steps: DataFrame, window: int, **options) -> DataFrame:
    """The window of each record with its own target as the command still to choose."""
    return model_windows(steps, window, actual_lag=1, **options).withColumns({
        "x_target": F.col("x_target_abs"), "y_target": F.col("y_target_abs")})


def best_command(
    windows: DataFrame, predict: Callable, step_nm: int = 100, lo: int = -50, hi: int = 50,
    mean: float = 0.0, scale: float = 1.0, loader: bool = False,
) -> DataFrame:
    """The candidate command whose predicted position is nearest the target.

    A task scores all candidates of a target in one batch and keeps one row per
    target, so the grid is never shuffled.  The first candidate in x-major order
    wins ties; the error is truncated to whole nanometres.
    """
    offsets = np.arange(lo, hi) * step_nm
    grid = np.stack(np.meshgrid(offsets, offsets, indexing="ij"), -1).reshape(-1, 2).astype(float)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predict() if loader else predict
        for frame in frames:
            rows = []
            for tensor, ref, target in zip(
                    _tensor(frame["window"]), frame[["ref_x", "ref_y"]].to_numpy(float),
                    frame[["x_target", "y_target"]].to_numpy(float)):
                command = target + grid
                full = np.repeat(tensor[None], len(grid), axis=0)
                full[:, -1, :2] = command - ref
                guess = np.asarray(model(((full - mean) / scale).astype(np.float32)), dtype=float)
                guess = guess * scale + mean + ref
                error = np.hypot(guess[:, 0] - target[0], guess[:, 1] - target[1])
                k = int(np.argmin(error))
                rows.append((int(command[k, 0]), int(command[k, 1]), int(error[k])))
            found = pd.DataFrame(rows, columns=["x_command", "y_command", "error_nm"])
            keep = frame.drop(columns=["window"]).reset_index(drop=True)
            yield pd.concat([keep, found], axis=1) if len(frame) else keep.reindex(
                columns=[*keep.columns, "x_command", "y_command", "error_nm"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name != "window"]
    schema = ", ".join([*fields, "x_command bigint", "y_command bigint", "error_nm bigint"])
    return windows.withColumn("window", _flat()).mapInPandas(search, schema)


def best_command_expr(
    targets: DataFrame, key: list[str], predict_x: Column, predict_y: Column, step_nm: int = 100,
    lo: int = -50, hi: int = 50,
) -> DataFrame:
    """C8 + I13 + J2 with the predictor as column expressions over ``x_command`` and ``y_command``.

    The constant-size grid explodes in place, twice: once for the least error of each target and once for the
    first candidate that has it.  Both are plain numbers, which combine in a hash table before the shuffle; a
    struct of them would have every candidate sorted.
    """
    n = hi - lo
    group = [*key, "x_target", "y_target"]
    x = F.col("x_target") + (F.expr(f"ord div {n}") + lo) * step_nm
    y = F.col("y_target") + (F.col("ord") % n + lo) * step_nm
    targets = cut_lineage(targets)

    def tried(rows: DataFrame) -> DataFrame:
        cand = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumns({"x_command": x, "y_command": y})
        return cand.withColumn("err", distance(predict_x - F.col("x_target"), predict_y - F.col("y_target")))

    least = tried(targets).groupBy(*group).agg(F.min("err").alias("__least"), F.count_if(F.col("err").isNull()).alias("__null"))
    # an error that is null comes before all others
    least = least.select(*[F.col(c).alias(f"__{c}") for c in group], F.when(F.col("__null") == 0, F.col("__least")).alias("__least"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
    best = tried(targets.join(least, same)).where(F.col("err").eqNullSafe(F.col("__least"))).groupBy(*group, "__least").agg(F.min("ord").alias("ord"))
    return best.select(*group, x.cast("bigint").alias("x_command"), y.cast("bigint").alias("y_command"),
                       F.col("__least").cast("bigint").alias("error_nm"))
