"""Batch inference: a user model over windows, Spark doing the fetching, spreading and writing."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genotiles.functions.arrays import one_hot_arrow, one_hot_numpy
from genotiles.functions.signal import inverse_value

Model = Callable[[np.ndarray], np.ndarray]


def _of_worker(token: str, load: Callable[[], Model]) -> Model:
    """The model of the call that ``token`` names, loaded once per Python worker; an earlier call's is dropped.

    Kept in a module of its own, because this one may travel to the worker anew with every task.
    """
    kept = sys.modules.setdefault("_genotiles_worker", ModuleType("_genotiles_worker")).__dict__
    if kept.get("token") != token:
        kept.update(model=load(), token=token)
    return kept["model"]


def predict_windows(
    windows: DataFrame,
    load_model: Callable[[], Model],
    *,
    batch_size: int = 4,
    tracks: Sequence[int] | None = None,
    inverse_squash: bool = False,
    on_error: str = "raise",
    include_input: bool = False,
) -> DataFrame:
    """Add ``values [T][B]`` to windows that carry ``seq``, which is dropped.

    ``load_model`` runs once per Python worker; the model maps ``[batch, 4, L]`` to ``[batch, T, B]``. Only
    ``tracks`` are kept, already inside the task. With ``on_error='skip'`` a batch that fails is tried
    window by window and the windows that fail are left out. ``include_input`` keeps the one-hot input
    as ``input [4][L]``.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    wanted = None if tracks is None else list(tracks)
    kept = [f for f in windows.schema.fields if include_input or f.name != "seq"]
    values_type = T.ArrayType(T.ArrayType(T.FloatType()))
    schema = T.StructType([*kept, T.StructField("values", values_type)])
    names = [f.name for f in kept]
    token = uuid.uuid4().hex

    def run(model: Model, sequences: list[str]) -> list[np.ndarray]:
        out = np.asarray(model(np.stack([one_hot_numpy(s) for s in sequences]).astype(np.float32)))
        return list(out if wanted is None else out[:, wanted])

    def run_leniently(model: Model, sequences: list[str]) -> list[np.ndarray | None]:
        try:
            return list(run(model, sequences))
        except Exception:
            if on_error == "raise":
                raise
        found: list[np.ndarray | None] = []
        for sequence in sequences:
            try:
                found.extend(run(model, [sequence]))
            except Exception:
                found.append(None)
        return found

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _of_worker(token, load_model)
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                results = run_leniently(model, part.column("seq").to_pylist())
                good = [i for i, r in enumerate(results) if r is not None]
                if not good:
                    continue
                rows = part.select(names).take(pa.array(good)) if len(good) < part.num_rows else part.select(names)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, _nested([results[i] for i in good])], names=[*names, "values"]
                )

    predicted = windows.mapInArrow(score, schema)
    if include_input:
        predicted = predicted.withColumn("input", one_hot_arrow("seq")).drop("seq")
    if inverse_squash:
        undo = lambda v: inverse_value(v, apply_scale=False).cast("float")
        predicted = predicted.withColumn(
            "values", F.transform("values", lambda row: F.transform(row, undo))
        )
    return predicted


def _nested(matrices: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([m.astype(np.float32).reshape(-1) for m in matrices])
    inner = np.concatenate([[0], np.cumsum([m.shape[1] for m in matrices for _ in range(m.shape[0])])])
    outer = np.concatenate([[0], np.cumsum([m.shape[0] for m in matrices])])
    rows = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat, pa.float32()))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), rows)


def by_track(predictions: DataFrame, tracks: Sequence[int] | None = None) -> DataFrame:
    """One row per (window, track) with ``vals``; ``track`` is the index in the full track list."""
    rows = predictions.select("*", F.posexplode("values").alias("__row", "vals")).drop("values")
    if tracks is None:
        return rows.withColumn("track", F.col("__row")).drop("__row")
    original = F.array(*[F.lit(int(t)) for t in tracks])
    return rows.withColumn("track", F.get(original, F.col("__row"))).drop("__row")
