"""Signal transforms and their inverses as column expressions (value-wise, JVM side)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from genotiles.functions.numeric import finite

# Exponent of the squash and the floor under a scale factor when dividing by it.
SQUASH_POWER = 0.75
MIN_SCALE = 1e-8


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def squash_power(x: Column) -> Column:
    return F.pow(x + 1.0, F.lit(SQUASH_POWER)) - 1.0


def transform_value(
    value: Column,
    scale: Column | float,
    clip_soft: Column | float,
    clip_hard: Column | float,
    *,
    apply_scale: bool = True,
    apply_squash: bool = True,
    apply_clip: bool = True,
) -> Column:
    """Scale, clip and squash one stored signal value.

    Values that are missing, not finite or negative become 0. The soft clip works in squashed
    space, so it needs both the clip and the squash step.
    """
    x = F.when(finite(value) & (value > 0), value.cast("double")).otherwise(F.lit(0.0))
    if apply_scale:
        x = x * _column(scale)
    if apply_clip:
        x = F.least(x, _column(clip_hard))
    if not apply_squash:
        return x
    x = squash_power(x)
    if not apply_clip:
        return x
    knee = squash_power(_column(clip_soft))
    return F.when(x > knee, knee - 1.0 + F.sqrt(F.greatest(x - knee + 1.0, F.lit(0.0)))).otherwise(x)


def inverse_value(
    value: Column,
    scale: Column | float | None = None,
    *,
    apply_squash: bool = True,
    apply_scale: bool = True,
) -> Column:
    """Undo squash and scale. The soft clip is not undone."""
    x = F.greatest(value.cast("double"), F.lit(0.0))
    if apply_squash:
        x = F.greatest(F.pow(x + 1.0, F.lit(1.0 / SQUASH_POWER)) - 1.0, F.lit(0.0))
    if apply_scale and scale is not None:
        x = x / F.greatest(_column(scale), F.lit(MIN_SCALE))
    return x


def signed_sqrt(y: Column, eps: float = 1e-2) -> Column:
    """Signed square-root squash with a small linear part."""
    return F.signum(y) * (F.sqrt(F.abs(y) + 1.0) - 1.0) + F.lit(eps) * y


@dataclass(frozen=True)
class TargetTransform:
    name: str
    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]


def _positive(x: Column) -> Column:
    return F.greatest(x.cast("double"), F.lit(0.0))


def _power(exponent: float) -> TargetTransform:
    return TargetTransform(
        "power",
        lambda x: F.pow(_positive(x), F.lit(exponent)),
        lambda y: F.pow(_positive(y), F.lit(1.0 / exponent)),
    )


def target_transform(name: str, power_value: float | None = None) -> TargetTransform:
    """Look a target transform up: ``identity``, ``log1p``, ``power`` or ``power_<p>``."""
    if name == "identity":
        return TargetTransform(name, lambda x: x, lambda y: y)
    if name == "log1p":
        return TargetTransform(
            name,
            lambda x: F.log1p(_positive(x)),
            lambda y: F.greatest(F.expm1(y.cast("double")), F.lit(0.0)),
        )
    if name == "power":
        if power_value is None:
            raise ValueError("target transform 'power' needs power_value")
        return _power(power_value)
    if name.startswith("power_"):
        spelled = float(name[len("power_"):].replace("_", "."))
        return _power(spelled if power_value is None else power_value)
    raise ValueError(f"unknown target transform {name!r}; known: identity, log1p, power, power_<p>")
