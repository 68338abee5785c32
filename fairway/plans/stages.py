"""A pipeline of named stages over DataFrames, with the result of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """What a run gave: the last frame, or the error and the stage that raised it, and the frame of every stage that was planned."""

    result: DataFrame | None = None
    error: str | None = None
    failed: str | None = None
    stages: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def success(self) -> bool:
        return self.error is None


def run_stages(df: DataFrame, stages: list[tuple[str, Stage]]) -> Outcome:
    """Plans the stages one after another, each on the frame of the one before; nothing is computed before an action."""
    if len({name for name, _ in stages}) < len(stages):
        raise ValueError("stages need names of their own")
    out = Outcome(df)
    for name, stage in stages:
        try:
            df = stage(df)
        except Exception as e:  # noqa: BLE001 - any error of a stage is its outcome
            return Outcome(None, f"{type(e).__name__}: {e}", name, out.stages)
        out.stages[name] = out.result = df
    return out
