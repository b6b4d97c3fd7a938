"""Loops on tables: a written table a step, its convergence figures from the same job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from netspark.workspace import Workspace


class Loop:
    """Keeps the state of the last two steps in the shared folder."""

    def __init__(self, ws: Workspace, name: str):
        self.ws, self.name, self.step = ws, name, 0

    def save(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """Write the next state; ``figures`` are aggregates of it, computed while writing."""
        seen: dict = {}
        if figures:
            o = Observation()
            df = df.observe(o, *[c.alias(k) for k, c in figures.items()])
        out = self.ws.save(df, f"{self.name}{self.step:03d}")
        if figures:
            seen = o.get
        if self.step >= 2:
            self.ws.drop(f"{self.name}{self.step - 2:03d}")
        self.step += 1
        return out, seen
