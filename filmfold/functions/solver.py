"""The one Python function of the engine: a batched k x k non-negative solve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def fold_in_solver(rank: int):
    """Pandas UDF ``(gram, rhs, ridge) -> vector`` over Arrow batches.

    ``gram`` is the upper triangle, row by row. All rows of a batch are solved
    together: a coordinate that leaves the active set becomes an identity row
    with a zero right-hand side, so shapes never change. Coordinates that come
    out at or below zero are dropped for good, and the solve repeats until
    what remains is non-negative.
    """
    rows, cols = np.triu_indices(rank)

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, rhs: pd.Series, ridge: pd.Series) -> pd.Series:
        n = len(gram)
        if n == 0:
            return pd.Series([], dtype=object)
        full = np.zeros((n, rank, rank))
        flat = np.stack([np.asarray(g, dtype=float) for g in gram])
        full[:, rows, cols] = flat
        full[:, cols, rows] = flat
        diag = np.arange(rank)
        full[:, diag, diag] += ridge.to_numpy(dtype=float)[:, None]
        b = np.stack([np.asarray(r, dtype=float) for r in rhs])

        weight = ridge.to_numpy(dtype=float) > 0
        active = np.repeat(weight[:, None], rank, axis=1)
        result = np.zeros((n, rank))
        todo = np.flatnonzero(weight)
        while len(todo):
            keep = active[todo]
            a = full[todo] * keep[:, :, None] * keep[:, None, :]
            a[:, diag, diag] += ~keep
            x = np.linalg.solve(a, (b[todo] * keep)[:, :, None])[:, :, 0]
            result[todo] = x
            negative = (x < 0).any(axis=1)
            active[todo] = keep & (x > 0)
            todo = todo[negative & active[todo].any(axis=1)]
        return pd.Series(list(np.maximum(result, 0.0)))

    return solve
