"""The one-to-one join: rows and columns of a key paired at least total cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.assignment import associate, associate_locked
from ..plans.grouping import grouped_map


def _matrix(pdf: pd.DataFrame, row: str, column: str, cost: str, missing: float) -> tuple[list, list, np.ndarray]:
    rows, columns = sorted(pdf[row].dropna().unique()), sorted(pdf[column].dropna().unique())
    out = np.full((len(rows), len(columns)), missing)
    full = pdf.dropna(subset=[row, column])
    out[np.searchsorted(rows, full[row]), np.searchsorted(columns, full[column])] = full[cost]
    return rows, columns, out


def assigned(pairs: DataFrame, keys: list[str], row: str, column: str, cost: str, most: float, *, missing: float = 1.0, lock_clear: bool = False) -> DataFrame:
    """The matches and leftovers of each key: row, column and cost, with null for the missing side.

    pairs holds the costs of candidate pairs, at most one row a pair; a row with a
    null column (or a null row) names one without candidates. Pairs that are not
    listed cost `missing`. Matches dearer than `most` are dropped after the
    solution. Lower rows, then lower columns, win ties. One key's matrix is
    solved in one task: keys are frames or sequences, of bounded size.
    """
    solve = associate_locked if lock_clear else associate

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns, matrix = _matrix(pdf, row, column, cost, missing)
        found, left, right = solve(matrix, most)
        out = [(rows[r], columns[c], matrix[r, c]) for r, c in found] + [(rows[r], None, None) for r in left] + [(None, columns[c], None) for c in right]
        made = pd.DataFrame(out, columns=[row, column, cost], dtype=object)
        for k in reversed(keys):
            made.insert(0, k, pdf[k].iloc[0])
        return made

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, row, column]) + f", `{cost}` double"
    return grouped_map(pairs, keys, one, schema)
