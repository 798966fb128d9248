"""Comparison of result tables, whatever the order of their rows and columns."""

import numpy as np
import pandas as pd


def _cell(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_cell(v) for v in value)
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, (float, np.floating)):
        return f"{value:.6g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in ordered.itertuples(index=False))


def same(left: pd.DataFrame, right: pd.DataFrame) -> bool:
    return sorted(left.columns) == sorted(right.columns) and rows(left) == rows(right)
