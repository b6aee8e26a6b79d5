"""Fisher's exact test, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def fisher_two_sided(a: int, b: int, c: int, d: int, log_fact: np.ndarray) -> float:
    """p of the 2x2 table [[a, b], [c, d]]: all tables with the same margins that are no likelier."""
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    x = np.arange(max(0, c1 - r2), min(r1, c1) + 1)
    lp = log_fact[r1] + log_fact[r2] + log_fact[c1] + log_fact[n - c1] - log_fact[n] - log_fact[x] - log_fact[r1 - x] - log_fact[c1 - x] - log_fact[r2 - c1 + x]
    own = lp[a - x[0]]
    return float(min(1.0, np.exp(lp[lp <= own + 1e-7]).sum()))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    t = pd.concat([a, b, c, d], axis=1)
    ok = t.notna().all(axis=1).to_numpy()
    v = t.fillna(0).to_numpy(np.int64)
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(v.sum(axis=1).max(initial=0)) + 1)))])
    seen: dict[tuple, float] = {}
    out = np.full(len(v), np.nan)
    for i in np.flatnonzero(ok):
        k = tuple(v[i].tolist())
        if k not in seen:
            seen[k] = fisher_two_sided(*k, fact)
        out[i] = seen[k]
    return pd.Series(out).where(ok)
