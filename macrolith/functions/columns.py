"""Distribution functions of columns, in Arrow batches, where Spark has no built-in one."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import dist


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series([dist.norm_cdf(v) if v == v else None for v in x.to_numpy(float)])


_Z = np.linspace(-8.2, 8.2, 4101)
_P = np.array([dist.norm_cdf(z) for z in _Z])


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """From a table, then by Newton steps; NaN outside 0..1. The upper half is the lower one mirrored."""
    low = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        z = np.interp(np.log(low), np.log(_P[: len(_Z) // 2 + 1]), _Z[: len(_Z) // 2 + 1])
        for _ in range(3):
            c = np.array([dist.norm_cdf(v) for v in z])
            z = z - c * (np.log(c) - np.log(low)) / dist.norm_pdf(z)
    return np.where((p > 0) & (p < 1), np.where(p <= 0.5, z, -z), np.nan)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf_array(p.to_numpy(float)))
