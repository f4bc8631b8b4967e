import numbers

import numpy as np
import pandas as pd


def rows_of(df) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name, floats to six places."""
    df = df[sorted(df.columns)]

    def text(x):
        if pd.isna(x):
            return "NULL"
        return f"{x:.6f}" if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))
