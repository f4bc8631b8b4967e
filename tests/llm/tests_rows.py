import numbers

import pandas as pd


def same(a, b) -> bool:
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]

    def rows(df):
        def text(x):
            return "NULL" if pd.isna(x) else f"{x:.6f}" if isinstance(x, numbers.Number) else str(x)

        return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))

    return list(a.columns) == list(b.columns) and rows(a) == rows(b)
