"""Signal analytics for panels of time series, as Spark DataFrame operators.

Tables are long: one row per ``(ts, symbol)``.  ``pos`` is the bar number of
``ts`` on the regular calendar of the panel, missing cells are absent rows or
nulls (never NaN), and every operator maps DataFrames to a DataFrame.
"""
