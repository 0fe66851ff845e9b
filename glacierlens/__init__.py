"""PySpark engine for glacier altimetry, climate extremes and model ensembles.

Every operator takes DataFrames and returns a DataFrame.  ``functions`` holds
column expressions and exact grouped quantiles, ``sources`` the scans and
sinks, ``operators`` the relational work, ``streaming`` the file-arrival jobs
and ``plans`` the registered queries with their SQL oracles.
"""
