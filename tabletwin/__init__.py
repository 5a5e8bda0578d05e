"""tabletwin: learn the shape of a table and make or check tables of the same shape, on Spark.

Subpackages
-----------
functions   Column-expression helpers (counter-based draws, numeric fixes, request text rules).
operators   DataFrame operators: profile, fit, fd, contract, synth, compare, plus rank/prefix-sum primitives.
sources     Readers and writers (CSV, JSON, Parquet) and artifact save/load.
plans       Named query plans over the driver tables and their DuckDB oracle SQL.
streaming   The contract check run on a Structured Streaming source.
"""

__version__ = "0.1.0"
