"""txnclean: clean and load messy transaction tables with Spark.

Public API (DataFrame in, DataFrames out):

* :func:`clean` / :func:`clean_csv` - cell rules, first-row-wins dedupe, optional
  near-duplicate ("ghost") removal, stats and a row audit.
* :func:`load` / :func:`load_csv` - SQL type inference and a JDBC or catalog table sink.
* :func:`read_csv` - CSV scan with the arrival-order column.
"""

from .plans.clean_job import CleanResult, GhostOptions, clean, clean_csv, clean_summary
from .plans.load_job import load, load_csv, load_summary
from .plans.roles import ColumnMapping, infer_column_mapping
from .sources.csv_source import read_csv

__all__ = ["ColumnMapping", "infer_column_mapping", "CleanResult", "GhostOptions", "clean",
           "clean_csv", "clean_summary", "load", "load_csv", "load_summary", "read_csv"]
