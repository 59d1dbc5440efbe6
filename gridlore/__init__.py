"""gridlore: automatic analysis of any table, as Spark jobs."""

from gridlore.plans.report import Report, analyze, preview
from gridlore.plans.store import ReportStore
from gridlore.session import configure
from gridlore.sources.readers import from_rows, read_csv, read_json, read_parquet
from gridlore.sources.staging import fingerprint, stage
from gridlore.sources.workbook import read_workbooks

__all__ = [
    "Report",
    "ReportStore",
    "analyze",
    "configure",
    "fingerprint",
    "from_rows",
    "preview",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_workbooks",
    "stage",
]
