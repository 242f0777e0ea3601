"""Property graphs of source code on Spark, and operators that prepare training data."""

from .operators.filters import QueryError
from .plans.engine import Options, analyse, analyse_files
from .plans.workspace import Workspace
from .sources.export import read_json, read_tables, write_json, write_tables
from .sources.extract import extract

__version__ = "0.2.0"
__all__ = ["Options", "QueryError", "Workspace", "analyse", "analyse_files", "extract", "read_json", "read_tables", "write_json", "write_tables"]
