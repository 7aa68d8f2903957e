"""markerloom: marker-by-individual depth analytics on Spark DataFrames."""

from markerloom.table import MarkerTable
from markerloom.types import Correction, Groups, MarkerError, Test

__all__ = ["Correction", "Groups", "MarkerError", "MarkerTable", "Test"]
