"""Results for users who don't hold DataFrames: a frame with conversions and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.sources.stream import reader


class Result:
    """A DataFrame (``frame``, whose attributes it has) with conversions."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def __getattr__(self, name: str):
        if name == "frame":
            raise AttributeError(name)
        return getattr(self.frame, name)

    def to_dataframe(self) -> DataFrame:
        return self.frame

    def to_pandas(self):
        return self.frame.toPandas()

    def to_arrow(self):
        return self.frame.toArrow()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_arrow())

    def to_reader(self):
        """The rows as a stream of Arrow batches, of which one is held at a time."""
        return reader(self.frame)

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_reader().__arrow_c_stream__(requested_schema)

    def summary(self) -> dict:
        return {"rows": self.frame.count()}


class TriageResult(Result):
    def summary(self) -> dict:
        """Candidates, how many have each call, and how many are of each class."""
        classes = {f"class {r.Candidate_Class}": r.n for r in self.frame.groupBy("Candidate_Class").agg(F.count("*").alias("n")).collect()}  # five at most
        calls = self.frame.agg(F.count("*").alias("candidates"), *[F.count_if(c).alias(c) for c in ("Strict_Call", "Posterior_Call", "Bayes_Factor_Call")]).first().asDict()
        return calls | classes
