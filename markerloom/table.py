"""The marker table: one row for each marker with an array of depths, with those that aren't 0, or with bits of who has it; or
one for each marker and individual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.plans import presence
from markerloom.plans.lineage import stored
from markerloom.types import MAX_DEPTH, Groups, MarkerError, resolve_groups

#: The bound of the file format; tables themselves have none.
MAX_INDIVIDUALS = 65535


class MarkerTable:
    """Depths of markers in individuals.

    ``layout`` is ``"array"`` (``ord, id, sequence, depths``, where ``depths`` follows ``individuals``) or ``"long"``
    (``id, sequence, individual, depth``, absent pairs being 0). Wide tables are better ``"sparse"`` (``ord, id, sequence,
    entries``: places and depths that aren't 0, in order), or ``"bits"`` (``ord, id, sequence, words``: who has a marker with
    the depth that it was packed with), on which all that counts individuals works. ``popmap`` has (individual, group) pairs
    in order.
    """

    def __init__(self, df: DataFrame, individuals: Sequence[str], popmap: Sequence[tuple[str, str]] = (), layout: str = "array", packed_depth: int = 1):
        if layout not in ("array", "long", "sparse", "bits"):
            raise MarkerError(f"unknown layout {layout!r}")
        if len(set(individuals)) != len(individuals) and layout == "long":
            raise MarkerError("individuals must be distinct")
        self.df, self.individuals, self.popmap, self.layout, self.packed_depth = df, list(individuals), [tuple(x) for x in popmap], layout, packed_depth

    @classmethod
    def from_path(cls, path: str, popmap=None) -> MarkerTable:
        from markerloom.api import marker_table

        return marker_table(path, popmap)

    @classmethod
    def from_dataframe(cls, markers, popmap=None) -> MarkerTable:
        """From a Spark or pandas frame, or an Arrow table, with a column for each individual."""
        from markerloom.api import marker_table

        return marker_table(markers, popmap)

    def to_dataframe(self) -> DataFrame:
        """A column for each individual, after the id (a number where all ids are numbers, else text) and the sequence."""
        from markerloom.sources.writers import wide

        out = wide(self)
        return out.na.fill(0, out.columns[2:])

    def to_pandas(self):
        return self.to_dataframe().toPandas()

    def to_arrow(self):
        return self.to_dataframe().toArrow()

    def to_polars(self):
        import polars

        return polars.from_arrow(self.to_arrow())

    @property
    def data(self) -> DataFrame:
        """The rows as they are held."""
        return self.df

    def to_reader(self):
        """:meth:`to_dataframe` as a stream of Arrow batches, of which one is held at a time."""
        from markerloom.sources.stream import reader

        return reader(self.to_dataframe())

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_reader().__arrow_c_stream__(requested_schema)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_popmap(self, popmap: Sequence[tuple[str, str]]) -> MarkerTable:
        return MarkerTable(self.df, self.individuals, popmap, self.layout, self.packed_depth)

    def cache(self) -> MarkerTable:
        return MarkerTable(self.df.cache(), self.individuals, self.popmap, self.layout, self.packed_depth)

    @property
    def n_individuals(self) -> int:
        return len(self.individuals)

    def n_markers(self, min_depth: int = 1) -> int:
        """Markers present in at least one individual."""
        return self.counts(min_depth).where("n_ind > 0").count()

    def groups(self, group1: str | None = None, group2: str | None = None) -> Groups:
        return resolve_groups(self.popmap, group1, group2)

    def popmap_frame(self) -> DataFrame:
        schema = T.StructType([T.StructField("individual", T.StringType()), T.StructField("grp", T.StringType())])
        return self.spark.createDataFrame([tuple(x) for x in self.popmap], schema)

    def counts(self, min_depth: int = 1, groups: Groups | None = None, depths: bool = False) -> DataFrame:
        """``id, sequence, g1, g2, n_ind`` (and ``ord`` where there is one): in how many individuals of each group, and of
        all columns, a marker has ``min_depth`` or more; ``depths`` keeps the arrays. One narrow projection, or one aggregation
        for the long layout."""
        if min_depth < 1:
            raise MarkerError("min_depth must be 1 or more")
        if self.layout != "long":
            if self.layout == "bits" and min_depth != self.packed_depth:
                raise MarkerError(f"packed with a depth of {self.packed_depth}")
            group = dict(self.popmap)

            def present(name: str | None) -> Column:
                places = [i for i, x in enumerate(self.individuals) if name is not None and group.get(x) == name]
                if not places:
                    return F.lit(0)
                of = presence.mask(places, self.n_individuals)
                if self.layout == "bits":
                    return presence.count_bits(F.col("words"), of)
                if self.layout == "sparse":
                    return F.size(F.filter("entries", lambda e: (e["depth"] >= min_depth) & presence.is_set(of, e["col"])))
                return F.size(F.filter("depths", lambda d, i: (d >= min_depth) & presence.is_set(of, i)))

            n_ind = {"array": lambda: F.size(F.filter("depths", lambda d: d >= min_depth)), "sparse": lambda: F.size(F.filter("entries", lambda e: e["depth"] >= min_depth)), "bits": lambda: presence.count_bits(F.col("words"))}[self.layout]()
            kept = [c for c in ("ord", "id", "sequence", *(["depths", "entries"] if depths else [])) if c in self.df.columns]
            return self.df.select(*kept, present(groups and groups.group1).cast("int").alias("g1"), present(groups and groups.group2).cast("int").alias("g2"), n_ind.alias("n_ind"))
        here = self.df.where(F.col("depth") >= min_depth)
        if groups is not None:
            here = here.join(F.broadcast(self.popmap_frame()), "individual", "left")
            g1, g2 = (F.count_if(F.col("grp") == g) for g in (groups.group1, groups.group2))
        else:
            g1 = g2 = F.lit(0)
        return here.groupBy("id", "sequence").agg(g1.cast("int").alias("g1"), g2.cast("int").alias("g2"), F.count("*").cast("int").alias("n_ind"))

    def counts_twice(self, min_depth: int, groups: Groups | None, depths: bool = False) -> DataFrame:
        """:meth:`counts` for plans that read it twice: those of the long layout, which take a shuffle, are stored."""
        out = self.counts(min_depth, groups, depths)
        return stored(out, "counts") if self.layout == "long" else out

    def places(self) -> DataFrame:
        """``individual, col``: a row for each individual."""
        return self.spark.createDataFrame([(x, i) for i, x in enumerate(self.individuals)], "individual string, col int")

    def depths(self, *keys: str) -> DataFrame:
        """``keys, col, depth`` of all pairs that aren't 0, individuals by their places."""
        if self.layout == "bits":
            raise MarkerError("a packed table has no depths")
        if self.layout == "long":
            return self.df.where("depth > 0").join(F.broadcast(self.places()), "individual").select(*keys, "col", "depth")
        if self.layout == "sparse":
            return self.df.select(*keys, F.explode("entries").alias("e")).select(*keys, "e.col", "e.depth")
        return self.df.select(*keys, F.posexplode("depths").alias("col", "depth")).where("depth > 0")

    def long(self) -> DataFrame:
        """``id, sequence, individual, depth`` of all pairs that aren't 0."""
        if self.layout == "long":
            return self.df.where("depth > 0").select("id", "sequence", "individual", "depth")
        return self.depths("id", "sequence").join(F.broadcast(self.places()), "col").select("id", "sequence", "individual", "depth")

    def sparse(self, ordered: bool = True) -> MarkerTable:
        """The same table in the sparse layout; ids are ordered to make ``ord`` (0 everywhere unless ``ordered``)."""
        from markerloom.operators.merge import numbered

        if self.layout == "sparse":
            return self
        if self.layout == "array":
            each = F.filter(F.transform("depths", lambda d, i: F.struct(i.alias("col"), d.alias("depth"))), lambda e: e["depth"] > 0)
            return MarkerTable(self.df.select("ord", "id", "sequence", each.alias("entries")), self.individuals, self.popmap, "sparse")
        rows = presence.gathered(self.depths("id", "sequence"), "id", "sequence")
        rows = numbered(rows, F.col("id"), F.col("sequence")) if ordered else rows.withColumn("ord", F.lit(0).cast("bigint"))
        return MarkerTable(rows.select("ord", "id", "sequence", "entries"), self.individuals, self.popmap, "sparse")

    def packed(self, min_depth: int = 1) -> MarkerTable:
        """Who has each marker with ``min_depth`` or more, as bits: a small table for many tests of different groups."""
        if min_depth < 1:
            raise MarkerError("min_depth must be 1 or more")
        rows = presence.packed(self.sparse(ordered=False).df, self.n_individuals, min_depth)
        return MarkerTable(rows, self.individuals, self.popmap, "bits", min_depth)

    def arrays(self, ordered: bool = True) -> MarkerTable:
        """The same table in the array layout; ids are ordered to make ``ord`` (0 everywhere unless ``ordered``)."""
        if self.layout == "array":
            return self
        rows = presence.scattered(self.sparse(ordered).df, self.n_individuals)
        return MarkerTable(rows.select("ord", "id", "sequence", "depths"), self.individuals, self.popmap)

    # -- operators -------------------------------------------------------------------------------------------------

    def freq(self, **kw) -> DataFrame:
        from markerloom.operators.freq import freq

        return freq(self, **kw)

    def distrib(self, **kw) -> DataFrame:
        from markerloom.operators.distrib import distrib

        return distrib(self, **kw)

    def signif(self, **kw) -> DataFrame:
        from markerloom.operators.signif import signif

        return signif(self, **kw)

    def subset(self, **kw) -> DataFrame:
        from markerloom.operators.subset import subset

        return subset(self, **kw)

    def triage(self, **kw) -> DataFrame:
        from markerloom.operators.triage import triage

        return triage(self, **kw)

    def depth(self, **kw) -> DataFrame:
        from markerloom.operators.depth import depth

        return depth(self, **kw)

    def pca(self, **kw):
        from markerloom.operators.pca import pca

        return pca(self, **kw)

    def map(self, genome: DataFrame, **kw) -> DataFrame:
        from markerloom.operators.align import align

        return align(self, genome, **kw)

    def filter_map(self, f, schema: str) -> DataFrame:
        from markerloom.operators.folding import filter_map

        return filter_map(self, f, schema)

    def fold(self, start, step, combine, finish, schema: str, **kw) -> DataFrame:
        from markerloom.operators.folding import fold

        return fold(self, start, step, combine, finish, schema, **kw)

    def summary(self) -> dict:
        return {"n_markers": self.n_markers(), "n_individuals": self.n_individuals}


def clamped(depth: Column) -> Column:
    """A depth as the table holds it: an integer from 0 to 65535, 0 for what isn't a number."""
    return F.coalesce(F.least(F.greatest(depth.cast("bigint"), F.lit(0)), F.lit(MAX_DEPTH)), F.lit(0)).cast("int")
