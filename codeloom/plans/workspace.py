"""Tables that many queries share, staged once per session and input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import extract, graph, scan
from codeloom.session import stage
from codeloom.sources import derived

# What the edges, and what the edges and the nodes of the graph are made of.
IMPORTS = ("imports",)
GRAPH_SYMBOLS = ("imports", "api_routes", "types")


class Workspace:
    """The corpus table is derived once, and extraction reads all its text once:
    both results are Parquet, so every later job scans the columns it needs. What reads
    one of them in a single pass needs it staged only if it is already."""

    _open: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        # staged tables outlive a session of the same application
        cls._open[key].spark = spark
        return cls._open[key]

    @classmethod
    def forget(cls, spark: SparkSession, sf_dir: str) -> None:
        """Call when the input under a path has changed: its tables are staged anew."""
        cls._open.pop((spark.sparkContext.applicationId, sf_dir), None)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage(build(), name)
        return self._tables[name]

    def _passing(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The staged table, or else its rows as they are computed, for a single pass: the
        columns that are not read are then not computed, and nothing is written."""
        return self._tables[name] if name in self._tables else build()

    def _derived(self) -> DataFrame:
        return derived.corpus(self.spark, self.sf_dir)

    def _next_derived(self) -> DataFrame:
        return derived.next_corpus(self.spark, self.sf_dir)

    def _extracted(self) -> DataFrame:
        return extract.file_nodes(self.files)

    @property
    def corpus(self) -> DataFrame:
        return self._once("corpus", self._derived)

    @property
    def next_corpus(self) -> DataFrame:
        return self._once("next-corpus", self._next_derived)

    @property
    def files(self) -> DataFrame:
        """Source files for a single pass."""
        return scan.source_files(self._passing("corpus", self._derived))

    @property
    def next_files(self) -> DataFrame:
        """Source files of the next revision for a single pass. A staged corpus is small for
        its text and read in few parts, so extraction is dealt out better without it."""
        return scan.source_files(self._passing("next-corpus", self._next_derived))

    @property
    def nodes(self) -> DataFrame:
        return self._once("file-nodes", self._extracted)

    @property
    def passing_nodes(self) -> DataFrame:
        """File nodes for a single pass."""
        return self._passing("file-nodes", self._extracted)

    def symbols(self, *columns: str) -> DataFrame:
        """File nodes with these symbols for several passes: what is staged with all of them,
        or else no other symbols are extracted and staged."""
        for kept in ("file-nodes", "graph-symbols", "imports"):
            if kept in self._tables and set(columns) <= set(self._tables[kept].columns):
                return self._tables[kept]
        if columns == IMPORTS:
            name = "imports"
        elif columns == GRAPH_SYMBOLS:
            name = "graph-symbols"
        else:
            return self.nodes
        return self._once(name, lambda: self._extracted().select("project", "path", "language", *columns))

    @property
    def importing_nodes(self) -> DataFrame:
        return self.symbols(*IMPORTS)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: graph.import_edges(self.importing_nodes))

    @property
    def graph_nodes(self) -> DataFrame:
        return graph.graph_nodes(self.symbols(*GRAPH_SYMBOLS))
