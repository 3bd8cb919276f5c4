"""A stored series that grows by whole dates.

New dates need nothing of the old ones but what lies at their edge: for each key the last
price and the number of returns so far, and the last sample for each sampling period. These
few rows are written with every part, so appending reads the new ticks and the edge of the
last part, however long the series has become.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.grid import pad_session
from ..operators.ordered import minute_axis, number_rows, stored_beside
from ..operators.returns import THRESHOLD, clip_returns, log_returns
from ..operators.variance import SPARSE_GRID, last_samples, sparse_ends, sparse_rv_of_ends
from ..session import stage


class SeriesStore:
    """Padded prices, returns and sparse variances under ``root``, one folder ``part=n`` per append.

    ``edges`` is written last: a part counts from then on, and an append that fails before
    it is done again from the start. One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: Sequence[str] = (),
        threshold: float = THRESHOLD,
        overnight: str = "null",
        periods: Iterable[int] = SPARSE_GRID,
    ):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.threshold, self.overnight, self.periods = threshold, overnight, sorted(set(periods))

    def parts(self) -> int:
        """Number of parts that are complete."""
        try:
            last = self._table("edges").agg(F.max("part")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return 0 if last is None else last + 1

    def append(self, ticks: DataFrame) -> int:
        """Add the ticks of later dates; gives the number of the part.

        Ticks have ``index_date``, ``index_time`` and ``last_price``. A date that is not
        after the last one stored for its key is refused. The first part of a key should
        hold a known session price: a gap at the start of a series is filled from the part
        it lies in.
        """
        part, keys, axis = self.parts(), self.keys, minute_axis(self.keys)
        edges = samples = None
        if part:
            edges, samples = self._part("edges", part - 1), self._part("samples", part - 1)
        ticks = stage(ticks.select(*keys, "index_date", "index_time", "last_price"), "ticks")
        if edges is not None:
            firsts = ticks.groupBy(*keys).agg(F.min("index_date").alias("first"))
            late = stored_beside(firsts, edges, {"stored": "last_date"}, keys).filter("first <= stored").first()
            if late:
                raise ValueError(f"dates up to {late['stored']} are stored, {late['first']} cannot be added")
        padded = stage(pad_session(ticks, keys=keys, previous=edges), "padded")
        moved = clip_returns(log_returns(padded, overnight=self.overnight, axis=axis, previous=edges), self.threshold)
        numbered = number_rows(stage(moved, "moved"), "no_returns", axis, F.col("log_ret").isNotNull())
        if edges is not None:
            numbered = stored_beside(numbered, edges, {"_stored": "no_returns"}, keys)
            numbered = numbered.withColumn("no_returns", F.col("no_returns") + F.coalesce("_stored", F.lit(0))).drop("_stored")
        ends = stage(sparse_ends(padded, self.periods, keys=keys), "ends")
        self._write(numbered, "returns", part)
        self._write(sparse_rv_of_ends(ends, keys=keys, carried=samples), "sparse", part)
        self._write(last_samples(ends, keys, samples), "samples", part)
        at = F.struct("index_date", "index_time")
        latest = self._part("returns", part).groupBy(*keys).agg(
            F.max("index_date").alias("last_date"),
            F.max_by("last_price", at).alias("last_price"),
            F.max("no_returns").alias("no_returns"),
        )
        if edges is not None:
            both = latest.unionByName(edges.select(*latest.columns)).groupBy(*keys)
            latest = both.agg(
                F.max_by("last_price", "last_date").alias("last_price"),
                F.max("no_returns").alias("no_returns"),
                F.max("last_date").alias("last_date"),
            )
        self._write(latest.filter("last_date IS NOT NULL"), "edges", part)
        return part

    def returns(self) -> DataFrame:
        """``(keys, index_date, index_time, last_price, log_ret, no_returns)`` of all dates."""
        return self._complete("returns")

    def every_kth_return(self, k: int) -> DataFrame:
        """Known returns 1, 1+k, 1+2k ... of each key, by their stored numbers."""
        return self.returns().filter(F.col("log_ret").isNotNull() & ((F.col("no_returns") - 1) % k == 0))

    def sparse_rv(self) -> DataFrame:
        """``(keys, s_grid, index_date, rv_sparse, rv_sparse_an)`` of all dates."""
        return self._complete("sparse")

    def _complete(self, name: str) -> DataFrame:
        return self._table(name).filter(F.col("part") < self.parts()).drop("part")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _part(self, name: str, part: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/part={part}")

    def _write(self, df: DataFrame, name: str, part: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/part={part}")
