"""Duplicates of sorted pairs that arrive bit by bit.

Pairs come in the order of (chrom1, chrom2, pos1), so the greatest place seen, the
frontier, works as a watermark over positions: nothing that is still to come is within
reach of a row more than max_mismatch before it, or in another block.  A micro-batch is
marked together with the rows that are still open, by the operator that marks whole
tables, and closes what the frontier has passed:

- transitive clusters are given out whole when none of their rows is within reach of the
  frontier; until then they are kept open, as a later row may join two of them;
- greedy outcomes are final at once; of the rows only the kept ones within reach of the
  frontier are held.

Open rows lie as Parquet in the folder, which all machines share, beside the outcomes.  A
batch reads the state that the one before it committed and writes its own under its
number, so a batch that is run again after a failure writes the same rows again.

Defined results: rows without a place (unmapped, or with a null strand or position) are
given out with their batch; a row before the frontier of earlier batches is an error, the
order within a batch is of no account; batches without rows change nothing; rows that
repeat are duplicates like others; before any batch there are no results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactweave.functions.graph import written
from contactweave.model import NotSorted
from contactweave.operators.dedup import mapped, mark_duplicates

PLACE = ("chrom1", "chrom2", "pos1")


def placed() -> Column:
    known = [F.col(c).isNotNull() for c in ("pos1", "pos2", "strand1", "strand2")]
    return F.coalesce(mapped(), F.lit(False)) & known[0] & known[1] & known[2] & known[3]


@dataclass
class DuplicateStream:
    """The outcomes of a stream below ``folder``.  ``order`` says which row of a cluster
    comes first, as in ``mark_duplicates``; greedy clusters need it to grow with the
    stream."""

    folder: str
    max_mismatch: int = 3
    metric: str = "max"
    clustering: str = "transitive"
    extra_pairs: list[tuple[str, str]] | None = None
    order: str = "seq"

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose state is committed and held."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/frontier")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n) for n in names if files.exists(done(f"{self.folder}/frontier/{n}/_SUCCESS")))

    def forget(self, spark: SparkSession, batch: int) -> None:
        for part in ("frontier", "open"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}/{batch}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def marked(self, rows: DataFrame) -> DataFrame:
        return written(mark_duplicates(rows, self.max_mismatch, self.metric, self.clustering, self.extra_pairs, self.order), "marked")

    def frontier(self, batch: DataFrame, before: Row | None) -> Row:
        """(chrom1, chrom2, pos1, last): the greatest place, and ``order`` value, of rows
        with a place up to this batch; nulls if there are none."""
        at = F.struct(*PLACE)
        seen = batch.where(placed()).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.min(self.order).alias("first"), F.max(self.order).alias("last")).first()
        if seen["low"] is None:
            return before or Row(chrom1=None, chrom2=None, pos1=None, last=None)
        if before and before["chrom1"] is not None:
            # Names are compared as bytes, as sorting does.
            key = lambda r: (r["chrom1"].encode(), r["chrom2"].encode(), r["pos1"])
            if key(seen["low"]) < key(before):
                raise NotSorted("a pair at {} {} {} comes after one at {} {} {}".format(*(r[c] for r in (seen["low"], before) for c in PLACE)))
            if self.clustering == "greedy" and seen["first"] < before["last"]:
                raise NotSorted(f"{self.order} {seen['first']} comes after {before['last']}")
            return Row(**seen["high"].asDict(), last=max(seen["last"], before["last"]))
        return Row(**seen["high"].asDict(), last=seen["last"])

    def take(self, batch: DataFrame, number: int) -> None:
        """Mark one micro-batch; a function for ``foreachBatch``."""
        spark = batch.sparkSession
        held = [n for n in self.batches(spark) if n < number]
        before = spark.read.parquet(f"{self.folder}/frontier/{held[-1]}").first() if held else None
        # Written, as the source would else be read by every job below.
        batch = written(batch, "batch")
        columns = batch.columns
        front = self.frontier(batch, before)
        rows = batch.withColumn("_carried", F.lit(False))
        if held:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{self.folder}/open/{held[-1]}").withColumn("_carried", F.lit(True)))
        rows = self.marked(rows)
        near = F.lit(False)
        if front["chrom1"] is not None:
            near = placed() & (F.col("chrom1") == front["chrom1"]) & (F.col("chrom2") == front["chrom2"]) & (F.col("pos1") >= front["pos1"] - self.max_mismatch)
        if self.clustering == "greedy":
            done, still = rows.where("NOT _carried"), rows.where(near & (F.col("outcome") == "kept"))
        else:
            rows = rows.withColumn("_cluster", F.coalesce("parent", self.order))
            growing = rows.where(near).select(F.col("_cluster").alias("_growing")).distinct()
            met = F.col("_cluster") == F.col("_growing")
            done, still = rows.join(growing, met, "left_anti"), rows.join(growing, met, "left_semi")
        done.select(*columns, "outcome", "parent").write.mode("overwrite").parquet(f"{self.folder}/outcomes/{number}")
        still.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/open/{number}")
        # The last write commits the batch; the state before it stays for another try.
        state = spark.createDataFrame([front], "chrom1 string, chrom2 string, pos1 long, last long")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/frontier/{number}")
        for old in held[:-1]:
            self.forget(spark, old)

    def start(self, pairs: DataFrame) -> StreamingQuery:
        """Take all that a streaming DataFrame has now, from where the last start ended.  Its
        source must hand out files in the order of the pairs."""
        return pairs.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def open_rows(self, spark: SparkSession) -> DataFrame | None:
        """Rows that wait for later ones (transitive), or that later ones are compared with
        (greedy)."""
        held = self.batches(spark)
        return spark.read.parquet(f"{self.folder}/open/{held[-1]}") if held else None

    def finish(self, spark: SparkSession) -> None:
        """Close all clusters at the end of the stream."""
        rows = self.open_rows(spark)
        if rows is not None and self.clustering != "greedy":
            self.marked(rows).write.mode("overwrite").parquet(f"{self.folder}/outcomes/end")

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """All rows given out so far, with outcome and parent."""
        return spark.read.parquet(f"{self.folder}/outcomes/*")
