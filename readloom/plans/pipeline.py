"""The whole way from reads to consensus records."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import Settings
from readloom.operators import barcodes, cluster, consensus, evaluate
from readloom.session import Scratch, spread


class Run:
    """What a run makes. Each table is made when it is first asked for; those that several others need are written to the
    shared folder then: the counts, the assignments, the assigned reads and the consensus."""

    def __init__(self, reads: DataFrame, how: Settings):
        self.how = how
        self.scratch = Scratch(reads.sparkSession)
        self.found = barcodes.extracted(spread(reads), how)

    @cached_property
    def counts(self) -> DataFrame:
        return self.scratch.put(barcodes.barcode_counts(self.found))

    @cached_property
    def assignments(self) -> DataFrame:
        if self.how.max_mismatches == 0 and self.how.extraction.max_indels <= 0:
            own = cluster.numbered(self.counts).withColumn("centroid", F.col("barcode")).select("barcode", "centroid", "bcid")
        else:
            own = cluster.cluster(self.counts, self.how)
        return self.scratch.put(own)

    @cached_property
    def assigned(self) -> DataFrame:
        return self.scratch.put(barcodes.assigned(self.found, self.counts, self.assignments))

    @cached_property
    def consensus(self) -> DataFrame:
        return self.scratch.put(consensus.records(consensus.consensus(self.assigned, self.how), self.how))

    def passed(self) -> DataFrame:
        return self.consensus.where("bc is not null")

    def fastq_lines(self) -> DataFrame:
        return consensus.fastq_lines(self.consensus)

    def failed_lines(self) -> DataFrame:
        return consensus.failed_lines(self.consensus, self.assigned)

    def stats(self) -> DataFrame:
        return evaluate.read_stats(self.found, self.assigned)

    def rates(self) -> DataFrame:
        return consensus.error_rates(self.consensus)

    def diameters(self, least: int | None = None) -> DataFrame:
        """The largest clusters, of ``least`` reads or, by default, a hundred and 0.1% of all reads."""
        least = max(100, self.found.count() // 1000) if least is None else least
        return cluster.diameters(self.counts, self.assignments, least, self.how.max_mismatches)


def run(reads: DataFrame, how: Settings) -> Run:
    """Extract, count, cluster, assign and collapse ``reads`` (the columns of a FASTQ scan)."""
    return Run(reads, how)
