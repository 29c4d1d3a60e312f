"""Parallelism of inputs whose rows are heavy."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A task that parses JSON or walks trees gets about so many rows: seconds of work.
ROWS_PER_TASK = 100_000


def spread_scan(scan: DataFrame) -> DataFrame:
    """Deal a file scan to at least one partition per core, and to more the more rows it has.

    JSON parsing and tree walking cost far more per row than a shuffle of the
    row.  The splits of a scan say little about its rows: a small file is one, and
    a large one has as many as there are cores, of which those without the start
    of a row group are empty.  So the rows are counted, which Parquet answers from
    its footers.  A task then takes as long on a large table as on a small one.
    """
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS_PER_TASK))
    return scan.repartition(wanted)
