"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.sites import primer_hits


@F.udtf(returnType="strand string, start int, mm int", useArrow=True)
class Sites:
    """sites(seq, primer, max_mm): where a primer binds a sequence, on either strand, its last two bases exact.

    Null arguments give no row. Starts count from 0 on the given strand.
    """

    def eval(self, seq: str, primer: str, max_mm: int):
        if seq is not None and primer is not None and max_mm is not None:
            yield from primer_hits(seq, primer, max_mm)


def register(spark: SparkSession) -> None:
    """Make ``sites`` known to SQL: FROM reads, LATERAL sites(reads.seq, 'ACGT...', 1)."""
    spark.udtf.register("sites", Sites)
