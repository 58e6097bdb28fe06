"""Documents that arrive as files: an addition of this library over its batch operators.

Every micro-batch is one DataFrame that any batch operator takes.  A page that was seen before with the same content is left out, so a
file that arrives twice changes nothing; two pages of equal content both count.  The hashes are a table of their own beside the results, one row for
each page and content; of its Parquet files a batch reads the pages' keys and hashes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.sources.elements import PAGE


def page_hash(*columns: str) -> Column:
    """A hash of a page's elements, whatever order they come in: aggregate over the page."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256)


def page_hashes(elements: DataFrame) -> DataFrame:
    """(page, content_hash) of every page."""
    return elements.groupBy(*PAGE).agg(page_hash(*(c for c in elements.columns if c not in PAGE)).alias("content_hash"))


def new_pages(elements: DataFrame, seen: DataFrame | None) -> DataFrame:
    """(page, content_hash) of the pages that are not in ``seen`` (page, content_hash) with this content."""
    own = page_hashes(elements)
    return own if seen is None else own.join(seen.select(*PAGE, "content_hash"), [*PAGE, "content_hash"], "left_anti")


def run(spark: SparkSession, folder: str, schema: StructType, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of elements as they arrive in ``folder``, and appends ``operator``'s result for new pages to ``out``; returns when all that is there is done."""

    def batch(elements: DataFrame, number: int) -> None:
        try:
            seen = spark.read.parquet(f"{out}-hashes").where(F.col("batch") != number)
        except AnalysisException:  # the first batch
            seen = None
        fresh = new_pages(elements, seen)
        # a batch that is run again writes the same folders again
        fresh.write.mode("overwrite").parquet(f"{out}-hashes/batch={number}")
        made = operator(elements.join(fresh.select(*PAGE), PAGE, "left_semi"))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).parquet(folder)
    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
