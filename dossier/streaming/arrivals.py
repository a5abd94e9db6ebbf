"""Requests that arrive as files: label only what is new, append, and go on after a stop.

The stream's own checkpoint remembers which request files were read; the anti-join with the
stored results also covers a batch that was cut off between writing and committing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import labelling
from dossier.schemas import REQUESTS

RESULTS = (
    "item string, response string, error string, attempts int, usage map<string,bigint>, "
    "batch_id bigint"
)


def label_arrivals(
    spark: SparkSession, requests_path: str, results_path: str, checkpoint_path: str,
    make_client: Callable, parallelism: int,
) -> None:
    """Process every request file not yet processed, then stop. All parts of a request must
    arrive together.

    A batch writes to a folder of its own and replaces it when repeated, so results are
    stored once.
    """
    incoming = spark.readStream.schema(REQUESTS).parquet(requests_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = stored_results(spark, results_path).where(F.col("batch_id") != batch_id)
        fresh = labelling.pending(batch.dropDuplicates(["item", "part"]), done, ["item"])
        answered = labelling.label_requests(fresh, make_client, parallelism)
        answered.write.mode("overwrite").parquet(f"{results_path.rstrip('/')}/batch_id={batch_id}")

    (
        incoming.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True).start().awaitTermination()
    )


def stored_results(spark: SparkSession, results_path: str) -> DataFrame:
    """All stored answers; an empty table before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RESULTS).parquet(results_path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)
