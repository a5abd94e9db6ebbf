"""Requests, batch labelling through a user's function, and resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import batched, groupby
from operator import itemgetter
from uuid import uuid4

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossier.functions import paths
from dossier.operators.spread import listed_in_parts
from dossier.sources import stores

#: Answers of a batch that a task hands on.
EMIT_ROWS = 1000

ANSWER_FIELDS = [
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
]


def request_files(files: DataFrame) -> DataFrame:
    """Files a request may carry, with media type; other types are dropped.

    ``files(item, path, length)``.
    """
    kind = paths.media_type(paths.suffix(paths.file_name(F.col("path"))))
    return files.withColumn("media_type", kind).where("media_type is not null")


def request_table(
    prompts: DataFrame, files: DataFrame, key: str = "item", files_per_part: int = 1000
) -> DataFrame:
    """Requests as rows of at most ``files_per_part`` files: ``part`` 0, 1, ... of an item
    make one request, with the prompt in part 0.

    ``prompts(item, prompt, key)`` and ``files(key, path, length)``: the key may be the
    item or a folder that several items share, whose list is then made once. Items without
    files keep one row.
    """
    parts = listed_in_parts(
        request_files(files), [key], ["path"], F.struct("path", "media_type", "length"), "files",
        files_per_part,
    )
    return prompts.join(parts, key, "left").select(
        "item",
        F.when(F.coalesce("part", F.lit(0)) == 0, F.col("prompt")).otherwise("").alias("prompt"),
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        F.coalesce(F.transform("files", lambda f: f["path"]),
                   F.expr("array()").cast("array<string>")).alias("paths"),
        F.coalesce(F.size("files"), F.lit(0)).alias("n_files"),
        F.coalesce(
            F.aggregate("files", F.lit(0).cast("bigint"), lambda acc, f: acc + f["length"]),
            F.lit(0).cast("bigint"),
        ).alias("total_bytes"),
    )


class Asker:
    """One client and how it is asked; ``answered`` gives an item's answer fields for each item."""

    def __init__(
        self, make_client: Callable[[], Callable], attempts: int = 2, wait_seconds: float = 2.0,
        accepted: Sequence[str] | None = None, repeat_hint: str = "", system: str | None = None,
    ):
        self.make_client, self.attempts, self.wait_seconds = make_client, attempts, wait_seconds
        self.allowed = None if accepted is None else {label.casefold() for label in accepted}
        self.repeat_hint, self.system = repeat_hint, system

    def once(self, client: Callable, prompt: str, file_paths: list) -> tuple:
        error = None
        for attempt in range(1, self.attempts + 1):
            try:
                answer = client(prompt, file_paths) if self.system is None else client(prompt, file_paths, self.system)
                text, usage = answer if isinstance(answer, tuple) else (answer, None)
                return str(text).strip(), None, attempt, usage
            except Exception as caught:  # a failed call becomes a value of its row
                error = f"{type(caught).__name__}: {caught}"
                if attempt < self.attempts:
                    time.sleep(self.wait_seconds * attempt)
        return None, error, self.attempts, None

    def reply(self, client: Callable, prompt: str, file_paths: list) -> tuple:
        first = self.once(client, prompt, file_paths)
        if self.allowed is None or first[0] is None or first[0].strip("`\"' ").casefold() in self.allowed:
            return first
        again = self.once(client, prompt + self.repeat_hint, file_paths)
        return again[0], again[1], first[2] + again[2], again[3]


def _requests(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, str, list]]:
    """Item, whole prompt and all paths of each item, whose parts come one after another."""
    rows = (row for batch in batches for row in zip(batch["item"], batch["prompt"], batch["paths"]))
    for item, parts in groupby(rows, key=itemgetter(0)):
        prompt, file_paths = "", []
        for _, text, some in parts:
            prompt += text
            file_paths.extend(some)
        yield item, prompt, file_paths


def _placed(requests: DataFrame, parallelism: int) -> DataFrame:
    """Requests by a hash of the item, in order, so that a task that is run again sees the same rows."""
    return (
        requests.select("item", "part", "prompt", "paths").repartition(parallelism, "item")
        .sortWithinPartitions("item", "part")
    )


def label_requests(requests: DataFrame, make_client: Callable[[], Callable], parallelism: int, *args, **options) -> DataFrame:
    """Ask the user's function once per item; one client per partition.

    ``requests(item, part, prompt, paths)``; the parts of an item are put together in
    order, texts and paths alike. ``make_client()`` returns a function of (prompt, paths)
    that gives the answer text or a pair of text and usage counts. Options, also in this order:
    ``attempts``, ``wait_seconds``, ``accepted``, ``repeat_hint`` and ``system``. With ``system``, a text for
    all requests, the function is called as (prompt, paths, system). A raised error is
    retried after ``wait_seconds`` times the attempt and ends in ``error``. With
    ``accepted`` labels an unaccepted answer is asked once more with ``repeat_hint`` added.
    Usage belongs to its own item only.

    Write the result before using it twice: every evaluation makes the calls again, as
    ``stored_answers`` does not. An item's paths, not its files, meet in one task.
    """
    asker = Asker(make_client, *args, **options)
    schema = T.StructType([requests.schema["item"], *ANSWER_FIELDS])
    names = schema.fieldNames()

    def ask(batches):
        client = make_client()
        answers = ((item, *asker.reply(client, prompt, paths)) for item, prompt, paths in _requests(batches))
        for some in batched(answers, EMIT_ROWS):
            yield pd.DataFrame(some, columns=names)

    return _placed(requests, parallelism).mapInPandas(ask, schema)


def stored_answers(
    requests: DataFrame, make_client: Callable[[], Callable], parallelism: int, path: str,
    bucket_items: int = 500, **options,
) -> DataFrame:
    """``label_requests`` in one pass that stores answers as they come.

    ``path`` is a folder that all executors share. Every task stores the answers of each
    ``bucket_items`` items as one file, which is there whole or not at all; its name follows from
    the run, the task's partition and the bucket's place there, and a task that is run again sees
    the same items in the same order. So it skips the buckets stored already, and a lost executor
    costs one bucket's calls of each of its tasks at most; two attempts at once leave one copy. Items that the folder holds from earlier
    runs are not asked again, so a run that was broken off goes on where it stopped.

    Returns the stored answers of the items in ``requests``. Errors are stored like answers;
    remove their rows to ask again.
    """
    spark = requests.sparkSession
    kind = T.StructType([requests.schema["item"], *ANSWER_FIELDS])
    arrow_kind = to_arrow_schema(kind)
    asker, run = Asker(make_client, **options), uuid4().hex
    stores.make_folder(path)
    stored = spark.read.schema(kind).parquet(path)

    def ask(batches):
        number = TaskContext.get().partitionId()
        there, client, n = stores.names_in(path), None, 0
        for k, bucket in enumerate(batched(_requests(batches), bucket_items)):
            name = f"answers-{run}-{number:05d}-{k:06d}.parquet"
            if name not in there:
                client = client or make_client()
                rows = [(item, *asker.reply(client, prompt, paths)) for item, prompt, paths in bucket]
                columns = dict(zip(kind.fieldNames(), zip(*rows, strict=True), strict=True))
                columns["usage"] = [None if u is None else list(u.items()) for u in columns["usage"]]
                table = pa.table({f.name: pa.array(columns[f.name], f.type) for f in arrow_kind}, arrow_kind)
                stores.publish(path, name, lambda stream, table=table: pq.write_table(table, stream))
            n += len(bucket)
        yield pd.DataFrame({"n": [n]})

    left = pending(requests, stored, ["item"]) if stores.names_in(path) else requests
    _placed(left, parallelism).mapInPandas(ask, "n long").agg(F.sum("n")).collect()
    spark.catalog.refreshByPath(path)
    items = requests.select("item").distinct()
    return spark.read.schema(kind).parquet(path).join(items, "item", "left_semi")


def response_log(requests: DataFrame, results: DataFrame, run: Mapping[str, str]) -> DataFrame:
    """What was sent and what came back, one row per request part, for an append-only log.

    ``run`` gives the constant columns (time stamp, model, settings).
    """
    constants = [F.lit(value).alias(name) for name, value in run.items()]
    answered = results.select(
        "item", "sap", "teamcenter", "name", "matched_folder", "raw_response",
        F.nullif("label", F.lit("")).alias("canonical_label"), "status",
        F.col("error_message").alias("error"),
    )
    sent = requests.select("item", "part", "prompt", F.col("paths").alias("file_paths"))
    return sent.join(answered, "item").select(*constants, "*")


def pending(requests: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests without a stored result."""
    return requests.join(done.select(*keys).distinct(), list(keys), "left_anti")


def usage_by_model(answers: DataFrame) -> DataFrame:
    """Token counts per model and kind."""
    return answers.select("model", F.explode("usage").alias("kind", "tokens")).groupBy(
        "model", "kind"
    ).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
