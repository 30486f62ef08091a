"""Walks that travel to a model which stays in its ranges.

The model becomes sorted files, one range of its states each, and nothing else is made of it: the tasks that walk look up
the states that they meet (``stored``). Where the tasks can't open the shared folder themselves, the walks take a join a step instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.operators.chain import BEGIN, END, counted_in_ranges, key_words, state_key
from tokenweave.operators.sampling import check_temperature
from tokenweave.operators.stored import GROUP_ROWS, HOT_STATES, Stored, files_of, readable, stored_walk, write_sorted  # noqa: F401
from tokenweave.sources.shared import new_path

#: Rows of a range.
RANGE_ROWS = 250_000


def ranges(model: DataFrame, k: int, temperature: float = 1.0, begin: str = BEGIN, end: str = END) -> Stored:
    """Write a model's rows in ranges of its states: one shuffle and one write of the model."""
    check_temperature(temperature)
    path = new_path(model.sparkSession, "ranges")
    write_sorted(model.select(state_key(F.col("state")).alias("key"), "follow", F.col("n").cast("bigint").alias("n")), path, file_rows=RANGE_ROWS)
    return Stored(files_of(model.sparkSession.read.parquet(path)), k, temperature, begin, end)


def ranges_of_runs(runs: DataFrame, k: int, parts: int, temperature: float = 1.0, words_col: str = "words") -> Stored:
    """ranges(train(runs, k), k, temperature) with one shuffle: the windows move into the ranges of their state and follower, and are counted there.

    Ranges are told by a sample, for which the windows are made twice. The rows of a frequent state may lie in several ranges.
    """
    check_temperature(temperature)
    path = new_path(runs.sparkSession, "ranges")
    counted_in_ranges(runs, k, parts, words_col).write.option("maxRecordsPerFile", RANGE_ROWS).option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    return Stored(files_of(runs.sparkSession.read.parquet(path)), k, temperature, BEGIN, END)


def travel_walk(requests: DataFrame, model: DataFrame | Stored, k: int, temperature: float, seed: int, max_steps: int, begin: str = BEGIN, end: str = END, rounds: list | None = None) -> DataFrame:
    """walk_id, attempt, words, status of all requests; model: transitions, or the ranges of them. rounds: as of stored_walk."""
    table = model if isinstance(model, Stored) else ranges(model, k, temperature, begin, end)
    if not readable(table.parts):
        from tokenweave.operators.walk import superstep_walk  # it knows this module as one of its ways

        rows = requests.sparkSession.read.parquet(*table.parts).select(key_words(F.col("key")).alias("state"), "follow", "n")
        return superstep_walk(requests, rows, k, table.temperature, seed, max_steps, table.begin, table.end)
    return stored_walk(requests, table, seed, max_steps, rounds)
