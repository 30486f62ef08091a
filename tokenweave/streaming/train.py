"""Training on streams: counts are sums, so a stream's model is the batch model of all that arrived."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenweave.functions.tokenize import PROSE, Tokenizer
from tokenweave.operators import algebra, chain


def stream_counts(docs: DataFrame, k: int, tokenizer: Tokenizer = PROSE, text_col: str = "text") -> DataFrame:
    """A streaming model of a streaming table of texts; write it in update or complete mode."""
    sentences = docs.select(F.explode(tokenizer.split(F.col(text_col))).alias("s")).select(tokenizer.words(F.col("s")).alias("words")).where(F.size("words") > 0)
    return chain.train(sentences, k)


def sentence_counts(sentences: DataFrame, k: int, words_col: str = "words") -> DataFrame:
    """The same for a stream of token arrays."""
    return chain.train(sentences.where(F.size(words_col) > 0), k, words_col)


def merge_batch(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The model after one micro-batch, for foreachBatch."""
    return batch if old is None else algebra.combine([old, batch])


MODEL = "state array<string>, follow string, n bigint"
LEDGER = "batch bigint, base boolean"


class Trained:
    """The counts of a stream's batches in a folder, each batch once, however often it is replayed.

    ``counts/batch=N`` has the counts of batch N, and ``base/upto=N`` those of all batches up to N. The ledger names what counts: a batch
    is entered after its counts are written. A batch that is replayed before that writes the same folder again, and after that is
    left out, so a restart at any place adds nothing and loses nothing. The stream's own checkpoint stays Spark's.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ledger(self) -> tuple[int, list[int]]:
        """The last batch of the newest base (-1: none), and the batches after it."""
        try:
            rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").collect()  # one row a batch since the stream began
        except AnalysisException:
            return -1, []
        upto = max((r.batch for r in rows if r.base), default=-1)
        return upto, sorted({r.batch for r in rows if not r.base and r.batch > upto})

    def enter(self, batch: int, base: bool) -> None:
        self.spark.createDataFrame([(batch, base)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def add(self, counts: DataFrame, batch: int) -> None:
        """The counts of a batch; nothing if it has been entered."""
        upto, after = self.ledger()
        if batch <= upto or batch in after:
            return
        counts.select("state", "follow", F.col("n").cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")
        self.enter(batch, False)

    def model(self) -> DataFrame:
        """The model of all batches entered."""
        upto, after = self.ledger()
        names = [f"{self.path}/base/upto={upto}"] * (upto >= 0) + [f"{self.path}/counts/batch={b}" for b in after]
        if not names:
            return self.spark.createDataFrame([], MODEL)
        return algebra.combine([self.spark.read.schema(MODEL).parquet(*names)])

    def compact(self) -> None:
        """One base instead of the batches so far."""
        upto, after = self.ledger()
        if after:
            self.model().write.mode("overwrite").parquet(f"{self.path}/base/upto={after[-1]}")
            self.enter(after[-1], True)


def train_durably(docs: DataFrame, path: str, k: int, checkpoint: str, tokenizer: Tokenizer = PROSE, text_col: str = "text", compact_every: int = 0, **trigger) -> StreamingQuery:
    """Start a query that adds a streaming table of texts to the counts in path; compact_every: batches after which they are made one."""

    def add(batch: DataFrame, number: int) -> None:
        to = Trained(batch.sparkSession, path)
        to.add(stream_counts(batch, k, tokenizer, text_col), number)
        if compact_every and (number + 1) % compact_every == 0:
            to.compact()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
