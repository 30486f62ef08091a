"""The model object: a transition table, its state size and temperature, and the text it came from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.functions.tokenize import LINES, PROSE, PROSE_NORMALIZED, Tokenizer, runs, word_array
from tokenweave.operators import algebra, chain, generate, overlap, sampling, walk


@dataclass(frozen=True)
class MarkovModel:
    """An immutable model; every operation returns a new one.

    transitions: state, follow, n; source: retained texts (column source), or None; tokenizer: also reads beginnings
    and joins generated words.
    """

    transitions: DataFrame
    state_size: int
    temperature: float = 1.0
    source: DataFrame | None = None
    tokenizer: Tokenizer = field(default=PROSE)
    #: The tokenized sentences that the model was trained on (key, pos, words), if they are retained.
    parsed_sentences: DataFrame | None = None

    def __post_init__(self):
        chain.check_state_size(self.state_size)
        sampling.check_temperature(self.temperature)

    # ---- training
    @staticmethod
    def from_text(docs: DataFrame, state_size: int = 2, *, text_col: str = "text", key: str = "doc_id", retain: bool = True, normalize: bool = False, temperature: float = 1.0, tokenizer: Tokenizer | None = None) -> MarkovModel:
        tok = tokenizer or (PROSE_NORMALIZED if normalize else PROSE)
        sentences = runs(docs, tok, text_col, (key,))
        model = chain.train(sentences, state_size)
        return MarkovModel(model, state_size, temperature, overlap.rejoined(sentences, key) if retain else None, tok, sentences if retain else None)

    @staticmethod
    def from_lines(docs: DataFrame, state_size: int = 2, **options) -> MarkovModel:
        return MarkovModel.from_text(docs, state_size, tokenizer=LINES, **options)

    @staticmethod
    def from_sentences(sentences: DataFrame, state_size: int = 2, *, words_col: str = "words", temperature: float = 1.0, keep_empty: bool = False) -> MarkovModel:
        """From token arrays; empty runs are dropped unless keep_empty. No source is retained."""
        some = sentences.where(F.col(words_col).isNotNull()) if keep_empty else sentences.where(F.size(words_col) > 0)
        return MarkovModel(chain.train(some, state_size, words_col), state_size, temperature)

    # ---- algebra
    def with_temperature(self, temperature: float) -> MarkovModel:
        return replace(self, temperature=temperature)

    def prune(self, min_count: int = 2) -> tuple[MarkovModel, DataFrame]:
        return replace(self, transitions=algebra.prune(self.transitions, min_count)), algebra.removed(self.transitions, min_count)

    @staticmethod
    def combine(models: list[MarkovModel], weights: list[float] | None = None) -> MarkovModel:
        """Weighted sum at temperature 1; the sources, and the parsed sentences, are kept if all models have theirs.

        Sentences of the combination have the number of their model (column part) before their key, which becomes a string.
        """
        if models and len({m.state_size for m in models}) > 1:
            raise ValueError("all models must have the same state size")
        table = algebra.combine([m.transitions for m in models], weights)
        source = None
        if all(m.source is not None for m in models):
            source = models[0].source.select("source")
            for m in models[1:]:
                source = source.unionAll(m.source.select("source"))
        parsed = None
        if all(m.parsed_sentences is not None for m in models):
            for i, m in enumerate(models):
                rows = m.parsed_sentences
                key = next(c for c in rows.columns if c not in ("part", "pos", "words"))
                part = F.concat(F.lit(f"{i}."), F.col("part")) if "part" in rows.columns else F.lit(str(i))
                rows = rows.select(part.alias("part"), F.col(key).cast("string").alias("key"), "pos", "words")
                parsed = rows if parsed is None else parsed.unionByName(rows)
        return MarkovModel(table, models[0].state_size, 1.0, source, models[0].tokenizer, parsed)

    def persist(self) -> MarkovModel:
        return replace(self, transitions=self.transitions.persist())

    def unpersist(self) -> None:
        self.transitions.unpersist()

    # ---- sampling
    @property
    def spark(self) -> SparkSession:
        return self.transitions.sparkSession

    def cdf(self) -> DataFrame:
        return sampling.cdf(self.transitions, self.temperature)

    def walk(self, n: int, seed: int = 0, **options) -> DataFrame:
        return walk.walk(walk.requests(self.spark, n), self.transitions, self.state_size, self.temperature, seed, **options)

    def register(self, name: str, max_steps: int = 1000) -> None:
        """Make name(first, n, seed) a table function of SQL: walks first to first + n - 1 from the beginning, as walk gives them."""
        walk.register(self.spark, name, self.transitions, self.state_size, self.temperature, max_steps)

    def walk_from(self, requests: DataFrame, seed: int = 0, **options) -> DataFrame:
        return walk.walk(requests, self.transitions, self.state_size, self.temperature, seed, **options)

    def _requests(self, n: int) -> DataFrame:
        return self.spark.range(n).select(F.col("id").alias("walk_id"), F.lit(None).cast("array<string>").alias("init"))

    def make_sentences(self, n: int = 1, seed: int = 0, init: list[str] | None = None, limits: generate.Limits = generate.Limits(), **options) -> DataFrame:
        req = self._requests(n)
        if init is not None:
            req = req.withColumn("init", F.array(*map(F.lit, init)))
        return generate.make_sentences(req, self.transitions, self.state_size, self.source, self.tokenizer.join, limits, self.temperature, seed, **options)

    def make_short_sentences(self, n: int = 1, max_chars: int = 140, min_chars: int = 0, seed: int = 0, **limits) -> DataFrame:
        return self.make_sentences(n, seed, limits=generate.Limits(max_chars=max_chars, min_chars=min_chars, **limits))

    def make_sentence_with_start(self, beginning: str, strict: bool = True, seed: int = 0, limits: generate.Limits = generate.Limits(), **options) -> DataFrame:
        words = self.spark.range(1).select(word_array(F.lit(beginning)).alias("w")).first().w if self.tokenizer in (PROSE, PROSE_NORMALIZED, LINES) else self.spark.range(1).select(self.tokenizer.words(F.lit(beginning)).alias("w")).first().w
        return generate.sentence_with_start(self.transitions, self.state_size, list(words), self.source, self.tokenizer.join, strict, limits, self.temperature, seed, **options)
