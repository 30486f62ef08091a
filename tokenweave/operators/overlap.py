"""Overlap of generated sentences with the source text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.sources.shared import running_sums, written

#: Bytes of grams that one scan of the source looks for; more grams take more scans.
GRAM_BYTES = 64 << 20


def rejoined(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source): each text's sentences, every one followed by a space."""
    line = F.concat(F.array_join("words", " "), F.lit(" "))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("s")))), lambda x: x["s"]), "").alias("source"))


def chunks(runs: DataFrame, size: int, carry: int, order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """(chunk, source): all sentences in order, every one followed by a space, cut every size characters; each chunk begins with the carry characters before it.

    A gram of at most carry + 1 characters that occurs in the whole text, across texts too, occurs in a chunk, whatever the size. Places come
    from running sums over ranges, and a chunk is put together from the sentences' parts in it, so a row has at most size + carry characters.
    """
    if size < 1 or carry < 0:
        raise ValueError("a chunk has at least one character, and carry is not negative")
    lines = runs.select(*order, F.concat(F.array_join("words", " "), F.lit(" ")).alias("s")).withColumn("n", F.length("s").cast("bigint"))
    placed = running_sums(lines, list(order), {"n": "at"}, "chunk-places")
    last = F.expr(f"(at + n - 1 + {carry}) div {size}")
    total = placed.agg(F.max(F.col("at") + F.col("n"))).first()[0] or 0
    parts = placed.withColumn("chunk", F.explode(F.sequence(F.expr(f"at div {size}"), F.least(last, F.lit((total - 1) // size if total else 0).cast("bigint")))))
    lo = F.greatest(F.col("chunk") * size - carry, F.col("at"))
    hi = F.least((F.col("chunk") + 1) * size, F.col("at") + F.col("n"))
    piece = F.substring("s", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    found = parts.select("chunk", "at", piece.alias("piece")).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("x"))
    return found.select("chunk", F.array_join(F.transform("x", lambda e: e["piece"]), "").alias("source"))


def grams(words: Column, max_overlap_total: int, max_overlap_ratio: float) -> Column:
    """The word windows of a sentence that may not occur in the source, joined by spaces."""
    if max_overlap_total < -1:
        raise ValueError("max_overlap_total must be at least -1")
    n = F.size(words)
    over = F.least(F.lit(max_overlap_total), F.round(n * F.lit(float(max_overlap_ratio))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(n - over, F.lit(1)) - 1), lambda i: F.array_join(F.slice(words, i + 1, over + 1), " "))


def found(grams_: DataFrame, source: DataFrame) -> DataFrame:
    """The distinct grams (column gram) that are substrings of some source text.

    The grams go to the executors in blocks of bounded size, each as an Aho-Corasick automaton, so a block takes one pass
    over the source whatever its number of grams; without that library, a broadcast join on contains().
    """
    spark = grams_.sparkSession
    distinct = grams_.select("gram").distinct()
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return distinct.join(source, F.contains("source", "gram"), "left_semi")
    out, block, size = None, [], 0

    def scan(words: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(words)

        def hits(batches):
            import ahocorasick

            auto = ahocorasick.Automaton()
            for w in sent.value:
                if w:
                    auto.add_word(w, w)
            if len(auto):
                auto.make_automaton()
            seen = set()
            for b in batches:
                for t in b.column(0).to_pylist():
                    new = {w for _, w in auto.iter(t)} if t and len(auto) else set()
                    if t and "" in sent.value:
                        new.add("")
                    new -= seen
                    seen |= new
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], names=["gram"])

        return source.select("source").mapInArrow(hits, "gram string")

    for r in distinct.toLocalIterator():
        block.append(r.gram)
        size += 4 * len(r.gram) + 64
        if size > GRAM_BYTES:
            out = scan(block) if out is None else out.unionAll(scan(block))
            block, size = [], 0
    if block or out is None:
        out = scan(block) if out is None else out.unionAll(scan(block))
    return out.distinct()


def rejected_by_positions(candidates: DataFrame, texts: DataFrame, keys: list[str], max_overlap_total: int = 15, max_overlap_ratio: float = 0.7, words_col: str = "words") -> DataFrame:
    """What rejected gives, with the texts as words (positions) and without a bound on the number of windows."""
    exploded = written(candidates.select(*keys, F.explode(grams(F.col(words_col), max_overlap_total, max_overlap_ratio)).alias("gram")), "windows")
    return exploded.join(found_by_positions(exploded, texts), "gram", "left_semi").select(*keys).distinct()


def rejected(candidates: DataFrame, source: DataFrame, keys: list[str], max_overlap_total: int = 15, max_overlap_ratio: float = 0.7, words_col: str = "words") -> DataFrame:
    """The keys of candidates with a window in the source. A source without any text rejects nothing."""
    exploded = candidates.select(*keys, F.explode(grams(F.col(words_col), max_overlap_total, max_overlap_ratio)).alias("gram"))
    return exploded.join(found(exploded, source), "gram", "left_semi").select(*keys).distinct()


#: Characters of a chunk of the whole text.
CHUNK = 1 << 20


def rejected_in_corpus(candidates: DataFrame, runs: DataFrame, keys: list[str], max_overlap_total: int = 15, max_overlap_ratio: float = 0.7, words_col: str = "words", size: int = CHUNK, order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The keys of candidates with a window in the text of all runs in order, across texts; chunks carry what the longest window needs."""
    exploded = written(candidates.select(*keys, F.explode(grams(F.col(words_col), max_overlap_total, max_overlap_ratio)).alias("gram")), "grams")
    longest = exploded.agg(F.max(F.length("gram"))).first()[0] or 0
    return exploded.join(found(exploded, chunks(runs, size, max(0, longest - 1), order)), "gram", "left_semi").select(*keys).distinct()


# ---- by positions


def positions(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words): the words of each text, end to end."""
    return runs.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))


def found_by_positions(grams_: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct grams (column gram: words joined by single spaces) that are substrings of a text (words joined by single spaces), by equi-joins only.

    Of a gram of three words or more, all but the first and the last are whole words of the text: it is looked for where its rarest inner
    word stands, whose neighbours go along. A gram of two words lies on a pair of words, one ending and one beginning with it: pairs are
    found by the endings of their first words. One word is looked for among the parts of that length of the distinct words. Words must have no spaces.
    """
    wanted = written(grams_.select("gram").distinct().withColumn("g", F.split("gram", " ", -1)).withColumn("m", F.size("g")), "grams")
    texts = texts.select("words").where(F.size("words") > 0)
    seen = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = written(seen, "word-counts")

    # Three words and more. Inner words that the texts lack end it; of the others the rarest is the key.
    many = wanted.where("m >= 3")
    reach = max(0, (many.agg(F.max("m")).first()[0] or 0) - 1)
    inner = many.select("gram", "g", "m", F.posexplode(F.slice("g", F.lit(2), F.col("m") - 2)).alias("i", "word"))
    known = inner.join(seen, "word").groupBy("gram").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "word", "i")).alias("rare"), F.first("g").alias("g"), F.first("m").alias("m"))
    known = written(known.where("have = m - 2").select("gram", "g", "m", F.col("rare.word").alias("word"), (F.col("rare.i") + 1).alias("i")), "rare-words")
    keys = known.select("word").distinct()
    at = texts.select("words", F.posexplode("words").alias("p", "word")).join(keys, "word", "left_semi")
    before = F.greatest(F.col("p") - reach, F.lit(0))
    at = at.select("word", (F.col("p") - before).alias("o"), F.slice("words", before + 1, F.lit(2 * reach + 1)).alias("near"))
    met = known.join(at, "word").where((F.col("o") >= F.col("i")) & (F.size("near") - F.col("o") >= F.col("m") - F.col("i")))
    part = F.slice("near", F.col("o") - F.col("i") + 1, F.col("m"))
    same = F.slice(part, F.lit(2), F.col("m") - 2) == F.slice("g", F.lit(2), F.col("m") - 2)
    ends = F.endswith(F.get(part, F.lit(0)), F.get("g", F.lit(0))) & F.startswith(F.element_at(part, -1), F.element_at("g", -1))
    out = met.where(same & ends).select("gram")

    # Two words. The first ends a word of the texts; only pairs that begin with such a word are made distinct.
    two = wanted.where("m = 2").select("gram", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"), F.length(F.get("g", F.lit(0))).alias("la"))
    sizes = [r.la for r in two.select("la").distinct().orderBy("la").collect()]  # lengths of words
    if sizes:
        tails = seen.select(F.col("word").alias("x"), F.explode(F.array_distinct(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("word")), lambda n: F.right("word", n)))).alias("a"))
        tails = written(tails.join(two, "a").select("x", "gram", "b"), "word-tails")
        following = F.arrays_zip(F.col("words").alias("x"), F.slice("words", F.lit(2), F.size("words")).alias("y"))
        pairs = texts.select(F.inline(following).alias("x", "y")).join(tails.select("x").distinct(), "x", "left_semi").select("x", F.coalesce("y", F.lit("")).alias("y")).distinct()
        out = out.unionAll(tails.join(pairs, "x").where(F.startswith("y", "b")).select("gram"))

    # One word, or none: an empty gram is in any text. A word of the texts is found as it is, only others are looked for inside words.
    one = wanted.where("m = 1").select("gram", F.length("gram").alias("n"))
    words = seen.select(F.col("word").alias("gram"))
    out = out.unionAll(one.join(words, "gram", "left_semi").select("gram"))
    rest = written(one.join(words, "gram", "left_anti"), "parts-of-words")
    sizes = [r.n for r in rest.select("n").distinct().orderBy("n").collect()]
    if sizes:
        word = seen.select("word", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("word"))).alias("n"))
        parts = word.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1), lambda i: F.substring("word", i, F.col("n"))))).alias("gram"))
        out = out.unionAll(parts.join(rest, "gram", "left_semi"))
    return out.distinct()
