"""Training: windows over runs, counts, and lookups in the counted model.

A model is a table ``state array<string>, follow string, n bigint`` with one row a transition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.sources.shared import running_sums, written

#: The sentinels around a run.
BEGIN, END = "___BEGIN__", "___END__"


def begin_state(k: int) -> Column:
    return F.array_repeat(F.lit(BEGIN), k)


def check_state_size(k: int) -> None:
    if k < 1:
        raise ValueError("state size must be at least 1")


def _slots(k: int) -> list[str]:
    return [f"__w{j}" for j in range(k + 1)]


def _windows(runs: DataFrame, k: int, words_col: str, keep: list[str]) -> DataFrame:
    """keep, i and the k + 1 words of each window of the runs, one column a word: as many windows as a run has words, and one for the end.

    Shifted slices of a run zip into its windows, so all of it is generated code, without a lambda or an array a window.
    """
    check_state_size(k)
    items = F.concat(begin_state(k), F.col(words_col), F.array(F.lit(END)))
    padded = runs.select(*keep, items.alias("__x"))
    n = F.size("__x") - k
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1), *[F.slice("__x", j + 1, n) for j in range(k + 1)])
    return padded.where("__x is not null").select(*keep, F.inline(zipped).alias("i", *_slots(k)))


def _state(k: int) -> Column:
    return F.array(*_slots(k)[:k])


def transitions(runs: DataFrame, k: int, words_col: str = "words") -> DataFrame:
    """All columns of runs but the words, and i, state, follow; one row a transition. Null runs have none."""
    keep = [c for c in runs.columns if c != words_col]
    return _windows(runs, k, words_col, keep).select(*keep, "i", _state(k).alias("state"), F.col(_slots(k)[k]).alias("follow"))


def _odd(words: Column) -> Column:
    """Whether a word holds a space or a backslash, or is null."""
    plain = F.array_join(words, "", "\\")
    return F.contains(plain, F.lit(" ")) | F.contains(plain, F.lit("\\"))


def _code(w: Column) -> Column:
    """A word as it stands in a key of several: without spaces, null as a code of its own."""
    return F.coalesce(F.replace(F.replace(w, F.lit("\\"), F.lit("\\b")), F.lit(" "), F.lit("\\s")), F.lit("\\n"))


def _decode(w: Column) -> Column:
    """The word that _code made w of. Each backslash is followed by b, s or n, so one after the other can be undone."""
    return F.when(w != "\\n", F.replace(F.replace(w, F.lit("\\s"), F.lit(" ")), F.lit("\\b"), F.lit("\\")))


def joined(state: Column) -> Column:
    """A state as one text, from which split_state has it back."""
    return F.array_join(F.when(_odd(state), F.transform(state, _code)).otherwise(state), " ")


def split_state(key: Column) -> Column:
    words = F.split(key, " ", -1)
    return F.when(F.contains(key, F.lit("\\")), F.transform(words, _decode)).otherwise(words)


def _counted(runs: DataFrame, k: int, words_col: str, first: tuple[str, ...] = (), states: DataFrame | None = None) -> DataFrame:
    """key, n and, with first, first: how often each window occurs, by its words joined by spaces. One short text a window makes the shuffle far smaller than a column a word."""
    more = [F.min(F.struct(*first, "i")).alias("first")] if first else []
    windows = _windows(runs.withColumn("__odd", _odd(F.col(words_col))), k, words_col, [*first, "__odd"])
    if states is not None:
        slots = _slots(k)[:k]
        wanted = states.where(F.size("state") == k).select(*[F.col("state")[j].alias(f"__s{j}") for j in range(k)])
        windows = windows.join(wanted, reduce(Column.__and__, [F.col(w).eqNullSafe(F.col(f"__s{j}")) for j, w in enumerate(slots)]), "left_semi")
    key = F.when(F.col("__odd"), F.concat_ws(" ", *[_code(F.col(w)) for w in _slots(k)])).otherwise(F.concat_ws(" ", *_slots(k)))
    return windows.select(*first, "i", key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *more)


def train(runs: DataFrame, k: int, words_col: str = "words", first: tuple[str, ...] = (), states: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """The model of runs: count(transitions(runs, k)), but counted by the words of a window as one text; the states become arrays after the shuffle.

    With first, the names of columns that order the runs, the model also has first, where each transition was seen first.
    With states (column state), it is the part of the model that begins with one of them: windows of other states are left out before they are counted.
    With keyed, it also has key: joined(state), which is part of the window's text and needn't be made of the state again.
    """
    odd = F.contains("key", F.lit("\\"))
    state, last = F.split(F.substring_index("key", " ", k), " ", -1), F.substring_index("key", " ", -1)
    state = F.when(odd, F.array(*[_decode(F.get(state, F.lit(j))) for j in range(k)])).otherwise(state)
    follow = F.when(odd, _decode(last)).otherwise(last)
    return _counted(runs, k, words_col, first, states).select(state.alias("state"), follow.alias("follow"), "n", *[c for c in ("first",) if first], *([F.substring_index("key", " ", k).alias("key")] if keyed else []))


def keyed_transitions(rows: DataFrame, k: int, key: str, order: list[str], token: str) -> DataFrame:
    """state, follow of token sequences given as rows: per key in the given order, by lagged columns."""
    check_state_size(k)
    w = Window.partitionBy(key).orderBy(*order)
    lags = [F.lag(token, j, BEGIN).over(w) for j in range(k, 0, -1)]
    inner = rows.select(F.array(*lags).alias("state"), F.col(token).alias("follow"))
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    tail = rows.select(F.row_number().over(last).alias("r"), F.array(*[F.lag(token, j, BEGIN).over(w) for j in range(k - 1, 0, -1)], F.col(token)).alias("state"))
    return inner.unionByName(tail.where("r = 1").select("state", F.lit(END).alias("follow")))


def count(pairs: DataFrame) -> DataFrame:
    """The model of transitions: partial counts before the one shuffle, so frequent states are no hot keys."""
    return pairs.groupBy("state", "follow").agg(F.count(F.lit(1)).alias("n"))


def nested(model: DataFrame) -> DataFrame:
    """(state, followers array<struct<follow, n>> in order of follow, total)."""
    named = dict(model.dtypes)["state"] == "array<string>"
    rows = model.groupBy((joined(F.col("state")) if named else F.col("state")).alias("key")).agg(F.array_sort(F.collect_list(F.struct("follow", "n"))).alias("followers"), F.sum("n").alias("total"))
    return rows.select((split_state(F.col("key")) if named else F.col("key")).alias("state"), "followers", "total")


def follower_map(model: DataFrame) -> DataFrame:
    """(state, followers map<follow, n>)."""
    return nested(model).select("state", F.map_from_entries("followers").alias("followers"))


def lookup(model: DataFrame, state: list[str], follow: str | None = None) -> DataFrame:
    """The transitions of one state (and follower); empty if unknown."""
    out = model.where(F.col("state") == F.array(*map(F.lit, state)))
    return out if follow is None else out.where(F.col("follow") == follow)


def shift(state: Column, word: Column, k: int) -> Column:
    """The state without its oldest word and with the new one."""
    return F.array_append(F.slice(state, 2, k - 1), word) if k > 1 else F.array(word)


def state_text(state: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(state, ", "), F.lit(")"))


def state_key(state: Column) -> Column:
    """A state as one text: its words joined by spaces, with spaces and backslashes inside words escaped, so that different states have different keys.

    Words without either, such as all of the tokenizers here, stay as they are; the key of a state's first words and a space begins its key.
    """
    return F.array_join(F.transform(state, lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\s"))), " ")


def key_words(key: Column) -> Column:
    """The state of a state_key. Each backslash in it is followed by another or by an s, so pairs are taken away first."""
    words = F.split(key, " ", -1)
    word = lambda w: F.replace(F.replace(F.replace(w, F.lit("\\\\"), F.lit("\\b")), F.lit("\\s"), F.lit(" ")), F.lit("\\b"), F.lit("\\"))
    return F.when(F.contains(key, F.lit("\\")), F.transform(words, word)).otherwise(words)


def counted_in_ranges(runs: DataFrame, k: int, parts: int, words_col: str = "words") -> DataFrame:
    """(key, follow, n): the model of runs with the states' keys, in parts ranges of (key, follow), sorted; the windows move once, and are counted where they come to."""
    slots = _slots(k)
    windows = _windows(runs.withColumn("__odd", _odd(F.col(words_col))), k, words_col, ["__odd"])
    key = F.when(F.col("__odd"), state_key(_state(k))).otherwise(F.concat_ws(" ", *slots[:k]))
    ranged = windows.select(key.alias("key"), F.col(slots[k]).alias("follow")).repartitionByRange(parts, "key", "follow")
    return ranged.groupBy("key", "follow").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("key", "follow")


def escaped(word: str) -> str:
    """A word as it stands in a state's key."""
    return word.replace("\\", "\\\\").replace(" ", "\\s")


def totals(model: DataFrame) -> DataFrame:
    key = joined(F.col("state")) if dict(model.dtypes)["state"] == "array<string>" else F.col("state")
    states = model.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t"))  # one plain count, no row twice for a distinct one
    return states.agg(F.count(F.lit(1)).alias("n_states"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_pairs"), F.sum("t").alias("n_transitions"))


def _coded_slots(k: int) -> list[Column]:
    """The words of a window as they stand in a key; of runs without odd words (column __odd) they are the words."""
    return [F.when(F.col("__odd"), _code(F.col(w))).otherwise(F.col(w)) for w in _slots(k)]


def totals_upto(runs: DataFrame, k: int, parts: int, words_col: str = "words") -> DataFrame:
    """(k, n_states, n_pairs, n_transitions) of the models of order 1 to k: totals(train(runs, j)) of each, with one shuffle of windows for all.

    The windows of order k move by their last two words, so that the shorter ones that end them, which are the windows of the lower orders, are
    there as well. States of order j + 1 are the windows of order j that end with a word of a run, and the beginning.
    """
    check_state_size(k)
    texts = runs.withColumns({"__odd": _odd(F.col(words_col)), "__m": F.size(words_col)})
    words = _coded_slots(k)
    windows = _windows(texts, k, words_col, ["__odd", "__m"]).select(
        F.concat_ws(" ", *words[: k - 1]).alias("head"), F.concat_ws(" ", *words[k - 1 :]).alias("tail"), (F.col("i") < F.col("__m")).alias("real")
    )
    level = windows.repartition(parts, "tail").groupBy("tail", "head").agg(F.count(F.lit(1)).alias("n"), F.max("real").alias("real"))
    sums: list[str] = []
    for j in range(k, 0, -1):  # level: the windows of order j, and the sums of those above
        begun = (F.col("head") == " ".join([BEGIN] * (j - 1))) & (F.col("tail") == f"{BEGIN} {BEGIN}")
        level = level.withColumns({f"p{j}": F.lit(1).cast("bigint"), f"s{j + 1}": (F.col("real") & ~begun).cast("bigint")})
        sums += [f"p{j}", f"s{j + 1}"]
        if j > 1:
            level = level.withColumn("head", F.substring_index("head", " ", 2 - j) if j > 2 else F.lit(""))
            by = ["tail", "head"]
        else:
            level, by = level.select(F.substring_index("tail", " ", -1).alias("word"), "real", "n", *sums), ["word"]
        level = level.groupBy(*by).agg(F.sum("n").alias("n"), F.max("real").alias("real"), *[F.sum(c).alias(c) for c in sums])
    level = level.withColumn("s1", (F.col("real") & (F.col("word") != BEGIN)).cast("bigint"))
    whole = level.agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*sums, "s1"]])
    first = F.when(F.col("n").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")  # the state of the beginning
    rows = [F.struct(F.lit(j).alias("k"), (F.col(f"s{j}") + first).alias("n_states"), F.col(f"p{j}").alias("n_pairs"), F.col("n").alias("n_transitions")) for j in range(1, k + 1)]
    return whole.select(F.inline(F.array(*rows)))


# ---- dictionary-encoded forms -----------------------------------------------------------------------------------


def ranked(df: DataFrame, col: str, out: str) -> DataFrame:
    """df (distinct in col) with the 0-based rank of col, without one task sorting all: ranks by range, then offsets."""
    numbered = df.repartitionByRange(col).sortWithinPartitions(col).withColumn("__i", F.monotonically_increasing_id())  # partition, and row in its 33 lower bits
    places = {"__p": F.shiftright("__i", 33), "__r": F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))}
    local = written(numbered.withColumns(places).drop("__i"), "ranked")  # partition numbers differ between two runs of a plan
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return local.join(F.broadcast(before), "__p").withColumn(out, (F.col("__b") + F.col("__r")).cast("bigint")).drop("__p", "__r", "__b")


def vocabulary(model: DataFrame) -> DataFrame:
    """(word, word_id): all words of the model, ids in order of the words."""
    words = model.select(F.explode(F.array_append("state", F.col("follow"))).alias("word")).distinct()
    return ranked(words, "word", "word_id")


def vocabulary_of_runs(runs: DataFrame, words_col: str = "words") -> DataFrame:
    """vocabulary(train(runs, k)) of any k, without training: all words of the runs, and the sentinels around them."""
    words = runs.where(F.col(words_col).isNotNull()).select(F.explode(F.concat(words_col, F.array(F.lit(BEGIN), F.lit(END)))).alias("word")).distinct()
    return ranked(words, "word", "word_id")


def count_first(pairs: DataFrame, order: tuple[str, ...] = ("doc_id", "pos", "i")) -> DataFrame:
    """The model with first, where each transition was seen first: a minimum that is carried along with the count, so it costs no shuffle of its own."""
    return pairs.groupBy("state", "follow").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def followers_by_sight(model: DataFrame) -> DataFrame:
    """(state, followers array<struct<follow, n>>, first): followers in the order in which they were first seen, of a model with first."""
    seen = model.groupBy(joined(F.col("state")).alias("key")).agg(F.array_sort(F.collect_list(F.struct("first", "follow", "n"))).alias("x"))
    seen = seen.select(split_state(F.col("key")).alias("state"), "x", F.get("x", F.lit(0))["first"].alias("first"))  # the first of the first seen
    return seen.select("state", F.transform("x", lambda e: F.struct(e["follow"].alias("follow"), e["n"].alias("n"))).alias("followers"), "first")


def sight_bits(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> tuple[int, int] | None:
    """Bits of a sentence's place in its text and of a window's in its sentence, if these and the text's number fit into one integer; else None.

    A text has no more sentences, nor a sentence more words, than the text has bytes.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        return None
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("m"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.octet_length(text_col)).alias("size")).first()
    each = int(r.size or 0).bit_length()
    return (each, each) if r.n == r.m and (r.lo or 0) >= 0 and int(r.hi or 0).bit_length() + 2 * each <= 63 else None


def runs_by_sight(runs: DataFrame, k: int, parts: int, order: tuple[str, str] = ("doc_id", "pos"), bits: tuple[int, int] | None = None, words_col: str = "words") -> DataFrame:
    """followers_by_sight(train(runs, k, first=order)), with one shuffle of the windows, which move to their state and are counted there.

    With bits (sight_bits), a place is one integer on the way. The windows that begin a run have one state; they are counted before they move.
    """
    key, pos = order
    windows = _windows(runs.withColumn("__odd", _odd(F.col(words_col))), k, words_col, [key, pos, "__odd"])
    if bits:
        up, low = sum(bits), bits[1]
        place = F.shiftleft(F.col(key).cast("bigint"), up).bitwiseOR(F.shiftleft(F.col(pos).cast("bigint"), low)).bitwiseOR(F.col("i").cast("bigint"))
        part = lambda c, down, n: F.shiftright(c, down).bitwiseAND(F.lit((1 << n) - 1))
        types = dict(windows.dtypes)
        whole = lambda c: F.struct(F.shiftright(c, up).cast(types[key]).alias(key), part(c, low, bits[0]).cast(types[pos]).alias(pos), part(c, 0, low).cast(types["i"]).alias("i"))
    else:
        place, whole = F.struct(key, pos, "i"), lambda c: c
    words = _coded_slots(k)
    rows = windows.select(F.concat_ws(" ", *words[:k]).alias("key"), words[k].alias("follow"), place.alias("first"))
    begun = F.col("key") == " ".join([BEGIN] * k)

    def lists(some: DataFrame) -> DataFrame:
        counted = some.groupBy("key", "follow").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        return counted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "follow", "n"))).alias("x"))

    seen = lists(rows.where(~begun).repartition(parts, "key")).unionByName(lists(rows.where(begun)))
    follow = lambda e: F.when(F.contains(e["follow"], F.lit("\\")), _decode(e["follow"])).otherwise(e["follow"]).alias("follow")
    return seen.select(split_state(F.col("key")).alias("state"), F.transform("x", lambda e: F.struct(follow(e), e["n"].alias("n"))).alias("followers"), whole(F.get("x", F.lit(0))["first"]).alias("first"))


def vocabulary_by_sight(runs: DataFrame, order: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """(word, word_id): the sentinels 0 and 1, then the words of runs in the order in which they are first seen, by ranges; a word equal to a sentinel is that."""
    seen = runs.select(*order, F.posexplode("words").alias("i", "word")).where(~F.col("word").isin(BEGIN, END))
    first = seen.groupBy("word").agg(F.min(F.struct(*order, "i")).alias("first"))
    ends = runs.sparkSession.createDataFrame([(BEGIN, 0), (END, 1)], "word string, word_id bigint")
    return ends.unionAll(ranked(first, "first", "rank").select("word", (F.col("rank") + 2).cast("bigint").alias("word_id")))


#: Words that may be broadcast; of a larger vocabulary these are common ones, and transitions with others are joined by shuffles.
BROADCAST_WORDS = 500_000
#: One in so many transitions, by a hash, tells which words are common.
COMMON_SAMPLE = 32


def encode(model: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(key array<bigint>, follow_id, n): the model with word ids. A counted, small vocabulary is broadcast, and the model doesn't move.

    Of a larger one the common words are broadcast, and only transitions with another word move. Which words are common is told by a
    sample; it decides how a transition gets its ids, never which.
    """
    vocab = written(vocab.select("word", F.col("word_id").cast("bigint").alias("word_id")), "vocabulary")
    out = model.select(*[F.col("state")[j].alias(f"w{j}") for j in range(k)], F.col("follow").alias(f"w{k}"), "n")
    slots, ids = [f"w{j}" for j in range(k + 1)], [f"i{j}" for j in range(k + 1)]

    def with_ids(rows: DataFrame, words: DataFrame, how: str) -> DataFrame:
        for w, i in zip(slots, ids):
            rows = rows.join(words.select(F.col("word").alias(w), F.col("word_id").alias(i)), w, how)
        return rows.select(*slots, *ids, "n")

    if vocab.count() <= BROADCAST_WORDS:
        out = with_ids(out, F.broadcast(vocab), "inner")
    else:
        some = out.where(F.pmod(F.xxhash64(*slots), F.lit(COMMON_SAMPLE)) == 0).select(F.explode(F.array(*slots)).alias("word"))
        seen = some.groupBy("word").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc()).limit(BROADCAST_WORDS)
        common = written(vocab.join(seen, "word", "left_semi"), "common-words")
        first = with_ids(out, F.broadcast(common), "left")
        rare = F.lit(False)
        for i in ids:
            rare |= F.col(i).isNull()
        out = first.where(~rare).unionByName(with_ids(first.where(rare).select(*slots, "n"), vocab, "inner"))
    return out.select(F.array(*ids[:k]).alias("key"), F.col(ids[k]).alias("follow_id"), "n")


#: Bits of the two integers that hold a packed state: 63 each, so that they stay positive.
PACKED_BITS = 126


def id_bits(largest: int) -> int:
    """Bits of an id when ids go up to largest."""
    return max(1, int(largest).bit_length())


def packed(encoded: DataFrame, k: int, bits: int) -> DataFrame:
    """encoded (column key: k ids) with the state in two integers hi and lo instead of key, and, if there is a column follow_id, the successor's next_hi and next_lo.

    The ids stand one after the other, the newest in the lowest bits of lo; lo has 63 bits and hi what is above, so states that
    fit in 63 bits have hi 0. A successor is the state shifted by one id, by integer operations alone. Sorting by (hi, lo)
    is sorting by the ids.
    """
    if k * bits > PACKED_BITS:
        raise ValueError(f"{k} ids of {bits} bits don't fit into {PACKED_BITS}")
    low = (1 << 63) - 1

    def pushed(hi: Column, lo: Column, id_: Column) -> tuple[Column, Column]:
        up = F.shiftleft(hi, bits).bitwiseOR(F.shiftrightunsigned(lo, 63 - bits)) if bits < 63 else lo
        lo = F.shiftleft(lo, bits).bitwiseAND(F.lit(low)).bitwiseOR(id_) if bits < 63 else id_
        keep = max(0, k * bits - 63)
        return (up.bitwiseAND(F.lit((1 << keep) - 1)) if keep else F.lit(0).cast("bigint")), (lo if k * bits >= 63 else lo.bitwiseAND(F.lit((1 << (k * bits)) - 1)))

    hi, lo = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for j in range(k):
        hi, lo = pushed(hi, lo, F.col("key")[j].cast("bigint"))
    out = encoded.select(*[c for c in encoded.columns if c != "key"], hi.alias("hi"), lo.alias("lo"))
    if "follow_id" not in encoded.columns:
        return out
    next_hi, next_lo = pushed(F.col("hi"), F.col("lo"), F.col("follow_id").cast("bigint"))
    return out.withColumns({"next_hi": next_hi, "next_lo": next_lo})


def csr(encoded: DataFrame, weight=None) -> DataFrame:
    """(key, state_id, row_start, degree, followers array<struct<follow_id, n>>): compressed sparse rows.

    With weight, a function of the column n, the followers also hold cum, the sum of the weights up to them.
    """
    entry = ["follow_id", "n"]
    encoded = encoded.repartitionByRange("key")  # for the sums, the rows and their places alike
    if weight is not None:
        upto = F.sum(weight(F.col("n")).cast("double")).over(Window.partitionBy("key").orderBy("follow_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        encoded, entry = encoded.withColumn("cum", upto), [*entry, "cum"]
    rows = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("followers")).withColumn("degree", F.size("followers").cast("bigint"))
    return running_sums(rows.withColumn("__one", F.lit(1).cast("bigint")), ["key"], {"__one": "state_id", "degree": "row_start"}, "rows", ranged=True).drop("__one")
