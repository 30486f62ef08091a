"""Fill-in-middle transformation, relationally.

A text's units (a word with the white space before it, or a last run of white space) are numbered by posexplode. The units'
lengths get running sums by a window, the requested cuts are joined to them by unit ordinal, the offsets found are aggregated
for each document, and the pieces are substrings of its text at these offsets.

Before the shuffle, the lengths of units that are in no block of 32 units with a cut are summed by block, so that a document of
n units sends n / 32 + 96 rows at most. Texts that are cut move once, to meet their offsets; plain ones don't move.

Which cuts: h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:id``. The prefix has the smaller of
h1 % (n + 1) and h2 % (n + 1) units, prefix and middle together the larger. The form is ``plain`` (the text itself) for an empty text, a text
that contains a marker, or if h3 % 100 >= fim_percent; else ``spm`` if h4 % 100 < spm_percent, else ``psm``.

Defined results: a null text counts as empty, a null id as an empty one; rows of one id are apart unless their texts are equal too (then they come
out alike); texts of any length are cut whole; an empty table stays empty; other columns stay, and columns with the names
of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space with the word after it, or white space at the end; the markers.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = ("n_units", "form", "prefix_chars", "middle_chars", "output")
#: Units whose lengths are summed before the shuffle, if no cut is among them.
BLOCK = 32


def _rolls(id_: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """docs with __t (text), __k (a digest of id and text) and __form."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    _, _, h3, h4 = _rolls(F.col(id_col), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(id_).cast("string"), F.lit(":"), id_, text), 256), 1, 32))
    return docs.withColumns({"__t": text, "__k": key, "__form": form})


def _requests(cut: DataFrame, id_col: str, seed: int) -> DataFrame:
    """(__k, n, which, ordinal): the two cuts of each text."""
    h1, h2, _, _ = _rolls(F.col(id_col), seed)
    counted = cut.select("__k", F.size(_units(F.col("__t"))).cast("bigint").alias("n"), h1.alias("h1"), h2.alias("h2"))
    ends = F.expr("array(least(h1 % (n + 1), h2 % (n + 1)), greatest(h1 % (n + 1), h2 % (n + 1)))")
    return counted.select("__k", "n", F.posexplode(ends).alias("which", "ordinal"))


def _running(cut: DataFrame, id_col: str, seed: int) -> DataFrame:
    """(__k, start, offset): code points before the unit of that ordinal, for all units of blocks with a cut and the first of other blocks."""
    h1, h2, _, _ = _rolls(F.col(id_col), seed)
    rows = cut.select("__k", _units(F.col("__t")).alias("u"), h1.alias("__h1"), h2.alias("__h2"))
    blocks = [F.expr(f"__{h} % (size(u) + 1) div {BLOCK}").alias(f"__{h}") for h in ("h1", "h2")]
    units = rows.select("__k", *blocks, F.posexplode(F.array_append("u", F.lit(""))).alias("i", "unit"))  # the last one stands for the end of the text
    start = F.expr(f"if(i div {BLOCK} in (__h1, __h2), i, i div {BLOCK} * {BLOCK})").cast("bigint")
    lengths = units.select("__k", "i", start.alias("start"), F.length("unit").alias("n"))
    # Rows of equal id and text are counted in full each, and each has the first unit of a block once.
    sums = lengths.groupBy("__k", "start").agg(F.expr("sum(n) div count_if(i = start)").alias("n"))
    before = Window.partitionBy("__k").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__k", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def fim(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    if not (0 <= fim_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percentages are from 0 to 100")
    keyed = _keyed(docs, id_col, text_col, seed, fim_percent, spm_percent)
    cut = keyed.where("__form <> 'plain'")
    asked, running = _requests(cut, id_col, seed), _running(cut, id_col, seed).withColumnRenamed("__k", "__k2")
    # Written as a difference, the ordinals are no partitioning keys of the join: the running sums stay where their window was.
    met = asked.join(running, (F.col("__k") == F.col("__k2")) & (F.col("ordinal") - F.col("start") == 0))
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("offset")))
    offsets = met.groupBy("__k").agg(F.max("n").alias("__n"), at(0).alias("__a"), at(1).alias("__z"))
    put, old = lambda **new: [new[c].alias(c) for c in NEW], [c for c in docs.columns if c not in NEW or c in (id_col, text_col)]
    plain = keyed.where("__form = 'plain'").select(*old, *put(n_units=F.size(_units(F.col("__t"))).cast("bigint"), form=F.col("__form"), prefix_chars=F.lit(None).cast("bigint"), middle_chars=F.lit(None).cast("bigint"), output=F.col("__t")))
    found = cut.join(offsets.hint("shuffle_hash"), "__k")
    t, a, z, one = F.col("__t"), F.col("__a"), F.col("__z"), F.lit(1)
    head, mid, tail = F.substring(t, one, a), F.substring(t, a + 1, z - a), F.substring(t, z + 1, F.length(t))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), mid)
    spm = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), mid)
    moved = found.select(*old, *put(n_units=F.col("__n"), form=F.col("__form"), prefix_chars=a.cast("bigint"), middle_chars=(z - a).cast("bigint"), output=F.when(F.col("__form") == "psm", psm).otherwise(spm)))
    return plain.unionByName(moved)


def restore(form: Column, output: Column) -> Column:
    """The text that was transformed, from form and output alone: texts that contain a marker are plain, so each marker is found once."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    p, m, width, rest = F.position(first, output), F.position(second, output), len(PREFIX), F.length(output)
    one, two, three = F.substring(output, F.lit(width + 1), p - width - 1), F.substring(output, p + width, m - p - width), F.substring(output, m + width, rest)
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
