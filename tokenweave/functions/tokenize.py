"""Tokenizers as column functions: sentences, lines, words, normalised words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and where a sentence ends.
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
BOUNDARY = rf"""(?<=[.!?]){WS}+(?=["'(\[]?[A-Z0-9])"""
#: The characters of WS, and those of them that are no space; the latter are tested after "no visible ASCII", as most characters are that.
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
OTHER_WS = r"[[^ -~]&&[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"


def trim(c: Column) -> Column:
    """c without Unicode white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def sentence_array(text: Column) -> Column:
    """Trimmed, non-empty sentences; a null text has none."""
    return F.array_remove(F.transform(F.split(text, BOUNDARY, -1), trim), "")


def line_array(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.array_remove(F.transform(F.split(text, "\n", -1), trim), "")


def word_array(sentence: Column, normalize: bool = False) -> Column:
    """Words of a sentence; normalize lower-cases, deletes all but ASCII letters and digits, and drops empty words.

    All white space becomes spaces, at which a split needs no regular expression (one would be compiled for each sentence).
    """
    words = F.array_remove(F.split(F.regexp_replace(sentence, OTHER_WS, " "), " ", -1), "")
    if normalize:
        words = F.array_remove(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^A-Za-z0-9]", "")), "")
    return words


@dataclass(frozen=True)
class Tokenizer:
    """How texts become runs of words and words become text; one object serves training and generation alike.

    split: text column -> array of sentences; words: sentence column -> array of words; join: array of words -> text.
    """

    split: object = staticmethod(sentence_array)
    words: object = staticmethod(word_array)
    join: object = staticmethod(lambda w: F.array_join(w, " "))


PROSE = Tokenizer(sentence_array, word_array)
PROSE_NORMALIZED = Tokenizer(sentence_array, lambda s: word_array(s, True))
LINES = Tokenizer(line_array, word_array)


def units(docs: DataFrame, text_col: str, split, keys: list[str]) -> DataFrame:
    """(keys, pos, s): the sentences or lines of each text, in order."""
    return docs.select(*keys, F.posexplode(split(F.col(text_col))).alias("pos", "s"))


def runs(docs: DataFrame, tokenizer: Tokenizer = PROSE, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, words): tokenized sentences with at least one word.

    The words are made before the texts are exploded: made after it, the filter on them would be pushed below and make them twice.
    """
    split = F.transform(tokenizer.split(F.col(text_col)), lambda s: tokenizer.words(s))
    return docs.select(*keys, F.posexplode(split).alias("pos", "words")).where(F.size("words") > 0)


def texts(docs: DataFrame, tokenizer: Tokenizer = PROSE, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, words): the words of each text, end to end. A row is a text of its own, so nothing moves; a text without words has an empty or null array."""
    split = F.transform(tokenizer.split(F.col(text_col)), lambda s: tokenizer.words(s))
    return docs.select(*keys, F.flatten(split).alias("words"))
