"""Text columns: length, words, sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a missing text turns into, and its length and word count.
MISSING_TEXT = "nan"
MISSING_TEXT_LENGTH = 3
MISSING_TEXT_WORDS = 1

# The characters Python's str.split() treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

WORD = r"[\p{L}\p{N}]+"
# A word, or a single mark that is neither part of a word nor white space.
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^ \t\n\r\f\x0B\p{L}\p{N}]"
NOT_BLANK = r"[^ \t\n\r\f\x0B]"
SENTENCE_BREAK = r"(?<=[.!?])[ \t\n\r\f]+"


def text_or_nan(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(MISSING_TEXT))


def text_length(text: Column) -> Column:
    """Number of code points."""
    return F.length(text_or_nan(text))


def word_count(text: Column, strict: bool = False) -> Column:
    """Number of words separated by white space.

    A missing text fails in strict mode and counts as one word otherwise.
    """
    # Splitting at one plain character needs no regular expression.
    spaced = F.translate(text_or_nan(text), WHITESPACE, " " * len(WHITESPACE))
    words = F.array_size(F.array_remove(F.split(spaced, " "), ""))
    if not strict:
        return words
    missing = F.raise_error(F.lit("cannot count the words of a missing text")).cast("int")
    return F.when(text.isNull(), missing).otherwise(words)


def normalise_text(text: Column) -> Column:
    """One line of lower-case text."""
    return F.lower(F.replace(text, F.lit("\n"), F.lit(" ")))


def words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.regexp_extract_all(F.lower(text_or_nan(text)), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of a text; line breaks count as spaces."""
    return F.split(F.replace(text_or_nan(text), F.lit("\n"), F.lit(" ")), SENTENCE_BREAK)


def sentence_words(sentence: Column) -> Column:
    """Lower-cased words and punctuation marks of one sentence."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(WORD_OR_MARK), F.lit(0))
