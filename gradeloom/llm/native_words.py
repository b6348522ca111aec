"""Words of texts as column expressions, without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ASCII but letters and digits separates; so do upper-case letters, hence texts are lower-cased first.
SEPARATORS = "".join(chr(c) for c in range(0x80) if not chr(c).isdigit() and not chr(c).islower())
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; none for null."""
    return _split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def _split(lowered: Column) -> Column:
    inner = F.btrim(lowered, F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN))


def folded(text: Column) -> Column:
    """All letters lower-cased, each whatever stands beside it: only capital sigma looks at its neighbours."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ")))


def folded_words(text: Column) -> Column:
    """As many words as :func:`words` gives, equal wherever those are; faster for texts with accents."""
    return _split(folded(text))


def spaced_words(text: Column) -> Column:
    """Words between ASCII white space, unchanged; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def runs(n: Column, length: int, step: int = 1) -> Column:
    """Starts from 0, in steps, of runs of ``length`` among ``n`` words."""
    none = F.array().cast("array<int>")
    return F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(step))).otherwise(none)


def places(found: Column, phrase: str) -> Column:
    """Starts of the words of ``phrase`` where they stand consecutively in an array of words."""
    parts = phrase.split(" ")

    def here(start: Column) -> Column:
        same = F.lit(True)
        for i, part in enumerate(parts):
            same = same & (F.get(found, start + i) == part)
        return same

    return F.filter(runs(F.size(found), len(parts)), here)
