"""Document fingerprints by one-permutation MinHash, as column expressions.

The shingles of a text are hashed once.  The leading bits of a hash choose one of
``BINS`` bins, each of which keeps its least hash.  An empty bin borrows from a filled
one: it asks bins drawn by a hash of (own number, attempt) until one is filled, the
same for all texts (optimal densification).  A fingerprint has the ``BITS`` low-order
bits of every bin.  Unlike bins agree by chance once in 2**BITS, which the likeness
corrects for.

A text without words counts as one empty shingle, so that such texts are alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.native_words import spaced_words
from gradeloom.operators.row_index import with_row_index
from gradeloom.staging import stage

SHINGLE = 5
# Powers of two; one digit of a hexadecimal fingerprint per bin.
BINS, BITS = 256, 4
_BIN_SHIFT = 64 - (BINS - 1).bit_length()
_BELOW = (1 << _BIN_SHIFT) - 1
# Draws of an empty bin; where all fail, the filled bin of least hash is asked.
ATTEMPTS = 24


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of ``shingle`` words, repeats included; of all words together if there are fewer.

    ``words`` has to be a column and no expression, or every run would work it out again.
    """
    n = F.size(words)
    # Words past the end are null, which the hash leaves out.
    runs = F.transform(words, lambda word, i: F.xxhash64(word, *(F.get(words, i + k) for k in range(1, shingle))))
    return F.when(n == 0, F.array(F.xxhash64(F.lit("")))).otherwise(F.slice(runs, 1, F.greatest(n - shingle + 1, F.lit(1))))


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Every row with the fingerprint of its whole text, a binary of ``BINS * BITS / 8`` bytes.

    Null counts as empty.  Equal texts have equal fingerprints; words are compared with
    all letters lower-cased.  A column named ``name`` is replaced; other columns are kept,
    whatever their names.  An empty table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    packed = F.struct(*others).alias("row")
    rows = df.select(packed, spaced_words(F.lower(F.col(text))).alias("words"))
    rows = rows.select("row", shingle_hashes(F.col("words"), shingle).alias("hashes"))
    # One bound per bin above all its hashes, so that sorting puts an element in each.
    half = BINS // 2
    bounds = F.lit([(b << _BIN_SHIFT) + _BELOW for b in range(-half, half)])
    rows = rows.select("row", F.sort_array(F.concat("hashes", bounds)).alias("sorted"))
    bin_of = lambda h: F.shiftright(h, _BIN_SHIFT)
    first = lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("sorted", i - 1)))
    rows = rows.select("row", F.filter("sorted", first).alias("least"))
    empty = lambda h: h.bitwiseAND(F.lit(_BELOW)) == _BELOW
    low = lambda h: F.when(~empty(h), h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    rows = rows.select("row", F.transform("least", low).alias("bins"))
    numbered = F.transform("bins", lambda bits, i: F.struct(i.alias("bin"), bits.alias("bits")))
    filled = F.filter(numbered, lambda x: x["bits"].isNotNull())
    rows = rows.select("row", "bins", filled.alias("filled"))
    rows = rows.select("row", F.transform("bins", _densified).alias("dense"))
    digits = F.lit([f"{d:x}" for d in range(1 << BITS)])
    hexed = F.array_join(F.transform("dense", lambda bits: F.get(digits, bits)), "")
    return rows.select("row.*", F.unhex(hexed).alias(name))


def _densified(bits: Column, i: Column) -> Column:
    """The bits of a bin, or those of the bin that it borrows from."""
    drawn = (F.get("bins", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS))
    ranked = F.transform("filled", lambda x: F.struct(F.xxhash64(i, x["bin"], F.lit(ATTEMPTS)).alias("at"), x["bits"].alias("bits")))
    return F.coalesce(bits, *drawn, F.array_min(ranked)["bits"])


def hex_digits(fingerprint: str) -> Column:
    """A fingerprint as lower-case hexadecimal digits, one per bin."""
    return F.lower(F.hex(fingerprint))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingles behind two fingerprints, from 0 to 1; 1 for equal ones."""
    words = BINS * BITS // 64

    def word(fingerprint: str, k: int) -> Column:
        return F.conv(F.substring(F.hex(fingerprint), 1 + 16 * k, 16), 16, -10).cast("long")

    def unlike(k: int) -> Column:
        bits = word(a, k).bitwiseXOR(word(b, k))
        any_bit = reduce(lambda x, s: x.bitwiseOR(F.shiftrightunsigned(bits, s)), range(1, BITS), bits)
        lowest = sum(1 << at for at in range(0, 64, BITS))
        return F.bit_count(any_bit.bitwiseAND(F.lit(lowest)))

    same = 1 - reduce(lambda x, y: x + y, (unlike(k) for k in range(words))) / F.lit(float(BINS))
    chance = 1 / (1 << BITS)
    return F.greatest((same - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))


def edited_texts(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row ``doc_id``, ``n_chars``, ``edited``, its own ``fingerprint``, ``edited_fingerprint`` and ``next_fingerprint``.

    The edited text has its last ``n_chars // 2`` code points replaced by as many (or all)
    from the beginning of the next text, in the order of ids; the first text follows the
    last.  Null texts count as empty, a null id comes first.  Texts of one id are in the
    order of their MD5; rows with equal id and text are one document there, and get equal
    results.  Only these columns are returned, so others cannot clash.  An empty table
    gives an empty result.

    Fingerprints are ranked without the texts.  A text is shuffled once, to learn how
    much the document before it needs, and only that beginning is sent there.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    identity = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(whole.cast("binary")))
    key = F.unhex(F.md5(identity.cast("binary")))
    docs = df.select(F.col(doc_id).alias("doc_id"), key.alias("key"), whole.alias("text"))
    printed = with_fingerprint(docs.withColumn("n_chars", F.length("text").cast("long")), "text").drop("text")
    # Rows with equal keys are equal.
    ranked = stage(with_row_index(printed.dropDuplicates(["key"]), "doc_id", "key"), "fingerprints")
    last = ranked.agg(F.max("row_idx")).first()[0]
    before = ranked.select(
        F.when(F.col("row_idx") == F.lit(last), F.lit(0)).otherwise(F.col("row_idx") + 1).alias("row_idx"),
        F.col("key").alias("before"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("wanted"),
    )
    linked = stage(ranked.drop("doc_id").join(before, "row_idx").drop("row_idx"), "neighbours")
    known = docs.join(linked, "key")
    # With the columns that are kept below, so that both come from one shuffle of the texts.
    sent = known.select("key", "doc_id", "before", F.col("fingerprint").alias("next_fingerprint"), F.substring("text", F.lit(1), F.col("wanted")).alias("begins"))
    sent = sent.dropDuplicates(["key", "doc_id"]).drop("key", "doc_id").withColumnRenamed("before", "key")
    halved = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    kept = known.select("key", "doc_id", "n_chars", "fingerprint", F.substring("text", F.lit(1), halved).alias("kept"))
    edited = kept.join(sent, "key").withColumn("edited", F.concat("kept", "begins")).drop("key", "kept", "begins")
    return with_fingerprint(edited, "edited", "edited_fingerprint")
