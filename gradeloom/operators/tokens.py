"""Vocabulary, token ids, sentences and augmented texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradeloom.functions.text import NOT_BLANK, sentence_words, sentences, text_or_nan, words
from gradeloom.operators.row_index import with_row_index
from gradeloom.staging import stage

# Ids of padding and of unknown words, the first id of a word, and the length of a text.
PAD, UNKNOWN, FIRST_ID = 0, 1, 2
MAX_LENGTH = 512
# The most frequent words; every task has them at hand, so that they are not dealt out by word.
HEAD = 200_000
# Words of a batch that are looked up together, and characters of text that are paraphrased together.
WORDS_AT_ONCE = 1 << 18
TEXT_AT_ONCE = 4 << 20


# A word with full stops inside or behind it.
STOPPED_WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*\.?"
# The share of full stops behind an abbreviation, and the score from which a word is one.
ALWAYS, LEAST_ABBREVIATION = 0.99, 0.3
# Stands for white space that ends no sentence.
_JOINED = "\x02"


def build_vocab(df: DataFrame, min_count: int = 1, max_size: int | None = None, text: str = "text") -> DataFrame:
    """All words with their counts and ids from 2 on, the most frequent first.

    Words of equal count are in word order.  ``max_size`` keeps only the first of them.
    """
    counts = (
        # Outer, since Spark would look for the words once more to leave out texts without any first.
        df.select(F.explode_outer(words(F.col(text))).alias("token"))
        .filter("token IS NOT NULL")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    ranked = with_row_index(counts, F.desc("n"), F.col("token"))
    if max_size is not None:
        ranked = ranked.filter(F.col("row_idx") < max_size)
    return ranked.select("token", "n", (F.col("row_idx") + FIRST_ID).cast("int").alias("id"))


def parts_of(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch at a time with about ``size`` elements or bytes of text in a column, or one longer row."""
    for batch in batches:
        column = batch.column(name)
        sizes = pc.binary_length(column) if pa.types.is_string(column.type) else column.value_lengths()
        part = np.cumsum(sizes.fill_null(0).to_numpy().astype(np.int64)) // size
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows).tolist()
        for begin, end in zip(edges, edges[1:]):
            yield batch.slice(begin, end - begin)


def _fit(ids: Column, max_length: int) -> dict[str, Column]:
    """Pad ids to the full length and mark the real ones."""
    n = F.size(ids)
    padding = F.array_repeat(F.lit(PAD), F.lit(max_length) - n)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return {"input_ids": F.concat(ids, padding), "attention_mask": mask}


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
    text: str = "text",
    begin: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of a fixed length.

    Longer texts are cut, shorter ones padded with 0; unknown words get id 1.  The ids
    ``begin`` and ``end``, if given, enclose the words and count towards the length.
    Every row is encoded by itself, whatever its other columns hold.
    """
    room = max_length - (begin is not None) - (end is not None)
    if room < 1:
        raise ValueError("there is no room for a word")
    # Written with a number for every row, which stays the same when tasks are run again.
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    known = stage(vocab.select("token", "id"), "vocabulary")
    # Ids are different, so these are at most HEAD.
    frequent = known.filter(F.col("id") < FIRST_ID + HEAD).select("token", F.col("id").cast("int").alias("id")).toArrow()
    tail = known.filter(F.col("id") >= FIRST_ID + HEAD)
    has_tail = bool(tail.head(1))
    at_hand = rows.sparkSession.sparkContext.broadcast(
        (frequent.column("token").combine_chunks(), frequent.column("id").to_numpy())
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent words as ids in their places; the others with their places apart, if any can be known."""
        for batch in parts_of(batches, "_words", WORDS_AT_ONCE):
            words, flat = batch.column("_words"), batch.column("_words").flatten()
            tokens, ids = at_hand.value
            found = pc.index_in(flat, value_set=tokens).fill_null(-1).to_numpy()
            filled = np.where(found >= 0, ids[np.maximum(found, 0)] if len(ids) else UNKNOWN, UNKNOWN).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).astype(np.int32)
            results = {"_ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(filled))}
            if has_tail:
                rare = np.flatnonzero(found < 0)
                cuts = np.searchsorted(rare, ends)
                places = rare - np.repeat(ends[:-1], np.diff(cuts))
                columns = [pa.array(places.astype(np.int32)), flat.take(pa.array(rare))]
                entries = pa.StructArray.from_arrays(columns, names=["pos", "token"])
                results["_rare"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), entries)
            kept = {name: batch.column(name) for name in batch.schema.names if name != "_words"} | results
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    def filled(numbered: DataFrame) -> DataFrame:
        added = [StructField("_ids", ArrayType(IntegerType()))]
        if has_tail:
            entry = StructType([StructField("pos", IntegerType()), StructField("token", StringType())])
            added.append(StructField("_rare", ArrayType(entry)))
        schema = StructType([*numbered.drop("_words").schema.fields, *added])
        return numbered.mapInArrow(fill, schema)

    spoken = F.slice(words(F.col(text)), 1, room).alias("_words")
    if has_tail:
        ids = stage(filled(rows.select("_row", spoken)), "filled")
        late = ids.select("_row", F.inline("_rare")).join(tail, "token")
        # A text has at most max_length entries.
        late = late.groupBy("_row").agg(F.collect_list(F.struct("pos", F.col("id").cast("int").alias("id"))).alias("_late"))
        own = F.transform("_ids", lambda x, i: F.struct(i.alias("pos"), x.alias("id")))
        both = ids.join(late, "_row", "left").withColumn("_both", F.sort_array(F.concat(own, "_late")))
        # Of two entries for a place the larger counts: the other one is that of an unknown word.
        last = F.filter("_both", lambda x, i: F.coalesce(F.get("_both", i + 1)["pos"] != x["pos"], F.lit(True)))
        ids = both.select("_row", F.coalesce(last["id"], F.col("_ids")).alias("_ids"))
        encoded = rows.join(ids, "_row", "left")
    else:
        encoded = filled(rows.select("*", spoken))
    edges = [F.array() if i is None else F.array(F.lit(i)) for i in (begin, end)]
    whole = F.concat(edges[0].cast("array<int>"), F.col("_ids"), edges[1].cast("array<int>"))
    return encoded.withColumns(_fit(whole, max_length)).drop("_row", "_ids")


def learn_abbreviations(df: DataFrame, text: str = "text", least: float = LEAST_ABBREVIATION) -> DataFrame:
    """Words that a full stop mostly belongs to, as ``word``, ``n``, ``n_stops`` and ``score``.

    A word's share of full stops (``n_stops`` of ``n``) is compared with that of all words by a log-likelihood
    ratio: does a stop follow nearly always, or as often as anywhere?  Long words and
    words that also stand without a stop weigh less, words with stops inside more.  One
    aggregation; words are lower-cased, and those scored below ``least`` are left out.
    """
    found = F.regexp_extract_all(F.lower(text_or_nan(F.col(text))), F.lit(STOPPED_WORD), F.lit(0))
    spoken = df.select(F.explode_outer(found).alias("token")).filter("token IS NOT NULL")
    stopped = F.col("token").endswith(".")
    counts = spoken.groupBy(F.rtrim("token", F.lit(".")).alias("word")).agg(
        F.count("*").alias("n"), F.count_if(stopped).alias("n_stops")
    )
    counts = stage(counts, "stops")
    total = counts.agg(F.sum("n").cast("double"), F.sum("n_stops").cast("double")).first()
    share = min(max((total[1] or 0.0) / (total[0] or 1.0), 1e-9), 1 - 1e-9)
    without = F.col("n") - F.col("n_stops")
    anywhere = F.col("n_stops") * F.lit(math.log(share)) + without * F.lit(math.log(1 - share))
    always = F.col("n_stops") * F.lit(math.log(ALWAYS)) + without * F.lit(math.log(1 - ALWAYS))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters
    score = 2 * (always - anywhere) * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -without.cast("double"))
    return counts.withColumn("score", score).filter((F.col("n_stops") > 0) & (F.col("score") >= least))


def sentences_of_words(df: DataFrame, *keep: str, text: str = "text", abbreviations: DataFrame | None = None) -> DataFrame:
    """One row per sentence with its number in the text and its words.

    The full stop of a word in ``abbreviations`` (a column ``word``, lower-cased) ends no sentence.
    """
    if abbreviations is not None:
        df, text = _with_joined_stops(df, text, abbreviations), "_joined"
    split = df.select(*keep, F.posexplode_outer(sentences(F.col(text))).alias("sent_no", "_sentence"))
    # What is not white space gives a word; asking for words here would look for them twice.
    spoken = split.filter(F.col("_sentence").rlike(NOT_BLANK)).withColumn("_sentence", F.replace("_sentence", F.lit(_JOINED), F.lit(" ")))
    return spoken.withColumn("words", sentence_words(F.col("_sentence"))).drop("_sentence")


def _with_joined_stops(df: DataFrame, text: str, abbreviations: DataFrame) -> DataFrame:
    """Every row with ``_joined``, its text with a mark instead of the white space behind each abbreviation."""
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    lowered = F.lower(text_or_nan(F.col(text)))
    stops = F.regexp_extract_all(lowered, F.lit(rf"({STOPPED_WORD})[ \t\n\r\f]"), F.lit(1))
    said = rows.select("_row", F.explode_outer(F.array_distinct(stops)).alias("token")).filter(F.col("token").endswith("."))
    said = said.select("_row", F.rtrim("token", F.lit(".")).alias("word"))
    # At most the different words of one text.
    own = said.join(abbreviations.select("word").distinct(), "word", "left_semi").groupBy("_row").agg(F.collect_set("word").alias("_own"))
    met = rows.join(own, "_row", "left")
    choices = F.replace(F.array_join(F.sort_array("_own", asc=False), "|"), F.lit("."), F.lit("\\."))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}.])("), choices, F.lit(r")\.[ \t\n\r\f]+"))
    joined = F.when(F.col("_own").isNotNull(), F.regexp_replace(text_or_nan(F.col(text)), pattern, F.lit(f"$1.{_JOINED}")))
    return met.withColumn("_joined", F.coalesce(joined, F.col(text))).drop("_row", "_own")


def augment_text(
    df: DataFrame, paraphrase: Callable[[pd.Series], pd.Series], copy_no: str, text: str = "text"
) -> DataFrame:
    """Replace every text by a paraphrase.

    ``paraphrase`` gets a batch of texts.  If it fails on a batch, the texts are
    tried one by one; those that fail have a null text and the reason in
    ``error``.
    """
    names = [field.name for field in df.schema.fields if field.name not in ("origin", "copy_no", "error")]
    plain = df.select(*names)
    added = [StructField(name, StringType()) for name in ("origin", "copy_no", "error")]
    schema = StructType([*plain.schema.fields, *added])

    def one(value: str) -> tuple[str | None, str | None]:
        try:
            return paraphrase(pd.Series([value])).iloc[0], None
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text, TEXT_AT_ONCE):
            given = batch.column(text).to_pandas().rename(text)
            try:
                texts, errors = list(paraphrase(given)), None
            except Exception:
                texts, errors = zip(*map(one, given))
            changed = {
                text: pa.array(texts, batch.column(text).type, from_pandas=True),
                "origin": pa.repeat(pa.scalar("aug"), len(given)),
                "copy_no": pa.repeat(pa.scalar(copy_no, pa.string()), len(given)),
                "error": pa.array(errors or [None] * len(given), pa.string()),
            }
            columns = {name: batch.column(name) for name in names} | changed
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return plain.mapInArrow(replace, schema)


def augment_text_once(
    df: DataFrame,
    paraphrase: Callable[[pd.Series], pd.Series],
    copy_no: str,
    memo: str,
    text: str = "text",
    parts: int = 16,
) -> DataFrame:
    """The same, but a text is sent once, however many rows have it and however often this is run.

    Answers are kept in the table ``memo`` by a hash of 128 bits and written in ``parts`` commits, so
    that a run that breaks off loses one part at most.  Texts that failed are sent again by the
    next run; rows without a text are not sent.
    """
    spark = df.sparkSession
    plain = df.drop("origin", "copy_no", "error")
    key = F.md5(F.col(text).cast("binary"))
    answers = "key string, answer string, error string"
    for part in range(parts):
        own = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(parts)) == part
        asked = plain.select(key.alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & own)
        asked = asked.groupBy("key").agg(F.first("text").alias("text"))
        if _exists(spark, memo):
            done = spark.read.schema(answers).parquet(memo).filter(F.col("error").isNull() & own)
            asked = asked.join(done, "key", "left_anti")
        answered = augment_text(asked, paraphrase, copy_no).select("key", F.col("text").alias("answer"), "error")
        answered.write.mode("append").parquet(memo)
    known = spark.read.schema(answers).parquet(memo).groupBy("key")
    # The answer if there is one, else the reason of the last failure in order.
    best = known.agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "error", "answer")).alias("found"))
    names = plain.columns
    met = plain.withColumn("_key", key).join(best.withColumnRenamed("key", "_key"), "_key", "left")
    kept = [F.col("found.answer").alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return met.select(*kept, F.lit("aug").alias("origin"), F.lit(copy_no).alias("copy_no"), F.col("found.error").alias("error"))


def _exists(spark, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
