"""One query per operator, over whole tables, as the driver calls them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.llm.backoff_lm import score_texts
from gradeloom.llm.byte_bpe import encode
from gradeloom.llm.decontamination import find_benchmark_passages
from gradeloom.llm.fingerprints import edited_texts, hex_digits, likeness
from gradeloom.llm.filter_audit import audit_filters, count_failures, failure_rows
from gradeloom.llm.language_id import identify_language, train_language_model
from gradeloom.llm.licenses import scan_licenses
from gradeloom.llm.native_words import LOWER, UPPER, spaced_words
from gradeloom.llm.quality_rules import apply_cutoffs, choose_cutoffs, measure_quality
from gradeloom.llm.simhash import hex_fingerprint, near_duplicate_groups
from gradeloom.llm.spelling import spelling_variants
from gradeloom.llm.substring_dedup import remove_repeated_passages
from gradeloom.llm.template_extraction import extract_main_text
from gradeloom.llm.toxicity import ToxicityModel, class_prior, score_toxicity, train_toxicity
from gradeloom.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: str) -> Column:
    return F.sha2(F.encode(F.col(text), "UTF-8"), 256)


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """The classifier, from the labels of three of four folds and the texts there."""
    learning = F.coalesce(_remainder(4) != 2, F.lit(False))
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text").filter(learning)
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learning)
    return train_toxicity(documents, labels.filter("toxic = 1"), class_prior(labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(documents, toxicity_model(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = measure_quality(documents.withColumn("text_hash", F.xxhash64("text")), keep=["doc_id", "lang", "text_hash"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = stage(counts.withColumn("base_failed", failed), "measured")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Copies of a text are one trial, good if any of them is, and the base rejects its texts before the method does.
    labelled = measured.filter(~F.col("base_failed")).join(labels, "doc_id")
    good = F.max(F.col("quality") == 1).alias("good")
    same = [F.first(c).alias(c) for c in measured.columns if c not in ("doc_id", "lang", "text_hash")]
    cutoffs = choose_cutoffs(labelled.groupBy("lang", "text_hash").agg(good, *same), "lang", "good")
    judged = apply_cutoffs(measured, "lang", cutoffs)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    # A null id is in no fold that is held out.
    held_out = F.coalesce(_remainder(10) == 0, F.lit(False))
    rows = documents.select("doc_id", "text", held_out.alias("held_out")).withColumn("training", ~F.col("held_out"))
    return score_texts(rows, "training", keep=["doc_id", "held_out"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = near_duplicate_groups(documents, shingle=3, max_bits=3, keep=["doc_id"])
    return groups.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    learning = F.coalesce(_remainder(5) != 0, F.lit(False))
    model = train_language_model(documents.filter(learning))
    labelled = identify_language(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = find_benchmark_passages(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(documents, ranks, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeated_passages(documents)
    return found.select("doc_id", "n_words", "n_removed", _sha256("kept").alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = documents.withColumn("words", spaced_words(text))
    n_words, n_chars = F.size("words"), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failures = [
        n_words < 100,
        100 * F.size(F.array_distinct("words")) < 80 * n_words,
        100 * capitals.cast("long") > 10 * n_chars.cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id")
    labels = labels.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failure_rows(worded, failures).join(labels, "doc_id", "left")
    counts = count_failures(rows, ["good", "toxic"], copies=len(failures))
    # A few dozen rows per part, read three times.
    return audit_filters(stage(counts, "failures"), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    # Runs below seven code points only get shorter.
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))
    lowered = F.translate("run", UPPER, LOWER).alias("run")
    found = documents.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lowered)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = found.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    spelled = hashed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = spelled.filter(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n"))
    return spelling_variants(counted.filter("n >= 2")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        _sha256("edited").alias("edited_sha256"),
        hex_digits("fingerprint").alias("fingerprint"),
        hex_digits("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling": op12_spelling,
    "op13_fingerprints": op13_fingerprints,
}
