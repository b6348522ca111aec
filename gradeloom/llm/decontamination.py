"""Removal of benchmark passages from documents, in DataFrame operations only.

The windows of all items form the hash set.  A window of n words holds a run of
m = (n + 1) // 2 words that starts at a multiple of n - m + 1 in the document, wherever
the window lies.  So the first scan looks up only those runs, and only the documents
where one is found are scanned for whole windows, which are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.native_words import folded, folded_words, runs, words
from gradeloom.staging import stage

WINDOW = 10
# Rows of a lookup table that is sent to all tasks; larger ones are joined by key.
MAX_BROADCAST = 1_000_000


def _sent(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def _windows(found: Column, length: int) -> Column:
    """(start, length, content) of all windows of a document."""

    def at(start: Column) -> Column:
        content = F.array_join(F.slice(found, start + 1, length), " ")
        return F.struct(start.alias("start"), F.lit(length).alias("length"), content.alias("content"))

    return F.transform(runs(F.size(found), length), at)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, length, content) of all windows; items of fewer words are one window, empty ones none."""
    found = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    starts = found.filter(F.size("words") > 0).select(
        "item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start")
    )
    content = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ")
    return starts.select("item", "length", content.alias("content")).distinct()


def _anchor(length: int) -> tuple[int, int]:
    """Words of the run to look up for a window, and the step of its starts in a document."""
    run = (length + 1) // 2
    return run, length - run + 1


def _anchors_of_documents(found: Column, lengths: list[int]) -> Column:

    def of_length(length: int) -> Column:
        run, step = _anchor(length)
        return F.transform(runs(F.size(found), run, step), lambda s: F.xxhash64(F.lit(length), F.slice(found, s + 1, run)))

    return F.concat(*map(of_length, lengths))


def _anchors_of_windows(windows: DataFrame, lengths: list[int]) -> DataFrame:
    tables = []
    for length in lengths:
        run, _ = _anchor(length)
        own = windows.filter(F.col("length") == length).select("content").distinct()
        split = own.select(F.split(folded(F.col("content")), " ").alias("words"))
        starts = F.explode(runs(F.size("words"), run))
        rows = split.select("words", starts.alias("start"))
        tables.append(rows.select(F.xxhash64(F.lit(length), F.slice("words", F.col("start") + 1, run)).alias("anchor")))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result.distinct()


def find_benchmark_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, hits, items) for every document.

    ``hits`` are (start, length) of the window occurrences in order, ``n_hit`` counts the
    words inside any of them, ``items`` are the ids (as strings, sorted) of the items with
    an occurring window.  ``text_hash`` is xxhash64 of the text and tells rows apart that
    share an id; equal rows give equal results, each its own.

    Null and empty texts have no words, and neither do such items.  Null ids are kept;
    a null item id counts as "".  Without items nothing is hit.
    """
    keyed = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    windows = stage(item_windows(items.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit(""))), item_id, item_text, window), "item_windows")
    # At most `window` different numbers.
    lengths = sorted(n for (n,) in windows.select("length").distinct().collect())
    found = keyed.withColumn("words", folded_words(F.col("text")))
    anchors = _anchors_of_documents(F.col("words"), lengths) if lengths else F.array().cast("array<bigint>")
    scanned = stage(
        found.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), anchors.alias("anchors")), "anchors"
    )
    plain = scanned.select("doc_id", "text_hash", "n_words")
    no_hits = {
        "n_hit": F.lit(0).cast("long"),
        "hits": F.array().cast("array<struct<start:int,length:int>>"),
        "items": F.array().cast("array<string>"),
    }
    if not lengths:
        return plain.withColumns(no_hits)
    wanted = _sent(stage(_anchors_of_windows(windows, lengths), "item_anchors"))
    suspects = scanned.select("doc_id", "text_hash", F.explode("anchors").alias("anchor")).join(wanted, "anchor", "left_semi")
    suspects = _sent(stage(suspects.select("doc_id", "text_hash").distinct(), "suspects"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("doc_id", "text_hash")]
    texts = keyed.alias("t").join(suspects.alias("s"), same, "left_semi").distinct()
    texts = texts.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    occurring = texts.select("doc_id", "text_hash", F.inline(F.concat(*(_windows(F.col("words"), n) for n in lengths))))
    kinds = _sent(windows.select("length", "content").distinct())
    hits = stage(occurring.join(kinds, ["length", "content"], "left_semi"), "hits")
    spans = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("hits"))
    named = hits.select("doc_id", "text_hash", "length", "content").distinct().join(windows, ["length", "content"])
    named = named.select("doc_id", "text_hash", "item").distinct().groupBy("doc_id", "text_hash")
    named = named.agg(F.sort_array(F.collect_list("item")).alias("items"))
    results = stage(_same_document(spans.withColumn("n_hit", _covered(F.col("hits"))), named, ["hits", "n_hit"], ["items"]), "hit_documents")
    done = _same_document(plain, _sent(results), ["n_words"], ["n_hit", "hits", "items"], "left")
    return done.withColumns({name: F.coalesce(F.col(name), value) for name, value in no_hits.items()})


def _same_document(left: DataFrame, right: DataFrame, from_left: list[str], from_right: list[str], how: str = "inner") -> DataFrame:
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "text_hash")]
    columns = [F.col(f"l.{c}") for c in ("doc_id", "text_hash", *from_left)] + [F.col(f"r.{c}") for c in from_right]
    return left.alias("l").join(right.alias("r"), same, how).select(*columns)


def _covered(hits: Column) -> Column:
    """Words inside any of the spans, which are in order of their starts."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def more(so_far: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        new = F.greatest(F.lit(0), end - F.greatest(hit["start"], so_far["end"]))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["end"], end).alias("end"))

    return F.aggregate(hits, begin, more, lambda x: x["n"])


def merged_spans(hits: Column) -> Column:
    """Spans (start, end) that cover the same words as ``hits``, apart from each other and in order."""
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    none = F.lit(-1)
    begin = F.struct(none.alias("start"), none.alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def more(so_far: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        apart = hit["start"] > so_far["end"]
        ended = apart & (so_far["end"] >= 0)
        closed = F.when(ended, F.concat(so_far["spans"], F.array(span(so_far["start"], so_far["end"])))).otherwise(so_far["spans"])
        start = F.when(apart, hit["start"]).otherwise(so_far["start"])
        last = F.when(apart, end).otherwise(F.greatest(so_far["end"], end))
        return F.struct(start.alias("start"), last.alias("end"), closed.alias("spans"))

    last = lambda x: F.concat(x["spans"], F.array(span(x["start"], x["end"])))
    return F.aggregate(hits, begin, more, lambda x: F.when(x["end"] >= 0, last(x)).otherwise(x["spans"]))


def without_passages(df: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """Every row, its text without the words of the ``hits``, each of which takes along what precedes it.

    ``hits`` are in order of their starts, as :func:`find_benchmark_passages` gives them; null ones
    leave the text as it is.  The time grows with the words and with the hits of a text, not
    with their product.  Columns keep their names, whatever these are.
    """
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.col(text).alias("text"),
        F.when(F.col(hits).isNotNull(), F.regexp_extract_all(text, F.lit(piece), F.lit(0))).alias("pieces"),
        F.when(F.col(hits).isNotNull(), merged_spans(F.col(hits))).alias("spans"),
    )
    # What stays lies behind each span and before the next.
    before = F.transform("spans", lambda s, i: F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"]))
    rows = rows.select("*", F.arrays_zip(before.alias("begin"), F.col("spans.start").alias("end")).alias("gaps"))
    words = lambda begin, end: F.array_join(F.slice("pieces", begin + 1, end - begin), "")
    inner = F.array_join(F.transform("gaps", lambda gap: words(gap["begin"], gap["end"])), "")
    rest = words(F.element_at("spans", -1)["end"], F.size("pieces"))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    cut = F.when(F.size("spans") > 0, F.concat(inner, rest, tail)).otherwise(F.col("text"))
    return rows.select(*((cut if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
