"""Records of quoted CSV files, which may hold line breaks, read by many tasks per file.

A line break ends a record only outside quotes, that is after an even number of quotes since the
top of the file.  A first pass counts the quotes of every split of a file; their sums in
file order tell in which state a split begins.  The second pass cuts records at line ends in the even
state.  A record that goes over the end of its split is put together from its pieces, of which
every split has two at most, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom.staging import stage

QUOTE = '"'
_SPLIT = "file string, start long, lines long, quotes long, even boolean, header string"
_RECORDS = "file string, origin long, start long, at long, value string, piece boolean"


def _scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split; only ``\\n`` ends a line, so that what stands in quotes stays as it is."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The split of a run of lines and the lines, in file order; a split may come in several runs."""
    for batch in batches:
        files, starts, values = (batch.column(name) for name in ("file", "start", "value"))
        if not batch.num_rows:
            continue
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        offsets = starts.to_numpy()
        edges = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (offsets[1:] != offsets[:-1])))
        for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
            yield (files[begin].as_py(), int(offsets[begin])), values.slice(begin, end - begin)


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its lines, its quotes, and whether any line ends after an even or odd number of them."""
    state: dict = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for parity in (False, True):
            # Both answers are kept until the state at the begin of the split is known.
            row = {**state, "even": state["ends"][parity]}
            names = [field.split()[0] for field in _SPLIT.split(", ")]
            columns = [pa.array([row[name]], kind) for name, kind in zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
            columns.append(pa.array([int(parity)], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "begins"])

    for (file, start), values in _runs(batches):
        if state and (state["file"], state["start"]) != (file, start):
            yield from counted()
            state = {}
        if not state:
            header = values[0].as_py() if start == 0 else None
            state = {"file": file, "start": start, "lines": 0, "quotes": 0, "ends": [False, False], "header": header}
        sums = state["quotes"] + np.cumsum(_quotes(values))
        odd = (sums & 1).astype(bool)
        state["ends"] = [state["ends"][0] or bool((~odd).any()), state["ends"][1] or bool(odd.any())]
        state["quotes"] = int(sums[-1])
        state["lines"] += len(values)
    if state:
        yield from counted()


def splits_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per split of every file: ``lines``, the state it ``begins`` in (1: within quotes), and ``origin``.

    ``origin`` is the split where the record begins that is open at the begin of this one; ``header``
    is the first line of the file, in its first split.
    """
    counted = stage(_scan(spark, path).mapInArrow(_count, f"{_SPLIT}, begins int"), "splits")
    # One row per split and state, a list that the driver holds to schedule the scan.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = counted.filter("begins = 0").select("file", "start", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("sum"))
    state = whole.select("file", "start", (F.col("sum") % 2).cast("int").alias("begins"))
    known = counted.join(state, ["file", "start", "begins"])
    opens = F.when(F.col("even") | (F.col("begins") == 0), F.col("start"))
    return known.withColumn("origin", F.last(opens, ignorenulls=True).over(before))


def read_records(spark: SparkSession, path: str | list[str], splits: DataFrame | None = None) -> DataFrame:
    """``file``, ``at`` (the place of its line in the split ``start``) and ``value`` of every record but empty ones.

    A record has the line breaks that stand in its quotes.  A file that ends within quotes has all
    that follows them as its last record.  Files that change between the passes fail.
    """
    splits = stage(splits_of(spark, path), "states") if splits is None else splits
    # A few numbers per split, a list that the driver holds to schedule the scan.
    known = {(r["file"], r["start"]): (r["begins"], r["origin"], r["lines"]) for r in splits.collect()}
    shared = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, origin, held, odd, place, expected = None, None, [], 0, 0, 0

        def rows(values: pa.Array, places: np.ndarray, of: int | None, piece: bool) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([split[0]] * n, pa.string()),
                    pa.array([split[1] if of is None else of] * n, pa.int64()),
                    pa.array([split[1]] * n, pa.int64()),
                    pa.array(places, pa.int64()),
                    values,
                    pa.array([piece] * n, pa.bool_()),
                ],
                names=[field.split()[0] for field in _RECORDS.split(", ")],
            )

        def closed() -> Iterator[pa.RecordBatch]:
            """What is open at the end of a split goes on in the next one."""
            if split is None:
                return
            if place != expected:
                raise ValueError("the files or their splits changed while they were read")
            if held:
                yield rows(pa.array(["\n".join(held)], pa.string()), np.array([place - len(held)]), origin, True)

        for key, values in _runs(batches):
            if key != split:
                yield from closed()
                if key not in shared.value:
                    raise ValueError("the files or their splits changed while they were read")
                split, held, place = key, [], 0
                odd, origin, expected = shared.value[key]
                origin = origin if odd else None
            sums = odd + np.cumsum(_quotes(values))
            ends = np.flatnonzero(sums & 1 == 0)
            begins = np.append(0, ends[:-1] + 1) if len(ends) else np.zeros(0, np.int64)
            if len(ends) and (held or origin is not None):
                # The first end here belongs to a record that was open before.
                text = "\n".join([*held, *values.slice(0, int(ends[0]) + 1).to_pylist()])
                yield rows(pa.array([text], pa.string()), np.array([place - len(held)]), origin, origin is not None)
                held, origin = [], None
                begins, ends = begins[1:], ends[1:]
                done = int(begins[0]) if len(begins) else int(np.flatnonzero(sums & 1 == 0)[0]) + 1
            else:
                done = 0
            one = begins == ends
            if one.any():
                yield rows(values.take(pa.array(begins[one])), place + begins[one], None, False)
            if not one.all():
                several = [
                    "\n".join(values.slice(b, e - b + 1).to_pylist()) for b, e in zip(begins[~one].tolist(), ends[~one].tolist())
                ]
                yield rows(pa.array(several, pa.string()), place + begins[~one], None, False)
            done = int(ends[-1]) + 1 if len(ends) else done
            held += values.slice(done).to_pylist()
            odd, place = int(sums[-1]) & 1, place + len(values)
        yield from closed()

    found = _scan(spark, path).mapInArrow(cut, _RECORDS)
    whole = found.filter("NOT piece").select("file", "start", "at", "value")
    # Pieces of one record, in file order; a record has one per split that it goes over.
    pieces = found.filter("piece").groupBy("file", F.col("origin").alias("start"))
    parts = F.sort_array(F.collect_list(F.struct("start", "at", "value")))
    joined = pieces.agg(parts.alias("parts")).select(
        "file", "start", F.element_at("parts", 1)["at"].alias("at"), F.array_join("parts.value", "\n").alias("value")
    )
    ended = F.regexp_replace("value", r"\r\z", "")
    return whole.unionByName(joined).withColumn("value", ended).filter("value <> ''")
