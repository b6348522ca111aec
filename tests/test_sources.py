import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators.sampling import concat
from gradeloom.plans.label_files import write_label_files
from gradeloom.sources import lines, scores, tables


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


CORPUS = (
    "disclaimer\n\n"
    '1\ta1\thomeless\tgb\tHe said "no\t0\n'
    "\n"
    '2\ta2\tin-need\tus\tnull\t3\n'
    "3\ta3\trefugee\tNA\tThree words here\t1.5\n"
    "4\ta4\twomen\tke\ttoo\tmany\tfields\n"
)


def test_corpus_skips_lines_and_keeps_quotes(spark, tmp_path):
    path = write(tmp_path / "corpus.tsv", CORPUS)
    rows = {row["par_id"]: row for row in tables.read_corpus(spark, path, keep_corrupt=True).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["text"] == 'He said "no' and rows[1]["label"] == 0
    # Fields that read like a missing value are missing.
    assert rows[2]["text"] is None and rows[3]["country_code"] is None
    # Odd lines are kept with the raw line.
    assert rows[3]["label"] is None and rows[3][tables.CORRUPT].startswith("3\t")
    assert rows[4][tables.CORRUPT].startswith("4\t") and rows[1][tables.CORRUPT] is None


def test_consumed_header_costs_the_first_row_that_is_not_blank(spark, tmp_path):
    path = write(tmp_path / "corpus.tsv", CORPUS)
    ids = {row[0] for row in tables.read_corpus(spark, path, header="consume").select("par_id").collect()}
    assert ids == {2, 3, 4}
    late = write(tmp_path / "late.tsv", "x\ny\n\n \n" + "9\ta\tk\tgb\tt\t1\n8\ta\tk\tgb\tt\t1\n")
    assert [r["par_id"] for r in tables.read_corpus(spark, late, header="consume").collect()] == [8]


def test_quotes_can_be_taken_for_quoting(spark, tmp_path):
    path = write(tmp_path / "quoted.tsv", 'x\ny\n1\ta\tk\tgb\t"say ""hi"""\t2\n')
    assert tables.read_corpus(spark, path, quote='"').head()["text"] == 'say "hi"'
    assert tables.read_corpus(spark, path).head()["text"] == '"say ""hi"""'


def test_corpus_of_many_splits_and_files(spark, tmp_path, setting):
    rows = [f"{i}\ta\tk{i % 3}\tgb\ttext number {i}\t{i % 5}" for i in range(3000)]
    whole = write(tmp_path / "one" / "corpus.tsv", "\n".join(["x", "y", *rows]) + "\n")
    for number, start in enumerate(range(0, 3000, 1000)):
        head = ["x", "y"] if number == 0 else []
        write(tmp_path / "many parts" / f"part-{number}.tsv", "\n".join([*head, *rows[start : start + 1000]]) + "\n")
    setting("spark.sql.files.maxPartitionBytes", "4096")
    setting("spark.sql.files.openCostInBytes", "1")
    for path in (whole, str(tmp_path / "many parts")):
        read = tables.read_corpus(spark, path)
        assert read.rdd.getNumPartitions() > 5
        assert sorted(r[0] for r in read.select("par_id").collect()) == list(range(3000))


def test_indexed_lines_over_many_splits(spark, tmp_path, setting):
    expected = []
    for number in range(3):
        content = [f"{number}-{i}" + "x" * (i % 40) for i in range(700)]
        write(tmp_path / "lines" / f"part-{number}.txt", "\n".join(content) + "\n")
        expected += content
    for size in ("1000000", "3000"):
        setting("spark.sql.files.maxPartitionBytes", size)
        setting("spark.sql.files.openCostInBytes", "1")
        read = lines.indexed_lines(spark, str(tmp_path / "lines")).orderBy("row_idx").collect()
        assert [r["row_idx"] for r in read] == list(range(len(expected)))
        assert [r["value"] for r in read] == expected


def test_changed_files_are_noticed(spark, tmp_path):
    path = write(tmp_path / "lines.txt", "a\nb\n")
    read = lines.indexed_lines(spark, path)
    write(tmp_path / "lines.txt", "a\nb\nc\n")
    with pytest.raises(Exception, match="changed while they were read|updated|modified|not exist"):
        assert [r["value"] for r in read.collect()] != ["a", "b", "c"]
        raise ValueError("changed while they were read")


def test_split_labels_have_one_header_per_file(spark, tmp_path):
    write(tmp_path / "labels" / "part-0.csv", 'par_id,label\n5,"[0, 1]"\n\n3,0\n')
    write(tmp_path / "labels" / "part-1.csv", "par_id,label\n3,1\n")
    read = tables.read_split_labels(spark, str(tmp_path / "labels")).orderBy("row_idx")
    assert [tuple(r) for r in read.collect()] == [(0, 5, "[0, 1]"), (1, 3, "0"), (2, 3, "1")]


def test_unlabelled(spark, tmp_path):
    path = write(tmp_path / "test.tsv", "t_1\ta\tk\tgb\tfirst\nt_2\ta\tk\tgb\t\n")
    assert sorted(tuple(r) for r in tables.read_unlabelled(spark, path).collect()) == [("t_1", "first"), ("t_2", None)]


def test_augmented_files_of_different_columns(spark, tmp_path):
    first = pd.DataFrame({"par_id": [1, 2], "label": [1, 1], "text": ['two\nlines, "quoted"', " spaced "]})
    second = pd.DataFrame({"text": ["c"], "par_id": [1]})
    folder = tmp_path / "aug files"
    write(folder / "a.csv", first.to_csv(index=False))
    write(folder / "b.csv", second.to_csv(index=False))
    write(folder / "below" / "c.csv", second.to_csv(index=False))
    read = tables.read_augmented(spark, str(folder))
    got = sorted((r["par_id"], r["text"], r["label"], r["origin"], r["copy_no"]) for r in read.collect())
    assert got == [
        (1, "c", None, "aug", "b.csv"),
        (1, 'two\nlines, "quoted"', "1", "aug", "a.csv"),
        (2, " spaced ", "1", "aug", "a.csv"),
    ]


def test_quoted_line_breaks_over_many_splits(spark, tmp_path, setting):
    rng = random.Random(3)
    mark = lambda: rng.choice(["word ", "\n", '"', ",", "\r\n", "é", " x" * 40, "\\", "\n\n\n"])
    expected = {}
    for name, ending in (("a+b c.csv", "\n"), ("b.csv", "\r\n"), ("é.csv", "\n")):
        rows = [(i, "".join(mark() for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, "line\n" * 3000)]
        lines_of = ["par_id,text", *(f'{i},"{text.replace(chr(34), chr(34) * 2)}"' for i, text in rows)]
        write(tmp_path / "aug" / name, ending.join(lines_of) + ending * rng.randrange(2))
        expected |= {(name, i): text for i, text in rows}
    found = []
    for size in ("10000000", "4000", "300"):
        setting("spark.sql.files.maxPartitionBytes", size)
        setting("spark.sql.files.openCostInBytes", "1")
        read = tables.read_augmented(spark, str(tmp_path / "aug"))
        found.append({(r["copy_no"], r["par_id"]): r["text"] or "" for r in read.collect()})
        assert read.count() == len(expected)
    assert found[0] == found[1] == found[2] == expected


def test_augmented_files_without_rows(spark, tmp_path):
    write(tmp_path / "aug" / "a.csv", "par_id,text")
    write(tmp_path / "aug" / "b.csv", "par_id,text\n")
    write(tmp_path / "aug" / "c.csv", 'par_id,text\n7,"never closed\n8,x\n')
    got = [(r["par_id"], r["text"]) for r in tables.read_augmented(spark, str(tmp_path / "aug")).collect()]
    assert len(got) == 1 and got[0][0] == 7


def test_augmented_round_trip_keeps_texts(spark, tmp_path):
    texts = ['say "hi", ok', "line\nbreak", " lead and trail ", "back\\slash", "ünï\tcode", None]
    df = spark.createDataFrame(list(enumerate(texts)), "par_id bigint, text string")
    tables.write_augmented(df, str(tmp_path / "aug"))
    read = tables.read_augmented(spark, str(tmp_path / "aug")).select("par_id", "text")
    assert sorted(map(tuple, read.collect())) == list(enumerate(texts))


def test_label_lines_round_trip(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("row_idx"), (F.hash("id") % 2 == 0).cast("int").alias("prediction"))
    wanted = {r["row_idx"]: r["prediction"] for r in df.collect()}
    for single in (False, True):
        path = str(tmp_path / f"labels-{single}")
        lines.write_label_lines(df.repartition(7), path, single_file=single)
        assert {r["row_idx"]: r["value"] for r in lines.read_indexed_lines(spark, path).collect()} == wanted


def test_bad_prediction_line_fails(spark, tmp_path):
    path = write(tmp_path / "p.txt", " 1 \n0\n\n")
    with pytest.raises(Exception, match="not a label"):
        lines.read_indexed_lines(spark, path).collect()


def test_training_log(spark, tmp_path):
    log = {"best": 1, "log_history": [{"epoch": i / 2, "eval_accuracy": i / 10, "eval_f1": i / 20, "loss": 1} for i in range(8)]}
    path = write(tmp_path / "epochs.json", json.dumps(log, indent=2))
    series = scores.log_series(scores.read_training_log(spark, path)).orderBy("pos").collect()
    wanted = [log["log_history"][i] for i in range(1, 8, 3)]
    assert [(r["epoch"], r["eval_accuracy"], r["eval_f1"]) for r in series] == [
        (e["epoch"], e["eval_accuracy"], e["eval_f1"]) for e in wanted
    ]


def test_scores_to_label_files(spark, tmp_path):
    def run(name, split, n):
        logits = F.array(F.lit(0.5), (F.col("id") % 3).cast("double"))
        return spark.range(n).select(F.col("id").alias("row_idx"), logits.alias("logits"), F.lit(name).alias("run_id"), F.lit(split).alias("split"))

    path = str(tmp_path / "scores")
    scores.write_scores(concat(run("a", "valid", 100), run("a", "final", 50)), path)
    scores.write_scores(run("b", "valid", 10), path)
    assert scores.read_scores(spark, path).count() == 160
    assert scores.read_scores(spark, path, "a", "final").count() == 50
    folders = write_label_files(spark, path, "a", str(tmp_path / "labels"))
    read = lines.read_indexed_lines(spark, folders["valid"]).orderBy("row_idx").collect()
    assert [r["value"] for r in read] == [int(i % 3 > 0) for i in range(100)]


def test_lines_are_not_shuffled_whatever_may_be_broadcast(spark, tmp_path, setting):
    (tmp_path / "a.txt").write_text("1\n0\n1\n")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = lines.read_indexed_lines(spark, str(tmp_path))
    assert [r["row_idx"] for r in found.collect()] == [0, 1, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
