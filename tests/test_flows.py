"""The flows from files to results, against the same steps in pandas."""

import numpy as np
import pandas as pd
import pytest

from gradeloom.operators import classifier, metrics
from gradeloom.plans.error_report import error_slices, evaluated_rows
from gradeloom.operators.joins import merge_with_labels
from gradeloom.plans.label_files import write_run_labels
from gradeloom.plans.training_sets import training_sets
from gradeloom.sources.lines import read_indexed_lines
from gradeloom.sources.tables import read_augmented, read_corpus, read_split_labels, read_unlabelled

COLUMNS = ["par_id", "art_id", "keyword", "country_code", "text", "label"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Input files of a small study."""
    root = tmp_path_factory.mktemp("study")
    draw = np.random.default_rng(11)
    ids = draw.permutation(300)
    corpus = pd.DataFrame({"par_id": ids, "art_id": "a", "country_code": "gb"})
    corpus["keyword"] = draw.choice(["women", "poor", "migrant"], 300)
    corpus["label"] = draw.choice(5, 300, p=[0.5, 0.3, 0.1, 0.05, 0.05])
    corpus["text"] = [
        " ".join(draw.choice(["sad", "poor"] if label > 1 else ["news", "sport"], draw.integers(1, 150))) for label in corpus["label"]
    ]
    corpus.loc[:2, "text"] = ""
    lines = ["terms of use", "see above", *("\t".join(map(str, row)) for row in corpus[COLUMNS].to_numpy())]
    (root / "corpus.tsv").write_text("\n".join(lines) + "\n")
    listed = draw.permutation(310)
    pd.DataFrame({"par_id": listed[:200], "label": "[0]"}).to_csv(root / "train.csv", index=False)
    dev = [i for i in listed[200:] if i < 300]
    pd.DataFrame({"par_id": dev, "label": "[1]"}).to_csv(root / "dev.csv", index=False)
    (root / "dev.txt").write_text("".join(f"{p}\n" for p in draw.integers(0, 2, len(dev))))
    (root / "augmented").mkdir()
    positives = corpus[(corpus["label"] > 1) & corpus["par_id"].isin(listed[:200])]
    for language in ("zh", "de"):
        copies = positives[["par_id", "label"]].assign(text=language + " " + positives["text"])
        copies.to_csv(root / "augmented" / f"{language}.csv", index=False)
    corpus[COLUMNS[:-1]].to_csv(root / "test.tsv", sep="\t", header=False, index=False)
    corpus.to_pickle(root / "corpus.pkl")
    return root


def expected_metrics(rows):
    said, true = rows["prediction"] == 1, rows["label"] == 1
    tp, tn, fn, fp = (int(c.sum()) for c in (said & true, ~said & ~true, ~said & true, said & ~true))
    recall, precision = (tp / n if n else 0 for n in (tp + fn, tp + fp))
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0
    return len(rows), tp, tn, fn, fp, recall, precision, f1, (tp + tn) / len(rows)


def test_error_report_equals_pandas(spark, folder):
    corpus = pd.read_pickle(folder / "corpus.pkl").set_index("par_id")
    rows = corpus.loc[np.loadtxt(folder / "dev.csv", delimiter=",", skiprows=1, usecols=0, dtype=int)]
    lengths = rows["text"].replace("", "nan").str.len()
    rows = rows.assign(
        graded=rows["label"],
        label=(rows["label"] > 1).astype(int),
        prediction=np.loadtxt(folder / "dev.txt", dtype=int),
        bucket=1 + np.searchsorted([128, 256, 384, 512], lengths),
    )

    evaluated = evaluated_rows(
        read_split_labels(spark, str(folder / "dev.csv")),
        read_corpus(spark, str(folder / "corpus.tsv")),
        read_indexed_lines(spark, str(folder / "dev.txt")),
    )
    names = ("n", "tp", "tn", "fn", "fp", "recall", "precision", "f1_score", "accuracy")
    got = {(r["slice"], r["value"]): tuple(r[n] for n in names) for r in error_slices(evaluated).collect()}
    wanted = {("all", "all"): expected_metrics(rows)}
    for kind, column in (("length", "bucket"), ("grade", "graded"), ("keyword", "keyword")):
        wanted |= {(kind, str(value)): expected_metrics(group) for value, group in rows.groupby(column)}
    listed = {*(("length", str(b)) for b in range(1, 6)), *(("grade", str(g)) for g in range(5))}
    assert got.keys() == wanted.keys() | listed
    assert all(got[key] == (0,) * 9 for key in listed - wanted.keys())
    for key, values in wanted.items():
        assert got[key] == pytest.approx(values), key
    by_keyword = [r["keyword"] for r in metrics.metrics_by_keyword(evaluated).collect()]
    assert by_keyword == sorted(by_keyword, key=lambda k: (-wanted["keyword", k][7], k))


def test_from_files_to_predictions(spark, folder):
    corpus = read_corpus(spark, str(folder / "corpus.tsv"))
    sets = training_sets(
        read_split_labels(spark, str(folder / "train.csv")), corpus, read_augmented(spark, str(folder / "augmented")), 2, 2.5
    )
    counts = {(r["label"], r["origin"]): r["count"] for r in sets.rebalanced.groupBy("label", "origin").count().collect()}
    ones = counts[1, "orig"]
    assert counts[0, "orig"] == 2 * ones and counts[1, "aug"] == int(ones * 2.5 - ones)
    final = read_unlabelled(spark, str(folder / "test.tsv"), positions=True)
    dev = merge_with_labels(read_split_labels(spark, str(folder / "dev.csv")), corpus)
    output = str(folder / "runs")
    runs = classifier.search_hyperparameters(sets.train, sets.valid, dev, final, trials=2, output=output)
    best = metrics.best_run(runs, split="valid").head()["run_id"]
    files = write_run_labels(spark, output, best, str(folder / "labels"))
    said = [r["value"] for r in read_indexed_lines(spark, files["final"]).orderBy("row_idx").collect()]
    study = pd.read_pickle(folder / "corpus.pkl")
    # The words tell the label, but for the three texts without words.
    right = (study["label"] > 1).to_numpy() == np.array(said)
    assert len(said) == 300 and right[study["text"] != ""].mean() > 0.95
    again = [r["prediction"] for r in classifier.score(classifier.load_best(spark, output), final).orderBy("row_idx").collect()]
    assert again == said
    assert read_indexed_lines(spark, files["valid"]).count() == dev.count()
