import random

import numpy as np

from gradeloom.llm.queries import op1_toxicity
from gradeloom.llm.toxicity import class_prior, score_toxicity, train_toxicity


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    toxic = [(i, f"{text(30)} Vile{rng.randrange(99)} {text(20)} vile{rng.randrange(99)} NASTY") for i in range(60)]
    return toxic, [(1000 + i, text(60)) for i in range(500)]


def test_learns_from_confirmed_and_unlabelled(spark, table):
    toxic, clean = corpus()
    rows = toxic + clean
    model = train_toxicity(table(rows), spark.createDataFrame([(i,) for i in range(40)], "doc_id long"), 60 / 560)
    odd = [(2000, None), (2001, ""), (2002, "nasty vile7 vile8"), (2002, "nasty vile7 vile8"), (None, "w1"), (2003, "w1 " * 60_000)]
    got = score_toxicity(table(rows + odd), model).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i, _ in toxic) > 0.3 > max(scores[i] for i, _ in clean)
    assert scores[2000] == scores[2001] < 0.3 < scores[2002] and scores[2003] < 0.3


def test_without_confirmed_rows_all_get_the_prior(spark, table):
    none = spark.createDataFrame([], "doc_id long")
    model = train_toxicity(table([(1, "a"), (2, "b")]), none, 0.2)
    assert {round(r.score, 6) for r in score_toxicity(table([(1, "a"), (2, None)]), model).collect()} == {0.2}
    assert class_prior(spark.createDataFrame([], "toxic int")) == 0
    assert score_toxicity(spark.createDataFrame([], "doc_id long, text string, score string"), model).count() == 0


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op1_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    said, true = (np.array([r[c] for r in rows]) == 1 for c in ("predicted", "toxic"))
    assert (said & true).sum() / true.sum() > 0.8 and (said & ~true).sum() / (~true).sum() < 0.02
