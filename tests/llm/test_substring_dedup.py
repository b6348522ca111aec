import random
import re
from collections import Counter

import pytest

from gradeloom.llm.substring_dedup import remove_repeated_passages


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    counts = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    result = []
    for (doc_id, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        result.append((doc_id, len(words), len(gone), kept, tuple(sorted(gone))))
    return sorted(result, key=repr)


def places(spans):
    return tuple(i for s in spans for i in range(s.start, s.end))


def some_rows():
    rng = random.Random(1)
    words = ["a", "B", "é", "d d", "e,", "ü"]
    passage = [rng.choice(words) + str(rng.randrange(50)) for _ in range(60)]
    rows = []
    for i in range(30):
        own = [rng.choice(words) + str(rng.randrange(1000)) for _ in range(rng.randint(0, 80))]
        cut = rng.randrange(len(own) + 1)
        part = passage[rng.randrange(20) : rng.randrange(25, 60)] if i % 3 else []
        rows.append((i, " ".join(own[:cut]) + " \n" + "\t".join(part) + "  " + " ".join(own[cut:])))
    rows += [(50, None), (51, ""), (52, " \n "), (53, "a " * 100), (54, " ".join(passage)), (54, " ".join(passage)), (None, "x y z")]
    rows.append((60, " ".join(str(i % 7001) for i in range(15_000))))
    return rows


@pytest.mark.parametrize("window,anchor", [(35, 8), (5, 5), (6, 1)])
def test_equals_brute_force(table, window, anchor):
    rows = some_rows()
    got = remove_repeated_passages(table(rows), window=window, anchor=anchor, width=1 << 16)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept, places(r.removed)) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows, window)


def test_full_sketch_loses_nothing(table):
    rows = [(i, " ".join(str((i * 7 + j) % 900) for j in range(600))) for i in range(400)] + some_rows()
    got = remove_repeated_passages(table(rows), window=10, anchor=2, width=1 << 16, depth=1)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept, places(r.removed)) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows, 10)


def test_small_blocks_agree(table, monkeypatch):
    monkeypatch.setattr("gradeloom.llm.blocks.BLOCK_BYTES", 300)
    rows = some_rows()
    got = remove_repeated_passages(table(rows), window=8, width=1 << 16)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept, places(r.removed)) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows, 8)


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, n_words string, kept int, block int, docs int, answers int"
    assert remove_repeated_passages(spark.createDataFrame([], schema)).count() == 0
    row = remove_repeated_passages(spark.createDataFrame([(1, "a b", "x", 1, 2, 3, 4)], schema)).collect()[0]
    assert (row.n_words, row.kept, row.block, row.docs, row.answers) == (2, "a b", 2, 3, 4)


def test_bad_parameters(table):
    with pytest.raises(ValueError):
        remove_repeated_passages(table([(1, "a")]), width=100_000)
    with pytest.raises(ValueError):
        remove_repeated_passages(table([(1, "a")]), window=3, anchor=4)
