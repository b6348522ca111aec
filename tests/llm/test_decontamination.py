import random
import re

import pytest

from gradeloom.llm.decontamination import find_benchmark_passages, without_passages


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window):
    wanted = []
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        wanted += [(str(item), tuple(words[i : i + n])) for i in range(len(words) - n + 1) if n]
    result = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, run in wanted:
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found.add(item)
        result.append((doc_id, len(words), len(hit), sorted(found)))
    return sorted(result, key=repr)


LONG = "Alpha beta GAMMA delta; epsilon zeta eta theta iota kappa lambda Ñandú ΣΑΣ'x élan"
ITEMS = [(1, LONG), (2, "short item here"), (10, "SHORT item, here"), (3, "one"), (4, ""), (5, None), (6, "ein Über-Satz mit sechs"), (7, LONG)]
DOCS = [
    (1, f"before {LONG} after"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota other kappa"),
    (4, None),
    (5, ""),
    (6, "a short item here and a short item here; One!"),
    (6, "a short item here and a short item here; One!"),
    (6, "same id, other text"),
    (None, "Ein Über satz mit sechs"),
    (7, "ein über satz mit sechs"),
    (8, "x " * 30_000 + LONG.upper().replace("Ñ", "ñ")),
    (9, f"{LONG} {LONG} {LONG}"),
    (10, " ; "),
]


@pytest.mark.parametrize("window", [10, 4])
def test_equals_brute_force(table, spark, window):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_benchmark_passages(table(DOCS), items, window=window)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == brute(DOCS, ITEMS, window)


def test_without_items_and_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_benchmark_passages(table(DOCS), none).collect()} == {0}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_benchmark_passages(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0


def test_words_outside_of_hits_stay(spark, table):
    docs = table([(1, f"Before, {LONG}. And after!"), (2, " nothing  here ")])
    found = find_benchmark_passages(docs, spark.createDataFrame([(1, LONG)], "item_id long, text string"))
    kept = without_passages(docs.join(found.select("doc_id", "hits"), "doc_id")).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(1, "Before. And after!"), (2, " nothing  here ")]


def test_cuts_equal_a_word_by_word_cut(spark, table):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))) for i in range(12)]
    docs = [(i, "".join(rng.choice(["a ", "B, ", "c", " d.", "e! "]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(100, "a " * 20_000 + "z a"), (101, None)]
    df = table([(*d, "x", [1]) for d in docs], "doc_id long, text string, pieces string, spans array<int>")
    found = find_benchmark_passages(df, spark.createDataFrame(items, "item_id long, text string"), window=3)
    got = without_passages(df.join(found.select("doc_id", "hits"), "doc_id"))
    assert got.columns == ["doc_id", "text", "pieces", "spans", "hits"]
    piece = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    some = 0
    for row in got.collect():
        text = dict(docs)[row.doc_id]
        inside = {i for h in row.hits for i in range(h.start, h.start + h.length)}
        pieces = piece.findall(text or "")
        kept = "".join(p for i, p in enumerate(pieces) if i not in inside) + (text or "")[sum(map(len, pieces)) :]
        assert row.text == (kept if text is not None else None)
        some += bool(inside)
    assert some > 20
