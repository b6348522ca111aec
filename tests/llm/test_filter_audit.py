import random
from itertools import permutations

from pyspark.sql import functions as F

from gradeloom.llm.filter_audit import audit_filters, coalition_removals, count_failures, failure_rows, shapley_coefficients
from gradeloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, failed int, n int, part string"


def test_coefficients_equal_the_mean_over_orders():
    rng = random.Random(1)
    for n in range(1, 6):
        value = [0] + [rng.randrange(10**6) for _ in range((1 << n) - 1)]
        sums = [0] * n
        for order in permutations(range(n)):
            before = 0
            for i in order:
                sums[i] += value[before | 1 << i] - value[before]
                before |= 1 << i
        assert sums == [sum(c * v for c, v in zip(row, value)) for row in shapley_coefficients(n)]


def brute_force(rows, filters):
    """Filters applied one after another to (part, failing letters) rows."""
    found = {}
    for part in {p for p, _ in rows}:
        own = [f for p, f in rows if p == part]
        total = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                out = [f for f in left if letter in f]
                left = [f for f in left if letter not in f]
                redundant = sum(letter in f for f in gone)
                unique = sum(f == {letter} for f in own)
                found[part, "".join(order), step] = [len(left), len(out), redundant, unique, letter]
                gone += out
                total[letter] += len(out)
        for key in found:
            if key[0] == part:
                found[key][4] = total[found[key][4]]
    return {key: tuple(value) for key, value in found.items()}


def documents(spark):
    """Copies, equal ids, nulls in every column and clashing names."""
    rng = random.Random(2)
    words = ["a", "B", "cc", "d#", "EE"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "fr", None]), 1, 2, "x") for i, t in enumerate(texts)]
    rows += [(3, "same", "en", 1, 2, None)] * 2 + [(9, "same", "fr", None, 2, "x"), (None, "same", "en", 1, 2, "x")]
    rows += [(100, None, None, 1, 2, "x"), (101, "", "en", 1, 2, "x"), (102, None, "en", 1, 2, "x")]
    rows += [(103, "w " * 50_000, "en", 1, 2, "x"), (2, "EE same", "en", 1, 2, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_against_filters_applied_in_turn(spark):
    rows, df = documents(spark)
    found = failure_rows(df, [F.length("text") > 6, F.col("text").contains("EE")])
    audit = audit_filters(count_failures(found, copies=2), "LXE").collect()
    of_text = {}
    for i, text, *_ in rows:
        of_text.setdefault(text or "", []).append(i)

    def failing(i, text):
        letters = set("L" * (len(text or "") > 6) + "X" * ("EE" in (text or "")))
        smaller = i is not None and any(j is not None and j < i for j in of_text[text or ""])
        return letters | set("E" * smaller)

    expected = brute_force([(lang or "", failing(i, text)) for i, text, lang, *_ in rows], "LXE")
    assert {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit
    } == expected


def test_marks_count_what_a_step_removes(spark):
    rows = [("p", 1, True), ("p", 3, True), ("p", 3, False), ("p", 0, True), ("p", 2, None)]
    counts = count_failures(spark.createDataFrame(rows, "part string, failed int, good boolean"), ["good"])
    lost = {(r.filter_order, r.step): r.good_lost for r in audit_filters(counts, "AB", {"good": "good_lost"}).collect()}
    assert lost == {("AB", 1): 2, ("AB", 2): 0, ("BA", 1): 1, ("BA", 2): 1}
    table = coalition_removals(counts, 2, ["good"]).orderBy("coalition").collect()
    assert [(r.removed, r.good, r.rows) for r in table] == [(0, 0, 5), (3, 2, 5), (3, 1, 5), (4, 2, 5)]


def test_empty_table(spark):
    empty = failure_rows(spark.createDataFrame([], SCHEMA), [F.length("text") > 6])
    assert audit_filters(count_failures(empty, copies=1), "LE").count() == 0


def test_query_on_odd_documents(spark, tmp_path):
    documents(spark)[1].write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op11_filter_audit"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 * 600
    first = {r.part: r for r in rows if r.filter_order == "ABCDE" and r.step == 1}
    # All texts are short but that of id 103; every row of id 3 is marked, whatever its text.
    marked = sum(r[0] == 3 and r[2] == "en" for r in documents(spark)[0])
    assert (first["en"].kept, first["en"].good_lost, first["en"].toxic_lost) == (1, marked, marked)
