import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.llm.queries import QUERIES
from gradeloom.llm.spelling import gram_dictionary, near_words, spelling_variants


def near_pairs(words):
    """All pairs of words that one edit turns into each other, by marked and shortened words."""
    marked, near = defaultdict(set), set()
    for word in words:
        for i in range(len(word)):
            marked[word[:i] + "\0" + word[i + 1 :]].add(word)
            shorter = word[:i] + word[i + 1 :]
            if shorter in words:
                near.add(frozenset((word, shorter)))
    for alike in marked.values():
        near |= {frozenset((a, b)) for a in alike for b in alike if a < b}
    return near


def variants(words, ratio=10):
    near = defaultdict(set)
    for pair in near_pairs(words):
        a, b = pair
        near[a].add(b)
        near[b].add(a)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= ratio * words[word]:
            form[word] = best
    found = {}
    for word in words:
        root = word
        while root in form:
            root = form[root]
        found[word] = (words[word], len(near[word]), form.get(word), words[form[word]] if word in form else None, root)
    return found


def vocabulary(n, alphabet, sizes, seed=1):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(n)}
    return {word: rng.choice([2, 3, 20, 35, 400, 5000]) for word in words}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)


@pytest.mark.parametrize("max_list", [2, 16, 128])
@pytest.mark.parametrize("max_frequent", [3, 50, 10_000])
def test_all_pairs_are_found(spark, max_list, max_frequent):
    words = vocabulary(1500, "abé", range(7, 11)) | vocabulary(200, "xyz🙂", range(7, 9), seed=2)
    found = near_words(frame(spark, words), max_frequent, max_list).collect()
    pairs = [frozenset((r.word, r.other)) for r in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near_pairs(words)
    assert all(r.n == words[r.word] and r.other_n == words[r.other] for r in found)


def test_one_letter_and_very_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcd") for _ in range(3000))
    words = {"a" * n: n for n in range(3, 120)} | {long: 2, long[:-1]: 3, long[1:]: 4, long[:70] + "z" + long[71:]: 5}
    found = near_words(frame(spark, words), max_list=4).collect()
    assert {frozenset((r.word, r.other)) for r in found} == near_pairs(words)


def test_groups_that_share_most_of_a_word(spark):
    """Far more words than a list may hold differ in one place or in two."""
    letters = [chr(0xC0 + i) for i in range(60)]
    words = {f"begins{a}{b}ending": 2 for a in letters[:40] for b in letters[:40]} | {f"begins{a}ending": 50 for a in letters}
    found = variants(words)
    rows = spelling_variants(frame(spark, words), max_list=32).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == found


def test_forms_and_roots(spark):
    words = vocabulary(1200, "ab", range(7, 12), seed=3)
    rows = spelling_variants(frame(spark, words), ratio=2).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == variants(words, ratio=2)
    assert any(r.root != r.form for r in rows if r.form)


def test_frequent_grams_stay_below_their_bound(spark):
    words = frame(spark, vocabulary(3000, "abc", range(7, 12), seed=4))
    for bound in (10, 100, 1000):
        assert len(gram_dictionary(words, bound).hashes) <= bound


def test_empty_and_too_short(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        near_words(frame(spark, {"ab": 3, "abcdefgh": 2}))


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(6)
    known = list(vocabulary(300, "abcdÉé", range(6, 10), seed=7))
    texts = [" ".join(rng.choice(known).capitalize() for _ in range(40)) for _ in range(150)]
    texts += [None, "", "x", "1234567 __", "Same Words " * 500, "ÀÖ×÷ÿabc ÀÖ×÷ÿabc", "y" * 50_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    letters = {chr(c) for c in range(0xC0, 0x100)} | set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for i, text, _ in rows:
        for run in "".join(c if c in letters else " " for c in text or "").split(" "):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) > 6
    words = {word: n for word, n in counts.items() if n > 1}
    found = QUERIES["op12_spelling"](spark, str(tmp_path)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == variants(words)
    assert any(r.form for r in found)
