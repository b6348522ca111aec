import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from gradeloom.llm.fingerprints import ATTEMPTS, BINS, SHINGLE, edited_texts, hex_digits, likeness, with_fingerprint
from gradeloom.llm.queries import QUERIES


def shingles(text):
    words = (text or "").lower().split()
    return [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed)
    return seed


def number(i):
    return i.to_bytes(4, "little", signed=True)


def fingerprint(text):
    """The same by dictionaries and plain loops."""
    bins = {}
    for words in shingles(text):
        h = chained([w.encode() for w in words] or [b""])
        at = (h >> 56) - 256 * (h >> 63) + 128
        bins[at] = min(bins.get(at, h), h)
    out = []
    for i in range(BINS):
        drawn = (signed(chained([number(i), number(t)])) % BINS for t in range(ATTEMPTS))
        order = lambda j: signed(chained([number(i), number(j), number(ATTEMPTS)]))
        asked = i if i in bins else next((j for j in drawn if j in bins), None)
        out.append(bins[min(bins, key=order) if asked is None else asked] & 15)
    return "".join(f"{d:x}" for d in out)


def jaccard(a, b):
    a, b = ({tuple(s) for s in shingles(x)} for x in (a, b))
    return len(a & b) / len(a | b)


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 6, 30, 400]))) for _ in range(n)]


ODD = [None, "", " \n\t", "one", "One", "a b c d e", "ééé Ünï ß", "long word " * 4000, "x" * 100_000]


def test_fingerprints_equal_plain_loops(spark, table):
    rows = list(enumerate(texts(40) + ODD))
    found = with_fingerprint(table(rows)).select("doc_id", "text", hex_digits("fingerprint").alias("f")).collect()
    assert {r.doc_id: r.f for r in found} == {i: fingerprint(t) for i, t in rows}


def test_likeness_is_near_the_jaccard_similarity(spark, table):
    rng = random.Random(4)
    pairs = []
    for k, text in enumerate(t for t in texts(120) if t.count(" ") > 300):
        words = text.split()
        for _ in range(k % 20):
            words[rng.randrange(len(words))] = "changed"
        pairs.append((text, " ".join(words)))
    df = table([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, a string, b string")
    both = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb")
    found = both.select("a", "b", likeness("fa", "fb").alias("near")).collect()
    errors = [r.near - jaccard(r.a, r.b) for r in found]
    assert len(found) > 10 and abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2
    assert all(r.near == 1 for r in found if r.a == r.b)


def test_clashing_columns_stay(spark, table):
    df = table([(1, "a b", "w", 3)], "doc_id long, text string, words string, bins int")
    row = with_fingerprint(df).first()
    assert (row.words, row.bins, len(row.fingerprint)) == ("w", 3, BINS // 2)


def edited(rows):
    """Edited text and next text by document."""
    of = sorted(set(rows), key=lambda r: (r[0] is not None, r[0], key(r)))
    out = {}
    for k, (i, t) in enumerate(of):
        t, following = t or "", of[(k + 1) % len(of)][1] or ""
        half = len(t) // 2
        out[i, t] = (t[: len(t) - half] + following[:half], following)
    return out


def key(row):
    inner = hashlib.md5((row[1] or "").encode()).hexdigest()
    return hashlib.md5(f"{'-' if row[0] is None else row[0]}:{inner}".encode()).digest()


def test_edited_texts(spark, table):
    rows = list(enumerate(texts(60) + ODD)) + [(7, "again"), (7, "again"), (None, "no id"), (3, "third of that id 3 3 3")]
    found = edited_texts(table([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, n_chars string"))
    expected = edited(rows)
    got = found.collect()
    assert len(got) == len(rows)
    by_edit = {}
    for r in got:
        by_edit.setdefault((r.doc_id, r.edited), []).append(r)
    for (i, t), (text, following) in expected.items():
        assert (i, text) in by_edit, (i, t[:50])
        r = by_edit[i, text][0]
        assert r.n_chars == len(t)
        prints = [f.hex() for f in (r.fingerprint, r.edited_fingerprint, r.next_fingerprint)]
        assert prints == [fingerprint(x) for x in (t, text, following)]


def test_empty_and_single(spark, table):
    assert edited_texts(table([])).count() == 0
    only = edited_texts(table([(5, "abcd")])).first()
    assert (only.edited, only.fingerprint) == ("abab", only.next_fingerprint)


def test_query(spark, sf_dir):
    found = QUERIES["op13_fingerprints"](spark, sf_dir).collect()
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = edited(list(documents.items()))
    assert len(found) == len(documents)
    errors = []
    for r in found:
        text, (changed, following) = documents[r.doc_id], expected[r.doc_id, documents[r.doc_id] or ""]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(text or "")
        assert len(r.fingerprint) == len(r.edited_fingerprint) == BINS
        errors += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, following)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(map(abs, errors)) / len(errors) < 0.05
