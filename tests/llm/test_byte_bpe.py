import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gradeloom.llm.byte_bpe import RankQueue, Vocabulary, decode, encode, read_ranks
from gradeloom.llm.words import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(2)
    marks = "abcdeE  \t\n\r\x0b\x1c\x1f\x85\xa0​ 　'sßéñ漢字🙂١²_-<|endoftext|>0123456789́"
    found = [None, "", " ", "a", "aaaa" * 5000, "ab" * 4001, "I'll don't  we've\n\n x", "<|endoftext|>", "=" * 301, " " * 777 + "x"]
    found += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    found += ["the quick brown fox jumps over the lazy dogs, Übergrößenträger pneumonoultramicroscopic"] * 3
    return found


def test_equals_library_and_round_trip(spark, table, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(0, "twice"), (None, "no id")]
    got = decode(encode(table(rows), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for row in got:
        value = row.text or ""
        assert row.ids == library.encode_ordinary(value)
        assert bytes(row.decoded) == value.encode()


def slow(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 10**9), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_vocabularies_whose_merges_open_lower_ranks():
    rng = random.Random(4)
    for _ in range(30):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)}
        order = list(tokens)
        rng.shuffle(order)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        vocabulary = Vocabulary(ranks)
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a" * 99]
        ids, begins = vocabulary.merge(*text_bytes(pa.array(pieces)))
        for i, piece in enumerate(pieces):
            assert ids[begins[i] : begins[i + 1]].tolist() == slow(ranks, piece.encode())


def test_queue_gives_lowest_rank_first():
    rng = random.Random(6)
    queue, model = RankQueue(300_000), {}
    for step in range(3000):
        if rng.random() < 0.6:
            rank = rng.randrange(300_000)
            queue.push(rank, np.array([step]))
            model.setdefault(rank, []).append(step)
        elif model:
            rank, positions = queue.pop()
            assert rank == min(model) and positions.tolist() == sorted(model.pop(rank))
    while model:
        assert queue.pop()[0] == min(model) and model.pop(min(model))
    assert queue.pop() is None


def test_clashing_names_empty_table_and_bad_ids(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    empty = decode(encode(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN), PATH)
    assert empty.count() == 0
    row = decode(encode(spark.createDataFrame([(1, "ab", "x", 3)], schema), PATH, public_tokenizers.PATTERN), PATH).first()
    assert bytes(row.decoded) == b"ab"
    assert decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([([60_000],)], "ids array<int>"), PATH).collect()


def test_query(spark, sf_dir, library):
    from gradeloom.llm.queries import op9_byte_bpe

    got = {r.doc_id: r for r in op9_byte_bpe(spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
