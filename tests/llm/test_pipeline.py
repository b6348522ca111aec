import hashlib
import random

import pytest

import corpus_pipeline


@pytest.fixture
def folder(spark, tmp_path):
    """Tables with planted toxic texts, copies, shared passages and benchmark passages."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7)))
    common = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(common) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") for _ in range(n))
    clean = {i: text(120) for i in range(60)}
    toxic = {1000 + i: text(40) + " nasty1 " + text(40) + " nasty2 nasty1" for i in range(30)}
    passage, item = text(55), text(20)
    shared = {2000 + i: f"{text(60)} {passage} {text(60)}" for i in range(3)}
    leaked = {3000: f"{text(50)}, {item}! {text(50)}"}
    copies = {4000 + i: clean[i] for i in range(5)}
    odd = {5000: None, 5001: "", 5002: "one", 5003: "long " * 20_000}
    texts = clean | toxic | shared | leaked | copies | odd
    rows = [(d, t, "en", "s", len(t or ""), "x") for d, t in texts.items()] + [(0, clean[0], "en", "s", 1, "x")]
    labels = [(d, 1, int(d >= 1000)) for d in [*clean, *toxic] if d % 3 or d < 20]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    save("documents", rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    save("labels", labels, "doc_id long, quality int, toxic int")
    save("benchmark", [(7, item), (8, None), (9, "")], "item_id long, text string")
    return str(tmp_path), clean, toxic, passage, item, shared


def test_planted_cases(spark, folder):
    path, clean, toxic, passage, item, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, path)
        assert docs.columns == columns, name
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not set(toxic) & set(texts)
    assert not {4000 + i for i in range(5)} & set(texts)
    assert docs.count() == len(texts)
    assert {i: texts.get(i) for i in clean} == clean
    for i, whole in shared.items():
        assert texts[i] == " ".join(whole.replace(passage, "").split())
    assert texts[3000].count(" ") < 115 and item not in texts[3000] and texts[3000].endswith(texts[3000].split("!")[-1])
    # Null, empty and single words share no window; the first two are copies of each other.
    assert 5001 not in texts and 5000 in texts and texts[5002] == "one" and texts[5003] == ""


def test_run_encodes_what_is_left(spark, folder):
    path, clean, *_ = folder
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert all(r.round_trip for r in rows.values())
    assert all(rows[i].n_tokens == len(rows[i].ids) > 0 for i in clean)
    assert hashlib.sha256(rows[1].text.encode()).digest() == hashlib.sha256(clean[1].encode()).digest()
