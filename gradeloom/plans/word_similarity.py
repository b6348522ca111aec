"""From texts to the similarity of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.joins import vector_pairs
from gradeloom.operators.tokens import sentences_of_words
from gradeloom.operators.word_vectors import train_word_vectors
from gradeloom.staging import stage

# So many words at most are sent to every task.
ASKED = 500_000


def word_similarity(texts: DataFrame, pairs: DataFrame, key: str = "par_id", **training) -> DataFrame:
    """Train word vectors on the sentences of all texts and compare ``a`` with ``b``.

    Only the vectors of words in ``pairs`` are dealt out for the comparison.
    """
    asked = stage(pairs.select(F.explode(F.array("a", "b")).alias("word")).distinct(), "asked")
    sentences = sentences_of_words(texts, key)
    vectors = train_word_vectors(sentences, **training)
    few = asked.count() <= ASKED
    wanted = vectors.join(F.broadcast(asked) if few else asked, "word", "left_semi")
    return vector_pairs(pairs, wanted, "a", "b", "word", "vector")
