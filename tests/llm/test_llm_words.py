import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import setjoin
from tessera.llm.words import inside, item_words, slices, spaced_words, windows, words_of
from tessera.runtime import BATCH_CONF, bounded_batches

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n.0|", max_size=30)), max_size=6)


def spelled(texts, alphabet):
    found = words_of(pa.array(texts, pa.string()), alphabet)
    return [[found.joined(i, 1) for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:], strict=True)], found


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_a_plain_split(texts):
    got, found = spelled(texts, spaced_words())
    assert got == [(t or "").encode().lower().split() for t in texts]
    by_word = {}
    for words, (a, b) in zip(got, zip(found.first[:-1], found.first[1:], strict=True), strict=True):
        for w, h in zip(words, found.hashes[a:b], strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_item_words_drop_marks_and_keep_letters_outside_ascii():
    got, _ = spelled(["Don't stop-Été 42!", None, "...", ""], item_words())
    assert got == [[b"don", b"t", b"stop", "Été".encode(), b"42"], [], [], []]


def test_windows_do_not_cross_texts():
    _, found = spelled(["a b c", "b c a b c"], spaced_words())
    made, fits = windows(found.hashes, 3), inside(found, 3)
    assert list(np.flatnonzero(fits)) == [0, 3, 4, 5]
    assert made[0] == made[5] and len({made[0], made[3], made[4]}) == 3


def test_slices_cover_every_row_once_and_bound_the_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 900_000, None, "", "y" * 900_000, "z" * 5_000_000, "w"])], names=["t"])
    parts = list(slices(batch, "t"))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes < 3_000_000 for p in parts)


def test_a_large_batch_is_scanned_in_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 1_000] * 400)], names=["t"])
    tracemalloc.start()
    try:
        for part in slices(batch, "t"):
            words_of(part.column(0), spaced_words())
        assert tracemalloc.get_traced_memory()[1] < 50_000_000
    finally:
        tracemalloc.stop()


def test_batches_to_python_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id"), 40_000).alias("text"))
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.unset(BATCH_CONF)
    try:
        setjoin.keep_one(docs)
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 5_000_000
        spark.conf.set(BATCH_CONF, "123456")
        bounded_batches(spark)
        assert spark.conf.get(BATCH_CONF) == "123456"
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)
