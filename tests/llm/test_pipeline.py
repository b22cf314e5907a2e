"""The stages of the pipeline against plain versions, and on odd rows."""

from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from featsieve.llm import credential_links as links, crf_language as crf, dart_minhash as darts, packing, poisson_mix as mix


def test_stages_follow_each_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    first = pipe.language_id(spark, docs, data).cache()
    assert first.columns == docs.columns and first.count() > 0.95 * docs.count()
    second = pipe.near_dedup(spark, first, data).cache()
    classes = darts.near_duplicates(first).collect()
    assert sorted(r.doc_id for r in second.select("doc_id").collect()) == sorted({r.class_id for r in classes})
    third = pipe.secret_scan(spark, second, data).cache()
    for a, b in zip(second.orderBy("doc_id").collect(), third.orderBy("doc_id").collect()):
        strong = links.base_spans(a.text)
        assert b.text == links.redacted(a.text, strong + links.linked(strong, links.weak_spans(a.text, strong)))
        assert not links.base_spans(b.text) and b.n_chars == len(b.text)
    fourth = pipe.source_mix(spark, third, data).cache()
    rates = mix.source_rates(third)
    counted = third.join(rates, "source").select("doc_id", mix.poisson_count(F.col("rate"), mix.SEED, F.col("doc_id")).alias("n"))
    assert Counter(r.doc_id for r in fourth.select("doc_id").collect()) == Counter({r.doc_id: r.n for r in counted.collect() if r.n})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = pipe.pack(spark, fourth, data).collect()
    assert sum(r.length for r in last) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in fourth.collect())


def test_run_gives_the_stages_rows(spark, data):
    assert pipe.run(spark, data).count() > 0 and len(pipe.STAGES) == 5


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_no_rows(spark, odd, empty, k):
    name, stage = pipe.STAGES[k]
    got = stage(spark, odd, None)
    assert stage(spark, empty, None).count() == 0
    if k < 4:
        assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if name == "language_id":
        assert not {2, 3, 4} & set(ids) and {1, 5, 10, 11} <= set(ids)
    elif name == "near_dedup":
        assert ids == Counter({i: 1 for i in (1, 2, 4, 5, 6, None, 9, 10)})
    elif name == "secret_scan":
        assert sum(ids.values()) == odd.count()


def test_repeated_rows_become_one(spark, odd):
    twice = odd.filter("doc_id = 5").union(odd.filter("doc_id = 5"))
    assert pipe.near_dedup(spark, twice, None).count() == 1


def test_nothing_is_rejected_without_a_labelled_row(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert crf.learn(unlabelled).langs == [] and pipe.language_id(spark, unlabelled, None).count() == odd.count()


def test_clashing_columns_keep_their_values(spark, odd):
    for _, stage in pipe.STAGES[:4]:
        assert {(r.spans, r.lang_pred, r.class_id) for r in stage(spark, odd, None).collect()} == {("x", 3, 2)}


def test_columns_of_any_name_pass_every_stage(spark, odd):
    names = ["_doc", "_t1", "_t2", "_class", "_late", "_source", "_of", "_copies", "a.b", "_extra0"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert all(list(r)[5:] == list(range(len(names))) for r in docs.collect()), name
    mixed = mix.mix_sources(odd.select("doc_id", "text", "source", *[F.lit(i).alias(c) for i, c in enumerate(names)]))
    assert mixed.columns == ["doc_id", "text", "source", *names, "rate", "copy_no", "shuffle_key"] and mixed.count() >= 0


@pytest.mark.parametrize("k", range(5))
def test_texts_reach_python_in_small_batches(spark, odd, k):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    spark.conf.unset(pipe.BATCHES)
    try:
        pipe.STAGES[k][1](spark, odd, None)
        got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 900 and max(r.bytes for r in got) < 2_500_000
        spark.conf.set(pipe.BATCHES, "3000")  # the session's own limit stays
        pieces = pipe.STAGES[4][1](spark, odd, None).collect()
        assert spark.conf.get(pipe.BATCHES) == "3000"
    finally:
        spark.conf.unset(pipe.BATCHES)
    assert sorted(map(str, pieces)) == sorted(map(str, packing.packing_rows(odd).collect()))
