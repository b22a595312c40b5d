"""The packed sequences of the pipeline, decoded, are the texts that its stages kept."""

import os
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from confluo.llm import tokens
from confluo.session import ensure_checkpoint_dir


def test_sequences_are_the_kept_texts(spark, sf_dir):
    if not os.path.exists(tokens.default_tokenizer(spark)):
        pytest.skip("no tokenizer here")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    want = {r.doc_id: r.text + tokens.END for r in docs.collect()}
    before = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    packed = pipeline.run(spark, sf_dir)
    e = tokens.encoder(tokens.read_tokenizer(tokens.default_tokenizer(spark)))
    got = defaultdict(list)
    for r in packed.orderBy("doc_id", "piece").collect():
        got[r.doc_id] += r.tokens
    assert {k: e.decode(v) for k, v in got.items()} == want
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    (mine,) = [n for n in set(os.listdir(root)) - before if n.startswith("pipeline-")]
    assert os.listdir(f"{root}/{mine}") == [str(len(pipeline.STAGES) - 1)]
