"""The whole pipeline against plain versions of its stages."""

import zlib

import numpy as np
import pandas as pd

import corpus_pipeline
from lectern.llm import quality

from .test_curriculum import plain_mix
from .test_fmindex import plain as plain_hits
from .test_shards import ids_of
from .test_similar import plain_kept

SF = "/root/testdata/sf0.001"


def test_run_matches_plain_stages(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    judged = quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    kept = docs[docs.doc_id.isin(judged[~judged.rejected].doc_id)].sort_values("doc_id")
    kept = kept[kept.doc_id.isin(plain_kept(list(zip(kept.doc_id, kept.text))))]
    items = [(r.item_id, r.text) for r in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples()]
    windows = {w for _, t in items for w in t.lower().split()}
    kept = kept[[not (windows & set(t.lower().split()) and plain_hits(t, items)[1]) for t in kept.text]]
    mix = plain_mix(list(zip(kept.doc_id, kept.source, kept.text)))
    want = sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, _, _, c, t in mix for x in [ids_of(t)] for _ in range(c))
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert sorted(zip(got.doc_id, got.n_tokens, got.ids_crc32)) == want
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist() and got.doc_id.is_monotonic_increasing


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), SF).count() == 0
