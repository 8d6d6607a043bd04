"""The pipeline on the smallest tables: each stage's decision takes effect and is checked against brute force."""

import struct

import public_tokenizers as P
import pyarrow.parquet as pq

import corpus_pipeline
from canopy.llm import byte_bpe, decontaminate, jaccard_join
from canopy.llm.base import stored
from tests.conftest import SF
from tests.llm.test_text_operators import brute_base


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        seen.append({r.doc_id: r for r in docs.collect()})
    good, single, clean, masked, ids = seen
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert not any(quality.get(i) == 0 for i in good)
    sets = {i: set(jaccard_join.shingle_set(r.text).tolist()) for i, r in single.items()}
    assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    items = [decontaminate.plain(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert not any(item in decontaminate.plain(r.text) for r in clean.values() for item in items)
    assert set(masked) == set(clean) and not any(brute_base(r.text) for r in masked.values())
    encoder = byte_bpe.rank_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert all(encoder.decode(list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)))) == masked[i].text for i, r in ids.items())
    assert len(seen[-1]) == corpus_pipeline.run(spark, SF).count()


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and repeated texts, an empty table and clashing names pass through every stage."""
    from pyspark.sql import functions as F

    from tests.llm.test_text_operators import ODD

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, kind).withColumns({c: F.lit(5) for c in ("row", "spans", "_id", "m", "n")})
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                assert out.where("row <> 5 OR spans <> 5 OR _id <> 5 OR m <> 5 OR n <> 5").count() == 0
                assert n == 0 or out.where("text IS NULL").count() == docs.where("text IS NULL").count()
            else:
                assert out.count() == docs.count()
            docs = docs if n == 0 else stored(out) if n < len(corpus_pipeline.STAGES) - 1 else out
