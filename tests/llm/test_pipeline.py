from collections import Counter

import corpus_pipeline
from meridia.llm.decontaminate import find_contamination
from meridia.llm.quality import CUT, fit, score

from .test_near_dedup import brute
from .test_decontaminate import brute as windows


def test_each_stage_on_the_documents_that_the_one_before_kept(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        ids = [r["doc_id"] for r in after]
        if k < 4:
            assert out.columns == columns
        if k == 0:
            good = score(docs, fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where(f"score >= {CUT}")
            assert sorted(ids) == sorted(r.doc_id for r in good.collect())
        if k == 1:
            of = brute([(r["doc_id"], r["text"]) for r in before])
            assert sorted(ids) == sorted(set(of.values()))
        if k == 2:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = windows([(r["doc_id"], r["text"]) for r in before], bench, 10)
            assert sorted(ids) == sorted(i for i, (_, hit, _) in found.items() if not hit)
        if k == 3:
            assert set(ids) <= {r["doc_id"] for r in before} and 0.8 * len(before) < len(ids) < 1.2 * len(before)
        if k == 4:
            assert Counter(ids) == Counter(r["doc_id"] for r in before)
            assert len({(r["shard"], r["slot"]) for r in after}) == len(after)
        docs = out
