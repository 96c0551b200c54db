import corpus_pipeline
from llm_cases import SF, documents, empty, given
from pyspark.sql import functions as F

from postflow.llm import decontaminate, toxicity
from test_llm_exact_dedup import brute
from test_llm_near_dedup import slow_classes

import public_tokenizers
import sentencepiece


def test_run_against_brute_force(spark):
    rows = {k: t for k, t in zip(given("documents").doc_id.tolist(), given("documents").text)}
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.train(docs, marks))
    rows = {k: t for k, t in rows.items() if scorer.score(t)[0] < toxicity.THRESHOLD}
    rows = {k: rows[k] for k, _, _, kept in brute(list(rows.items())) if kept}
    rows = {k: rows[k] for k, name in zip(rows, slow_classes(list(rows.items()))) if k == name}
    bench = given("benchmark")
    index = decontaminate.Index(list(zip(bench.item_id.tolist(), bench.text)))
    rows = {k: t for k, t in rows.items() if not index.search(t)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {k: library.encode(t) for k, t in rows.items()}
    assert 100 < len(expected) < len(given("documents"))
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == expected and len(found) == len(expected)


def test_stages_bear_edge_rows(spark, tmp_path):
    for name, docs in (("rows", documents(spark)), ("none", empty(spark))):
        for number, (stage, step) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{number}"
            step(spark, docs, SF).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == before.columns, stage
        assert docs.count() == (0 if name == "none" else docs.where(F.col("round_trip")).count())
        assert (docs.count() > 0) == (name == "rows")


def test_workers_keep_no_parts_of_texts(spark):
    """What subwords remembers of texts goes with the task, so it does not lie beside later stages."""
    def remembered(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            size = sum(len(x) + len(x.paths) + len(x.finite) for x in gc.get_objects() if type(x).__name__ == "Transducer")
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    docs = documents(spark, [(k, f"A text number {k}, nothing more.", "en") for k in range(400)]).repartition(8)
    assert len(corpus_pipeline.encoded(spark, docs, SF).collect()) == 400
    assert {r["size"] for r in spark.range(64, numPartitions=16).mapInArrow(remembered, "size long").collect()} == {0}
