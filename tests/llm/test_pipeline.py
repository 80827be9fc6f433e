import corpus_pipeline
import odd
import test_decontamination
import test_packing
import test_simhash

import __spark_entry__ as contract
from gradewell.workspace import scratch_path

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    """The rows that go into and come out of every stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_every_stage_does_its_part(spark):
    steps = stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert [n for n, _, _ in steps] == ["quality_filter", "near_duplicate_filter", "paragraph_filter", "decontaminate", "pack"]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
        if name != "paragraph_filter":  # rows stay as they are
            assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect())), name
    _, before, after = steps[1]
    assert sorted(i for i, _ in pairs(after)) == sorted({g for _, _, g in test_simhash.expected(pairs(before))})
    _, before, after = steps[3]
    dirty = {d for d, *_ in test_decontamination.expected(pairs(before), odd.table(SMALL, "benchmark", "item_id, text"))}
    assert {i for i, _ in pairs(after)} == {i for i, _ in pairs(before)} - dirty
    _, before, after = steps[4]
    test_packing.check(after, pairs(before), 2048)
    labels = {d: toxic for d, toxic in odd.table(SMALL, "labels", "doc_id, toxic")}
    kept = {i for i, _ in pairs(steps[0][2])}
    clean = [d for d, toxic in labels.items() if not toxic]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_run_is_the_last_stage(spark):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32").collect()))
    last = stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)[-1][2]
    assert rows == sorted(map(tuple, last.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_with_odd_and_with_no_rows(spark):
    for docs in (odd.documents(spark), odd.nothing(spark)):
        steps = stages(spark, docs, SMALL)
        assert all(after.columns == before.columns for _, before, after in steps[:-1])
        assert (steps[-1][2].count() > 0) == (docs.count() > 0)


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
