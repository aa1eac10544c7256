"""The pipeline's stages and result against plain versions of them."""

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sextant.llm import pii, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_do_what_they_decide(spark, stages):
    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    start, good, single, clean, private, _ = rows
    assert all(s.columns == stages[0].columns for s in stages)
    for i, r in start.items():
        n, _, symbols, _, repeated = brute.quality(r.text)
        if n < 50 or 100 * repeated > 50 * n or symbols > 0.25 * n:
            assert i not in good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in good for i, q in labels.items() if q == 1 and brute.quality(start[i].text)[0] >= 50)
    found = brute.components([(i, r.text) for i, r in good.items()])
    assert set(single) == {i for i, (_, c) in found.items() if c == i}
    assert set(clean) == {i for i, r in single.items() if not brute.contamination(r.text, bench)[4]}
    assert set(private) == set(clean)
    for i, r in private.items():
        assert r.lang == clean[i].lang and (r.text == clean[i].text or any(c.isdigit() for c in clean[i].text))


def test_the_mix_meets_its_targets(stages):
    docs = stages[4].collect()
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in docs}
    sums, taken, longest = {}, {}, {}
    for r in docs:
        sums[r.source] = sums.get(r.source, 0) + size[r.doc_id]
        longest[r.source] = max(longest.get(r.source, 0), size[r.doc_id])
    for r in stages[5].collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for source, target in brute.mix_targets(sums).items():
        assert abs(taken.get(source, 0) - target) <= longest[source]


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[-1]).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()


def test_stages_take_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, "the of and " * 40, None, None, None, "x"),
            (2, "the of and " * 40, None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    card = docs.limit(1).withColumn("text", F.lit("4111111111111111"))
    assert pii.pseudonymize(card)[0].first().text != "4111111111111111"
