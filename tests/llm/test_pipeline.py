"""The pipeline against brute-force versions of its stages, and the registration of the queries."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import mixing, queries, simhash
from tests.llm.test_exact import brute_contamination, components
from tests.llm.test_learned import tables  # noqa: F401


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and len(queries.QUERIES) == 10
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark, tables, tmp_path):  # noqa: F811
    folder, labels, _ = tables
    items = [(1, "ba do ri na so ba do ri na so unique passage words"), (2, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id in (1, 2, 3)"))
    more = spark.createDataFrame([(9500, "x1 x2 " + items[0][1].upper() + " x3", "xx", "s", 9)], docs.schema)
    docs = docs.unionAll(more)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            told = [d for d in gone if d in labels]
            assert sum(labels[d][1] for d in told) > 0.9 * len(told) > 0
        if name == "near_dedup":
            sets = [frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in before]
            near = lambda a, b: not sets[a] and not sets[b] or bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])  # noqa: E731, B023
            groups = components(range(len(before)), near)
            assert len(after) == len(set(groups.values()))
        if name == "decontamination":
            want = sorted(str(r.doc_id) for r in before if not brute_contamination(r.text, items)[2])
            assert sorted(str(r.doc_id) for r in after) == want and "9500" not in want
        if name == "mixing":
            # What there is too much of is taken less often, the rest more often: each as its rate says, and as often for the same id.
            mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/decontamination"), mixing.fit_domains(spark.read.parquet(f"{tmp_path}/decontamination"), spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True)), corpus_pipeline.MIXTURE)
            rates = {(r.doc_id, r.text): r["__rate"] for r in mixed.rows.collect()}
            times = Counter((r.doc_id, r.text) for r in after)
            assert set(times) <= set(rates) == {(r.doc_id, r.text) for r in before}
            assert all(int(x) <= times[d] <= int(x) + 1 for d, x in rates.items())
            reachable = [w for w, b in zip(mixed.wished, mixed.before) if b * 4 >= w]
            assert np.abs(np.array(mixed.after) - mixed.wished).max() < 0.001 or len(reachable) < 4
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {"shard", "grown_shard"} <= set(docs.columns) and len(after) == len(before)


def test_run(spark, tables):  # noqa: F811
    folder, _, _ = tables
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_of_odd_tables(spark, tables, tmp_path):  # noqa: F811
    """Empty tables, null columns, repeated rows and columns of clashing names go through every stage."""
    folder, _, _ = tables
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(40).unionAll(docs.limit(3)).unionAll(spark.createDataFrame([(None,) * 5] * 3, docs.schema))
    for name in ("toxicity", "tokens", "rate", "posterior", "id", "n", "cls", "fp", "key", "size", "digest", "row", "c", "l", "w"):
        odd = odd.withColumn(name, F.lit(f"mine {name}"))
    for start in (odd, docs.limit(0)):
        docs_ = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}{start is odd}"
            stage(spark, docs_, folder).write.parquet(path)
            docs_ = spark.read.parquet(path)
            assert docs_.columns[: len(start.columns)] == start.columns and (k == 4 or len(docs_.columns) == len(start.columns))
            assert docs_.select(start.columns).exceptAll(start).count() == 0 or name in ("mixing", "sharding")
        assert (docs_.count() > 0) == (start is odd)
