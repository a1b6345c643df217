"""The pipeline and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from meridian.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from meridian.llm import queries as registered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {"": spark.read.parquet(f"{sf}/documents.parquet")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, df in stages.items():
        assert df.columns == COLUMNS + ["shard"] * (name == "sharding")


def test_each_stage_does_what_its_operator_says(spark, sf, stages):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    assert key(stages["toxicity"], COLUMNS) == key(toxicity.drop_toxic(stages[""], read("labels")), COLUMNS)
    judged = near_dedup.near_classes(stages["toxicity"]).collect()
    kept = {r["doc_id"] for r in stages["near_dedup"].select("doc_id").collect()}
    assert kept == {r["class_id"] for r in judged} and len(kept) < len(judged)
    assert near_dedup.near_classes(stages["near_dedup"]).where("links > 0").count() == 0
    assert decontaminate.contamination(stages["decontamination"], read("benchmark")).count() == 0
    leaks = {r["doc_id"] for r in decontaminate.contamination(stages["near_dedup"], read("benchmark")).collect()}
    assert {r["doc_id"] for r in stages["decontamination"].collect()} == kept - leaks
    assert key(stages["mixing"], ["doc_id"]) == key(mixing.mix(stages["decontamination"]), ["doc_id"])
    assert key(stages["sharding"], COLUMNS) == key(stages["mixing"], COLUMNS)
    total = stages["sharding"].selectExpr("shard", "octet_length(text) b").groupBy("shard").sum("b").toPandas()["sum(b)"]
    assert len(total) == sharding.SHARDS and total.max() - total.min() <= 0.05 * total.sum()


def test_run_gives_the_rows_of_the_last_stage(spark, sf, stages):
    assert key(corpus_pipeline.run(spark, sf), [*COLUMNS, "shard"]) == key(stages["sharding"], [*COLUMNS, "shard"])


def test_run_leaves_only_the_tables_that_its_result_reads(spark, sf):
    from meridian.plans import materialize as mt

    before = {p for _, p in mt._written}
    out = corpus_pipeline.run(spark, sf)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, p in mt._written if p not in before]
    assert left.count("mixing") == 1 and not {"toxicity", "near_dedup", "decontamination", "signatures", "edges", "classes"} & set(left)
    assert out.count() > 0


def test_an_empty_table_runs_through(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        (df.where("false") if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == [*COLUMNS, "shard"]


def test_registration():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(registered.queries()[name](spark, sf).toPandas(), duck.execute(registered.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(registered.oracle_sql())))
def test_query_gives_every_row(spark, sf, name):
    """The queries that give a row for each document or conversation give all of them."""
    n = registered.queries()[name](spark, sf).count()
    each = {"op1_near_dedup": "documents", "op2_quality": "documents", "op6_toxicity": "documents", "op9_token_counts": "documents", "op10_sharding": "documents"}
    assert n == spark.read.parquet(f"{sf}/{each[name]}.parquet").count() if name in each else n > 0
