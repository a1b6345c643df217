"""The command line from end to end, and query-side serving."""

import json

import numpy as np
import pytest

from meridian import cli
from meridian.operators.mapping import Mapping, MappingError
from meridian.operators.serving import QueryEmbedder
from meridian.sources import stores


@pytest.fixture()
def folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(240, 8)), np.linalg.qr(rng.normal(size=(8, 8)))[0]
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", x @ w + 0.01 * rng.normal(size=x.shape))
    return tmp_path


def said(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, folder, capsys):
    f = folder
    assert said(capsys, "version") == (0, {"version": cli.VERSION})
    plan = said(capsys, "plan", "--source-model", "text-embedding-ada-002", "--target-model", "voyage-3", "--corpus-size", 50_000)[1]
    assert plan["voyage-3"]["k"] == 3840
    made = said(capsys, "calibrate", "--source-vectors", f / "x.npy", "--target-vectors", f / "y.npy", "--output", f / "m", "--kind", "procrustes", "--recalibrate")[1]
    assert made["validation"]["top1_retention"] == 1.0
    assert said(capsys, "inspect", f / "m")[1]["recalibrator"]
    assert said(capsys, "transform", "--source", f / "x.npy", "--target", f / "t", "--mapping", f / "m", "--dry-run")[1] == {"n": 240, "dimension": 8}
    assert said(capsys, "transform", "--source", f / "x.npy", "--target", f / "t", "--mapping", f / "m")[1]["n_written"] == 240
    assert said(capsys, "doctor", f / "t", "--model", "voyage-2")[1]["has_metadata"] is True
    code, row = said(capsys, "gate", "--mapping", f / "m", "--source-vectors", f / "x.npy", "--target-vectors", f / "y.npy", "--html", f / "g.html")
    assert row["verdict"] in ("PASS", "WARN") and code == (row["verdict"] != "PASS") and "<table>" in (f / "g.html").read_text()
    (f / "log").mkdir()
    (f / "log/a.json").write_text('{"ts": 1, "event": "q", "wrapper": "w"}\n{"ts": 2, "event": "q"}\n')
    assert said(capsys, "report", f / "log")[1] == {"total": 2, "by_wrapper": {"unknown": 1, "w": 1}}


def test_gate_on_input_that_cannot_be_judged(spark, folder):
    f = folder
    cli.main(["calibrate", "--source-vectors", str(f / "x.npy"), "--target-vectors", str(f / "y.npy"), "--output", str(f / "m"), "--alpha", "1"])
    for name, row in (("apart", (10**6, [0.0] * 8)), ("short", (1, [0.0] * 5))):
        spark.createDataFrame([row], "id long, vec array<double>").write.parquet(str(f / name))
        assert cli.main(["gate", "--mapping", str(f / "m"), "--source-vectors", str(f / name), "--target-vectors", str(f / "y.npy")]) == 2


def test_query_embedder(spark):
    w = np.roll(np.eye(3), 1, axis=1)
    e = QueryEmbedder(lambda ts: np.array([[len(t), 1.0, 0.0] for t in ts]), Mapping("procrustes", w, w.T))
    want = np.array([2.0, 1, 0]) @ w.T
    assert np.allclose(e.embed_query("ab"), want / np.linalg.norm(want)) and e("ab") == e.embed_queries(["ab"]) and e.embed_queries([]) == []
    with pytest.raises(MappingError):
        e.embed_documents(["ab"])
    with pytest.raises(MappingError):
        QueryEmbedder(lambda ts: ts, Mapping("ridge", w, None))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ab",), (None,)], "text string").coalesce(1)
    assert np.allclose(df.select(e.column(F.col("text")).alias("v")).first()["v"], e.embed_query("ab"))
    store = stores.from_arrays(spark, np.eye(3), texts=["a", "b", "c"])
    queries = spark.createDataFrame([(0, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    assert [(r["rank"], r["text"]) for r in e.search(queries, store, 1).collect()] == [(1, "a")]
