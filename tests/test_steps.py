import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticeworks.__main__ import main
from latticeworks.functions.steps import FINDINGS, Step, Untrusted, clashes, digest, findings


def summed(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": [f"g{frame['g'].iloc[0]}"], "total": [float(frame["v"].sum())]})


def one_by_one(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": (frame["v"] // 4).astype(str), "total": frame["v"] * 2.0})


def test_steps(spark):
    rows = spark.range(12).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit("unread").alias("w"))
    step = Step("sums", summed, ["g", "v"], "key string, total double")
    with pytest.raises(Untrusted, match=digest(summed)):
        step.for_each(rows, ["g"])
    step.trusted.add(digest(summed))
    got = step.for_each(rows, ["g"])
    assert {(r.name, r.total) for r in got.collect()} == {("sums#g0", 18.0), ("sums#g1", 22.0), ("sums#g2", 26.0)}
    assert clashes(got).count() == 0
    batch = Step("twice", one_by_one, ["v"], "key string, total double", {digest(one_by_one)}).batch(rows)
    assert batch.agg(F.sum("total")).first()[0] == 132 and {r.name: r.n for r in clashes(batch).collect()} == {"twice#0": 4, "twice#1": 4, "twice#2": 4}


def test_findings_once_in_order(spark):
    rows = [("info", "b", "x", "m2"), ("error", "z", "y", "m"), ("info", "b", "x", "m1"), ("warning", "a", "x", "m")]
    got = findings(spark.createDataFrame(rows, FINDINGS)).collect()
    assert [(r.severity, r.n, r.message) for r in got] == [("error", 1, "m"), ("warning", 1, "m"), ("info", 2, "m1")]


def test_commands(spark, data, capsys):
    assert main(["list"]) == 0 and "chunk_report: The flagship" in capsys.readouterr().out
    assert main(["vectors"]) == 0 and "0xb2257365ad2f65db" in capsys.readouterr().out
    assert main(["query", "chunk_reprt", data]) == 2 and "did you mean chunk_report" in capsys.readouterr().err
    assert main(["query", "chunk_report", data, "--limit", "1"]) == 0 and '"posts"' in capsys.readouterr().out
    assert main(["eval", "= l_quantity * 2", f"{data}/lineitem.parquet", "--limit", "1"]) == 0 and '"value"' in capsys.readouterr().out
    assert main(["eval", "= 1 +", f"{data}/lineitem.parquet"]) == 1
