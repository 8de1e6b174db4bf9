"""How SimHash's joins are made: what an explode multiplies is never broadcast, however small the planner takes it to be."""

import pytest
from pyspark.sql import functions as F

from pluvia.llm import simhash


@pytest.mark.parametrize("block", [simhash.BLOCK, 2])  # without crowded keys, and with
def test_probes_are_not_broadcast(spark, tmp_path, block):
    values = [v ^ m for v in (0, 0x0F0F0F0F12345678, 0x7FFF00001111AAAA) for m in (0, 1, 1 << 33, 5 | 1 << 40)]
    spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp bigint, first bigint").write.parquet(str(tmp_path / "prints"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in {"10485760b", "10MB", "10485760"}  # with which the table would be broadcast
    prints = spark.read.parquet(str(tmp_path / "prints"))
    links = simhash.fingerprint_links(prints, block=block)
    plan = links._jdf.queryExecution().executedPlan().toString()
    probing = [line for line in plan.splitlines() if "Join" in line and "probe#" in line]
    assert probing and not [line for line in probing if "BroadcastHashJoin" in line]
    near = {(a, b) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 3}
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(roots[a] == roots[b] for a, b in near) and len(set(roots.values())) == 3
    assert {(r["a"], r["b"]) for r in links.select(F.col("a"), F.col("b")).collect()} <= near
