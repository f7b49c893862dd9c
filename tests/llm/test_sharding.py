import math
import re
import zlib
from collections import Counter

from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered
from ledgerloom.llm.sharding import Tree, assign_shards, sharded


def test_plan_of_awkward_rows(spark):
    got = sharded(docs(spark, AWKWARD, shard="clash")).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in AWKWARD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"key"}


def test_balance_and_growth(spark):
    rows = sharded(docs(spark, [(i, "t") for i in range(20_000)])).collect()
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(40)) and max(count.values()) < 640 and min(count.values()) > 370
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {40}
    assert 350 < len(moved) < 640


def descended(key, tree):
    """The same descent in Python, from the hashes of a key with every node."""

    def won(prefix, weights):
        draws = [(-math.log(((key[prefix + str(j)] >> 11) + 0.5) * 2.0**-53) / w, j) for j, w in enumerate(weights) if w > 0]
        return min(draws)[1]

    i = won("", [sum(map(sum, r)) for r in tree.regions])
    j = won(f"{i}/", [sum(x) for x in tree.regions[i]])
    k = won(f"{i}/{j}/", tree.regions[i][j])
    return sum(len(x) for r in tree.regions[:i] for x in r) + sum(len(x) for x in tree.regions[i][:j]) + k


def test_shards_against_plain_descent(spark):
    for tree in (Tree.even(40), Tree.even(40).grown(), Tree.even(13), Tree((((1, 2, 0.5), (3,)), ((0.1, 0, 7),), ((1,), (0, 2), (5, 5, 5, 5))))):
        nodes = [n for i, r in enumerate(tree.regions) for j, x in enumerate(r) for n in (f"{i}", f"{i}/{j}", *(f"{i}/{j}/{k}" for k in range(len(x))))]
        ids = spark.range(-200, 200).withColumnRenamed("id", "doc_id").union(spark.sql("SELECT cast(NULL AS bigint)"))
        ids = ids.withColumn("__region", F.lit("clash"))
        hashed = assign_shards(ids, tree).withColumns({f"h{n}": F.xxhash64("doc_id", F.lit(n)) for n in set(nodes)}).collect()
        for r in hashed:
            assert r.shard == descended({n: r[f"h{n}"] % 2**64 for n in nodes}, tree)


def test_plan_is_compiled(spark):
    """All of the descent is one span of generated code, in methods small enough for the JVM to compile."""
    plan = assign_shards(spark.range(10).withColumnRenamed("id", "doc_id"), Tree.even(40).grown())._jdf.queryExecution()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(plan.executedPlan())
    assert "Found 1 WholeStageCodegen subtrees" in code and "Python" not in code
    assert int(re.search(r"maxMethodCodeSize:(\d+)", code)[1]) < 8000


def test_weights_confine_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = Tree((((1, 1), (1, 1)), ((1, 1), (1, 1))))
    b = Tree((((1, 1), (1, 1)), ((1, 1), (1, 3))))
    both = assign_shards(assign_shards(ids, a, out="a"), b, out="b").collect()
    assert all(r.b >= 4 for r in both if r.a != r.b)  # only into the region that got heavier
    assert all(r.b in (r.a, 6, 7) for r in both if r.a in (4, 5))  # between racks, only into the heavier one
    assert all(r.b in (r.a, 7) for r in both if r.a in (6, 7))  # between its shards, only into the heavier one
    share = Counter(r.b for r in both)
    assert abs(share[7] - 6000) < 400


def test_zero_weight_and_empty(spark):
    ids = spark.range(2000).withColumnRenamed("id", "doc_id")
    got = {r.s for r in assign_shards(ids, Tree((((0, 1), (0,)), ((0,),))), out="s").collect()}
    assert got == {1}
    assert sharded(docs(spark, [])).count() == 0


def test_equal_rows_are_numbered_in_many_buckets(spark):
    """Of rows a third of which are the same, with a null id, no bucket holds much more than its part."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CAST(1 AS INT) AS shard").repartition(4)
    out = numbered(df, ["shard"], ["doc_id"], "slot")
    assert sorted(r.slot for r in out.collect()) == list(range(3000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    path = next(f for f in out.inputFiles()).rsplit("/", 1)[0]
    most = spark.read.parquet(path).groupBy("__salt").count().agg({"count": "max"}).first()[0]
    assert most < 3 * 3000 / 8 and "__salt" in plan
