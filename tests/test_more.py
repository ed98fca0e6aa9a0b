import os

from lociweave.functions import storage
from lociweave.functions.synthetic import synthetic_profile
from lociweave.operators import encode, tree
from lociweave.plans import pipelines


def test_synthetic_profile(spark):
    made = synthetic_profile(spark, 40, 60, missing=0.1, duplicates=0.2, seed=5)
    rows = made.orderBy("row_idx").collect()
    assert rows == synthetic_profile(spark, 40, 60, missing=0.1, duplicates=0.2, seed=5).repartition(7).orderBy("row_idx").collect()
    assert len(rows) == 48 and all(len(r["alleles"]) == 60 for r in rows) and rows[0]["alleles"] == rows[40]["alleles"]
    gaps = sum(a == "0" for r in rows for a in r["alleles"]) / (48 * 60)
    assert 0.05 < gaps < 0.15
    snp = synthetic_profile(spark, 10, 20, letters="ACGT", marker="-", seed=1)
    assert {a for r in snp.collect() for a in r["alleles"]} <= set("ACGT-")


def test_methods_give_all_leaves_once(spark):
    made = synthetic_profile(spark, 25, 60, missing=0.05, duplicates=0.2, seed=8)
    names = sorted(r["name"] for r in made.collect())
    for given in ({"method": "MSTreeV2"}, {"method": "MSTree"}, {"method": "MSTree", "matrix": "blockwise"}, {"method": "MSTree", "matrix": "asymmetric", "recraft": True, "recraft_mode": "native", "native": True}, {"method": "NJ"}):
        root = tree.parse_newick(pipelines.run(made, **given).first()["newick"])
        assert sorted(n.name for n in tree.walk(root) if not n.children) == names, given


def test_partitioning_changes_nothing(spark):
    made = synthetic_profile(spark, 30, 40, missing=0.05, seed=9)
    a, b = (pipelines.run(made.repartition(k), method="MSTreeV2").first()["newick"] for k in (1, 9))
    assert a == b
    x, y = (sorted(map(str, encode.nodes_of(made.repartition(k)).collect())) for k in (2, 5))
    assert x == y


def test_midpoint():
    root = tree.midpoint_rooted(tree.parse_newick("((a:1,b:2):3,c:2,d:9);"))
    depth = {}

    def down(n, d):
        if not n.children:
            depth[n.name] = d
        for c in n.children:
            down(c, d + c.length)

    down(root, 0.0)
    assert max(depth.values()) == 7.0 and sorted(depth, key=depth.get)[-1] in ("b", "d") and depth["b"] == depth["d"] == 7.0
    assert tree.same_tree(tree.newick(root), "((a:1,b:2):3,c:2,d:9);", lengths=True)


def test_tiny_branches_go():
    root = tree.parse_newick("((a:0.05,b:2):3.5,c:2);")
    tree.collapse_tiny(root)
    assert [n.length for n in tree.walk(root) if n.name in ("a", "b")] == [0.0, 2.05]


def test_stages_can_be_cleared(spark):
    held = storage.stash(spark.range(5), "numbers")
    assert held.count() == 5
    folder = storage.stage_folder(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    storage.clear_stages(spark)
    assert not os.path.exists(folder)
    assert storage.stash(spark.range(3), "numbers").count() == 3
