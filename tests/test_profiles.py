import gzip

import pytest

from lociweave.operators import encode
from lociweave.plans.params import Missing
from lociweave.sources import profiles


def rows(df):
    return [(r["name"], r["alleles"]) for r in df.orderBy("row_idx").collect()]


def test_header_columns_and_names(spark):
    text = "##skip\n#Name\tST\ta\t#note\tb\n\nx (1)\t7\t1\tc\tn\r\n\t9\t9\t9\t9\ny\t8\t2\n"
    assert rows(profiles.read_profile(spark, text=text)) == [("x__1_", ["1", "N"]), ("9", ["9", ""]), ("y", ["2", ""])]  # lines are trimmed before they are split


def test_last_header_wins_and_first_line_without_one(spark):
    assert rows(profiles.read_profile(spark, text="#a\tST\tl\n#b\tl1\tl2\nx\t1\t2")) == [("x", ["1", "2"])]
    assert rows(profiles.read_profile(spark, text="n\tl1\tST_id\nx\t1\t2")) == [("x", ["1"])]
    assert rows(profiles.read_profile(spark, text="")) == []


def test_fasta(spark):
    text = "# c\n>s1 first\nacg\nt-\n>s2\nACGTN\n>s3\n"
    assert rows(profiles.read_profile(spark, text=text)) == [("s1", list("ACGT-")), ("s2", list("ACGTN")), ("s3", [])]


def test_fasta_over_parts_of_a_file(spark, tmp_path):
    """A record may begin in one part and end in a later one."""
    text = "".join(f">s{k} x\n" + "acgt" * 5 + "\n" + "ttga" * 5 + "\n" for k in range(200))
    (tmp_path / "a.fasta").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        got = profiles.read_profile(spark, path=str(tmp_path / "a.fasta"))
        assert profiles.numbered_lines(spark, str(tmp_path / "a.fasta")).rdd.getNumPartitions() > 1
        assert rows(got) == [(f"s{k}", list("ACGT" * 5 + "TTGA" * 5)) for k in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_is_plain(spark, tmp_path):
    text = "#n\tl1\tl2\nx\t1\t2\ny\t1\t-\n"
    (tmp_path / "p.tsv").write_text(text)
    for name in ("p.tsv.gz", "p.tsv.GZ"):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
        assert rows(profiles.read_profile(spark, path=str(tmp_path / name))) == rows(profiles.read_profile(spark, path=str(tmp_path / "p.tsv")))


def test_ragged_and_missing_source(spark):
    with pytest.raises(ValueError):
        profiles.check_rectangular(profiles.read_profile(spark, text=">a\nAC\n>b\nA"))
    with pytest.raises(ValueError):
        profiles.read_profile(spark)


def nodes(spark, text, missing=Missing.PAIR_DELETE):
    return encode.nodes_of(profiles.read_profile(spark, text=text), missing).orderBy("node_id").collect()


def test_missing_rows_and_codes(spark):
    """Missing tokens take a rank and then code 0; a row of nothing else goes."""
    text = "#n\tp\tq\tr\nblank\tn\t-\t0\npart\t-\t4\tN\nfull\t5\t4\t2"
    assert [(r["name"], r["codes"]) for r in nodes(spark, text)] == [("part", [0, 2, 0]), ("full", [2, 2, 2])]


def test_many_alleles_are_joined(spark, monkeypatch):
    text = "#n\tp\tq\nA\tx\t10\nB\ty\t9\nC\t0\t10\nD\tz\t"
    few = nodes(spark, text)
    monkeypatch.setattr(encode, "RANKED_ALLELES", 0)
    assert nodes(spark, text) == few and [r["codes"] for r in few] == [[4, 1], [0, 2], [2, 2], [3, 3]]


def test_duplicates_and_order(spark):
    got = nodes(spark, "#n\tp\tq\nA\t2\t1\nB\t1\t2\nC\t2\t1\nD\t1\t1")
    assert [(r["name"], r["members"], r["n_str"]) for r in got] == [("D", ["D"], 1), ("A", ["A", "C"], 2), ("B", ["B"], 1)]


def test_complete_deletion_keeps_loci_with_gaps(spark):
    assert nodes(spark, "#n\tp\tq\nA\t1\t1\nB\t2\t2", Missing.COMPLETE_DELETE) == []
    got = nodes(spark, "#n\tp\tq\tr\nA\t1\t1\t0\nB\t2\t2\t1\nC\t2\t1\t2", Missing.COMPLETE_DELETE)
    assert [(r["name"], r["codes"]) for r in got] == [("B", [2]), ("C", [3])]


def test_empty_profile(spark):
    assert nodes(spark, "n\tp\tq") == []
    assert [r["name"] for r in nodes(spark, "#n\tp\tq")] == ["#n"]  # nothing but comments: they are the data
