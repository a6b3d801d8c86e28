"""The statistics store reads a file once, until it changes."""

import os

from ampliq.sources import statistics as ST


def test_only_changed_files_are_read(spark, tmp_path):
    data, store = tmp_path / "in", str(tmp_path / "store")
    data.mkdir()
    (data / "a.fasta").write_text(">x one\nACGT\nAC\n>none\n>y\nA\n")
    (data / "b +[1]%.fasta").write_text(">z\nACGTACGTAC\n")
    (data / "c.fasta").write_text("\n")
    asked = []

    def measure(spark, files):
        asked.append(sorted(os.path.basename(f) for f in files))
        return ST.fasta_lengths(spark, files)

    def run():
        return ST.refresh(spark, str(data), store, measure)

    def mean():
        r = ST.mean_length(spark, store).first()
        return r.files, r.records, r.bases, round(r["mean"], 6)

    assert mean() == (0, 0, 0, 1.0)
    assert run() == 3 and mean() == (3, 3, 17, round(17 / 3, 6))
    assert run() == 0 and len(asked) == 1
    (data / "a.fasta").write_text(">x\nACGTACGT\n")
    (data / "d.fasta").write_text(">w\nAC\r\nGT\n")
    assert run() == 2 and asked[-1] == ["a.fasta", "d.fasta"]
    assert mean() == (4, 3, 22, round(22 / 3, 6))
    (data / "d.fasta").unlink()
    assert run() == 0 and mean() == (3, 2, 18, 9.0) and len(asked) == 2


def test_a_failed_refresh_leaves_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    src = str(tmp_path / "t")
    spark.createDataFrame([("abc",), (None,), ("",), ("abcde",)], "s string").coalesce(1).write.parquet(src)
    assert ST.refresh(spark, src, store, ST.column_lengths("s")) == 1
    spark.createDataFrame([("x",)], "s string").coalesce(1).write.mode("append").parquet(src)

    def broken(spark, files):
        return ST.column_lengths("s")(spark, files).selectExpr("file", "records", "-bases AS bases")

    try:
        ST.refresh(spark, src, store, broken)
        raise AssertionError("accepted")
    except ValueError:
        pass
    r = ST.mean_length(spark, store).first()
    assert (r.files, r.records, r["mean"]) == (1, 2, 4.0)
    assert ST.refresh(spark, src, store, ST.column_lengths("s")) == 1
    assert ST.mean_length(spark, store).first().records == 3
