"""Readers, writers and stream on small files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from ampliq.sources import readers as R
from ampliq.sources import sinks
from ampliq.streaming import presence


def fastq_text(rows):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows)


def make(n, rng):
    rows = []
    for i in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(150, 400)))
        rows.append((f"r{i}", s, "".join(rng.choice("@I+5") for _ in s)))
    return rows


def test_fastq_across_splits(spark, tmp_path):
    rows = make(80, random.Random(1))
    d = tmp_path / "A1-1"
    d.mkdir()
    (d / "A1_1_reads_2223.fastq").write_text(fastq_text(rows))
    with gzip.open(d / "A1-1_reads_BIN3.fastq.gz", "wt") as g:
        g.write(fastq_text(rows[:5]))
    (d / "B-9_reads_7.fastq").write_text(fastq_text(rows[:3]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = R.read_bins(spark, str(d)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    keep = {r for r in rows if 200 <= len(r[1]) <= 6000}
    assert {(r["read_id"], r["seq"], r["qual"]) for r in got if r["bin"] == "A1-1_2223"} == keep
    assert {r["bin"] for r in got} == {"A1-1_2223", "A1-1_BIN3"}
    assert {r["library"] for r in got} == {"A1-1"}


def test_fasta_across_splits(spark, tmp_path):
    rng = random.Random(2)
    recs = [(f"id{i} desc > with mark", "".join(rng.choice("ACGU") for _ in range(rng.randint(1, 300)))) for i in range(50)]
    p = tmp_path / "x.fasta"
    p.write_text("".join(f">{h}\n" + "\n".join(s[i:i + 60] for i in range(0, len(s), 60)) + "\n" for h, s in recs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = {(r["header"], r["seq"]) for r in R.read_fasta(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == set(recs)
    assert R.read_fasta(spark, str(p), clean=True).where(F.col("seq").contains("U")).count() == 0
    with pytest.raises(Exception, match="several records"):
        R.require_single_record(R.read_fasta(spark, str(p))).collect()


def test_text_readers(spark, tmp_path):
    rep = tmp_path / "k.report"
    rep.write_text("50.00\t5\t5\tU\t0\tunclassified\n50.00\t5\t0\tR\t1\troot\n50.00\t5\t1\tD\t2\t  Bacteria\n40.00\t4\t4\tG\t9\t    Petrimonas\n10.00\t1\t1\tD\t3\t  Archaea\n")
    got = {r["taxid"]: r["parent"] for r in R.read_kraken_report(spark, str(rep)).collect()}
    assert got == {0: None, 1: None, 2: 1, 9: 2, 3: 1}
    out = tmp_path / "k.out"
    out.write_text("C\tr1\tPetrimonas (taxid 9)\t150\t9:3 A:2 0:5\nU\tr2\t0\t100\t0:1\n")
    assert {(r["read_id"], r["taxid"], r["taxon"], r["hits"]) for r in R.read_kraken_output(spark, str(out)).collect()} == {
        ("r1", "9", "9", 3), ("r1", "9", "A", 2), ("r1", "9", "0", 5), ("r2", "0", "0", 1)}
    paf = tmp_path / "x.paf"
    paf.write_text("q\t100\t0\t90\t+\tt\t120\t5\t95\t80\t90\t60\tde:f:0.02\nq\t100\t0\t90\t+\tt\t120\t5\t95\t80\t90\t60\n")
    assert [round(r["identity"], 3) for r in R.read_paf(spark, str(paf)).collect()] == [0.98]
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\tVN:1\nr1\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tBC:Z:kit_barcode07\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert {(r["read_id"], r["barcode"]) for r in R.read_sam(spark, str(sam)).collect()} == {("r1", "barcode07"), ("r2", "unclassified")}
    bed = tmp_path / "m.bed"
    bed.write_text("# mask\nc\t10\t20\tlow\n")
    w = spark.createDataFrame([("c", 0, 10), ("c", 15, 30), ("c", 20, 40)], "contig string, start int, end int")
    assert {r["start"] for r in R.masked_windows(w, R.read_bed(spark, str(bed))).collect()} == {0, 20}
    ctl = tmp_path / "t.tsv"
    ctl.write_text("# note\ntarget name\tmembers (list)\nx\tA1, A2;B1\ny\t*A\n")
    rows = R.read_control(spark, str(ctl), {"target": "target", "members": "members"}, ("members",)).collect()
    assert {r["target"]: r["members"] for r in rows} == {"x": ["A1", "A2", "B1"], "y": ["*A"]}
    br = tmp_path / "barcode03_bracken.tsv"
    br.write_text("name\ttaxonomy_id\ttaxonomy_lvl\tkraken_assigned_reads\tadded_reads\tnew_est_reads\tfraction_total_reads\nX y\t1\tS\t1\t1\t2\t0.25\n")
    assert [(r["barcode"], r["taxon"], r["pct"]) for r in R.read_bracken(spark, str(br)).collect()] == [(3, "X y", 25.0)]


def test_fastq_sink_keeps_everything(spark, tmp_path):
    rows = [("r1", "A", "b1", "ACGT", "IIII", False), ("r2", "A", None, "AC", "II", False), ("r3", "A", "b1", "A", "I", True)]
    d = spark.createDataFrame(rows, "read_id string, library string, bin string, seq string, qual string, fragment boolean")
    sinks.write_fastq(d, str(tmp_path / "out"))
    back = R.read_fastq(spark, str(tmp_path / "out" / "*" / "*"), 0, 100).collect()
    assert {(r["read_id"], r["file"].split("bin=")[1].split("/")[0]) for r in back} == {("r1", "b1"), ("r2", "_unassigned"), ("r3", "_fragments")}


def test_stream_counts_like_batch(spark, tmp_path):
    f, r = "ACGTTGCATGGATCCATGCA", "GGCATTACGATTACGATCAG"
    amp = f + "ACCA" * 20 + r[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(i, f"b{i % 2}", "l", amp if i % 3 else "ACGT" * 30) for i in range(12)]
    d = spark.createDataFrame(rows, presence.READ_SCHEMA)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    p = spark.createDataFrame([("x", f, r)], "pair string, fwd string, rev string")
    q = presence.start_presence(presence.read_stream(spark, str(tmp_path / "in"), 1), p, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r["pair"], r["bin"]): r["k"] for r in presence.totals(spark, str(tmp_path / "out")).collect()}
    assert got == {("x", "b0"): 4, ("x", "b1"): 4}


def test_tables_written_are_read_back(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5, 2), ("b", None, 3)], "name string, share double, n int")
    sinks.write_tsv(d, str(tmp_path / "plain"))
    back = spark.read.csv(str(tmp_path / "plain"), sep="\t", header=True, schema="name string, share double, n int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    sinks.write_tsv(d, str(tmp_path / "comma"), decimal_comma=True)
    assert {r["share"] for r in spark.read.csv(str(tmp_path / "comma"), sep="\t", header=True).collect()} == {"1,5", None}
    (tmp_path / "layers.tsv").write_text("# by hand\ntarget\thits\torganelle\nA\t3\t\nB\t\t1\n")
    assert sorted(map(tuple, R.read_layer_table(spark, str(tmp_path / "layers.tsv")).collect())) == [("A", 3, None), ("B", None, 1)]
    (tmp_path / "hits.b6").write_text("q1\t99.1\t120\t200.5\t130\t1400\tSome title\n")
    assert tuple(R.read_blast(spark, str(tmp_path / "hits.b6")).first()) == ("q1", 99.1, 120, 200.5, 130, 1400, "Some title")
