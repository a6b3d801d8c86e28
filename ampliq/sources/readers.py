"""Readers (SRC family). Every reader returns a DataFrame; land it once as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import seq as S
from .lines import numbered_lines


def read_fasta(spark: SparkSession, path, clean: bool = False) -> DataFrame:
    """Multi-line records: file, record, header (uncut), seq (SRC-01)."""
    lines = numbered_lines(spark, path)
    is_head = F.col("value").startswith(">")
    heads = lines.groupBy("file", "block").agg(F.count(F.when(is_head, 1)).alias("_h"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = heads.withColumn("_before", F.coalesce(F.sum("_h").over(before), F.lit(0))).drop("_h")
    inside = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(offset, ["file", "block"]).withColumn(
        "record", F.col("_before") + F.count(F.when(is_head, 1)).over(inside)).where("record > 0")
    g = rows.groupBy("file", "record").agg(
        F.max(F.when(is_head, F.substring(F.col("value"), F.lit(2), F.length("value")))).alias("header"),
        F.array_sort(F.collect_list(F.when(~is_head, F.struct("line_no", F.trim("value").alias("s"))))).alias("parts"))
    seq = F.concat_ws("", F.transform("parts", lambda p: p["s"]))
    return g.select("file", "record", "header", (S.clean(seq) if clean else seq).alias("seq"))


def require_single_record(fasta: DataFrame) -> DataFrame:
    """Fails at run time when a file holds more than one record (SRC-02)."""
    n = fasta.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    j = fasta.join(n, "file")
    return j.withColumn("header", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several records in "), "file")).cast("string"))
                        .otherwise(F.col("header"))).drop("_n")


def read_fastq(spark: SparkSession, path, min_len: int = P.READ_MIN, max_len: int = P.READ_MAX) -> DataFrame:
    """Four-line records: file, record, read_id, seq, qual; length filter inclusive (SRC-03, SRC-04).

    Compressed files are read transparently. A quality line may start with '@', so records
    come from line numbers, never from the marker.
    """
    lines = numbered_lines(spark, path)
    r = lines.withColumn("record", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
    g = r.groupBy("file", "record").agg(*[
        F.max(F.when(F.col("part") == i, F.col("value"))).alias(n) for i, n in ((0, "head"), (1, "seq"), (3, "qual"))])
    g = g.select("file", "record", F.regexp_extract("head", "^@(\\S+)", 1).alias("read_id"), F.upper("seq").alias("seq"), "qual")
    return g.where(F.length("seq").between(min_len, max_len))


def bin_of_file(file) -> Column:
    """'<lib>_<id>' of '<lib>/<lib>_reads_<id>.fastq'; NULL for a stray copy whose prefix is not
    its folder (SRC-06)."""
    f = F.col(file) if isinstance(file, str) else file
    pattern = "([^/]+)/([^/]+?)[-_]reads[-_]([A-Za-z]*[0-9]+)\\.fastq(?:\\.gz)?$"
    folder, prefix, ident = (F.regexp_extract(f, pattern, i) for i in (1, 2, 3))
    same = (folder != "") & (F.translate(folder, "_", "-") == F.translate(prefix, "_", "-"))
    return F.when(same, F.concat(folder, F.lit("_"), ident))


def read_bins(spark: SparkSession, path, **kw) -> DataFrame:
    """Reads of all bin files with their bin and library; stray copies are ignored."""
    r = read_fastq(spark, path, **kw).withColumn("bin", bin_of_file("file")).where("bin IS NOT NULL")
    return r.withColumn("library", F.regexp_extract("bin", "^(.*)_[^_]*$", 1))


def read_sam(spark: SparkSession, path) -> DataFrame:
    """SAM text with its barcode: read_id, seq, qual, barcode (SRC-05)."""
    t = spark.read.text(path).where(~F.col("value").startswith("@"))
    c = F.split("value", "\t")
    tag = F.regexp_extract("value", "\tBC:Z:([^\t]*)", 1)
    bc = F.regexp_extract(tag, "(barcode[0-9]+)$", 1)
    return t.select(c[0].alias("read_id"), c[9].alias("seq"), c[10].alias("qual"), F.when(bc != "", bc).otherwise("unclassified").alias("barcode"))


def parse_kraken_report(lines: DataFrame) -> DataFrame:
    """Report lines (file, line_no, value) -> pct, clade, direct, rank, taxid, name, depth (SRC-07)."""
    c = F.split("value", "\t")
    t = lines.where(F.size(c) >= 6)
    indent = F.length(F.regexp_extract(c[5], "^( *)", 1))
    return t.select("file", "line_no", F.trim(c[0]).cast("double").alias("pct"), F.trim(c[1]).cast("long").alias("clade"),
                    F.trim(c[2]).cast("long").alias("direct"), F.trim(c[3]).alias("rank"), F.trim(c[4]).cast("long").alias("taxid"),
                    F.trim(c[5]).alias("name"), F.floor(indent / 2).cast("int").alias("depth"))


def read_kraken_report(spark: SparkSession, path) -> DataFrame:
    from ..operators.lineage import parents_from_order
    return parents_from_order(parse_kraken_report(numbered_lines(spark, path)), "file", "line_no", "depth", "taxid")


def parse_kraken_output(lines: DataFrame) -> DataFrame:
    """Per-read lines (value) -> status, read_id, taxid, length, one row per hit token (SRC-08)."""
    c = F.split("value", "\t")
    t = lines.where(F.size(c) >= 5)
    taxid = F.coalesce(F.nullif(F.regexp_extract(c[2], "taxid ([0-9]+)\\)", 1), F.lit("")), F.regexp_extract(c[2], "^([0-9]+)$", 1))
    t = t.select(c[0].alias("status"), c[1].alias("read_id"), taxid.alias("taxid"), c[3].alias("length"), F.explode_outer(F.split(F.trim(c[4]), " ")).alias("tok"))
    hit = F.split("tok", ":")
    return t.where(F.col("tok").rlike("^[A0-9]+:[0-9]+$")).select(
        "status", "read_id", "taxid", F.col("length").cast("int").alias("length"), hit[0].alias("taxon"), hit[1].cast("long").alias("hits"))


def read_kraken_output(spark: SparkSession, path) -> DataFrame:
    return parse_kraken_output(spark.read.text(path))


def read_bracken(spark: SparkSession, path) -> DataFrame:
    """barcode, taxon, pct from Bracken tables; report files are skipped (SRC-09)."""
    t = spark.read.csv(path, sep="\t", header=True, schema="name string, taxonomy_id string, taxonomy_lvl string, kraken_assigned_reads long, "
                       "added_reads long, new_est_reads long, fraction_total_reads double").withColumn("file", F.col("_metadata.file_path"))
    t = t.where(~F.col("file").endswith("_report.txt"))
    return t.select(F.regexp_extract("file", "barcode([0-9]+)", 1).cast("int").alias("barcode"), F.col("name").alias("taxon"),
                    (100.0 * F.col("fraction_total_reads")).alias("pct"))


def parse_paf(lines: DataFrame) -> DataFrame:
    """PAF lines with a de tag; identity = 1 - de; others are dropped (SRC-10)."""
    c = F.split("value", "\t")
    de = F.regexp_extract("value", "\tde:f:([0-9.eE-]+)", 1)
    t = lines.where((F.size(c) >= 12) & (de != ""))
    return t.select(c[0].alias("q"), *[c[i].cast("int").alias(n) for i, n in ((1, "qlen"), (2, "qs"), (3, "qe"))], c[5].alias("t"),
                    *[c[i].cast("int").alias(n) for i, n in ((6, "tlen"), (7, "ts"), (8, "te"))], (1.0 - de.cast("double")).alias("identity"))


def read_paf(spark: SparkSession, path) -> DataFrame:
    return parse_paf(spark.read.text(path))


def read_blast(spark: SparkSession, path) -> DataFrame:
    """Tabular alignment hits: qseqid pident length bitscore qlen slen stitle (SRC-11)."""
    return spark.read.csv(path, sep="\t", schema="q string, identity double, aligned int, bitscore double, qlen int, slen int, title string")


def read_bed(spark: SparkSession, path, contig: str | None = None) -> DataFrame:
    """Half-open mask intervals: contig, start, end, class (SRC-12); a missing file is an error."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    c = F.split("value", "\t")
    t = t.select(c[0].alias("contig"), c[1].cast("int").alias("start"), c[2].cast("int").alias("end"), F.coalesce(F.get(c, F.lit(3)), F.lit("mask")).alias("class"))
    return t.where(F.col("contig") == contig) if contig else t


def masked_windows(windows: DataFrame, mask: DataFrame, width: int = 1000) -> DataFrame:
    """Windows overlapping no mask interval of their contig (SRC-12).

    windows: (contig, start, end). Both sides are cut into buckets so that the overlap test
    rides on an equi-join.
    """
    def cells(df):
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))

    w = cells(windows).alias("w")
    m = cells(mask.select("contig", F.col("start"), F.col("end"))).select(
        "contig", "cell", F.col("start").alias("ms"), F.col("end").alias("me"))
    hit = w.join(m, ["contig", "cell"]).where((F.col("start") < F.col("me")) & (F.col("end") > F.col("ms"))).select("contig", "start", "end").distinct()
    return windows.join(hit, ["contig", "start", "end"], "left_anti")


def read_control(spark: SparkSession, path, columns: dict[str, str], lists: tuple[str, ...] = ()) -> DataFrame:
    """Control table with '#' comments; columns found by header prefix; list cells split on
    comma or semicolon (SRC-13). ``columns`` maps the wanted name to a header prefix."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#")
    picked = []
    for name, prefix in columns.items():
        src = next((c for c in t.columns if c.lower().startswith(prefix.lower())), None)
        if src is None:
            raise ValueError(f"no column starts with {prefix!r}")
        c = F.col(f"`{src}`")
        picked.append((F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "") if name in lists else c).alias(name))
    return t.select(*picked)


def read_layer_table(spark: SparkSession, path) -> DataFrame:
    """Hand-filled layer results; an empty cell stays NULL, not zero (SRC-16)."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", schema="target string, hits long, organelle long")
