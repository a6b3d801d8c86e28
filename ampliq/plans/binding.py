"""Roles of the driver tables: documents are reads, benchmark items are references.

The DataFrame side and the SQL text side state the same mapping, so that an oracle
never depends on Spark code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The scan as it is; where the session sets ampliq.spread (bench and tests, whose files are one row group), over so many tasks."""
    tasks = int(df.sparkSession.conf.get("ampliq.spread", "0"))
    return df.repartition(tasks, key) if tasks else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, bin, library, seq"""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("read_id"), F.col("source").alias("bin"),
                    F.col("lang").alias("library"), S.text_to_bases("text").alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, seq"""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("ref_id"), S.text_to_bases("text").alias("seq"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primer pairs cut from the references: pair, fwd, rev (120-base products)."""
    r = references(spark, sf_dir).where(F.length("seq") >= 120)
    return r.select(F.concat(F.lit("P"), F.col("ref_id").cast("string")).alias("pair"),
                    F.substring("seq", 1, 20).alias("fwd"),
                    S.revcomp(F.substring("seq", 101, 20)).alias("rev"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin, role: decided by the labelled share of each bin's reads.

    Bins whose labelled reads are at least 60 % good are members, at most 40 %
    competitors, the rest mixed.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("bin"))
    q = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    g = q.groupBy("bin").agg(F.avg("quality").alias("share"))
    return g.select("bin", F.when(F.col("share") >= 0.6, "member")
                    .when(F.col("share") <= 0.4, "competitor").otherwise("mixed").alias("role"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, grp, seq: reads that begin with the same 40 bases are the members of a group, told by its smallest read; the rest have no group."""
    return families_of(reads(spark, sf_dir))


def families_of(r: DataFrame, *more: str) -> DataFrame:
    """``families`` of given reads, with ``more`` of their columns."""
    r = r.select(F.col("read_id").alias("seq_id"), "seq", F.substring("seq", 1, 40).alias("head"), *more)
    n = r.where("length(head) = 40").groupBy("head").agg(F.min("seq_id").alias("grp"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return r.join(n, "head", "left").select("seq_id", "grp", "seq", *more)


_L = "abcdefghijklmnopqrstuvwxyz"
_B = "ACGTACGTACGTACGTACGTACGTAC"


def sql_bases(expr: str) -> str:
    return f"regexp_replace(translate({expr}, '{_L}{_L.upper()}', '{_B}{_B}'), '[^ACGT]', '', 'g')"


def sql_rc(expr: str) -> str:
    return f"reverse(translate({expr}, 'ACGTRYSWKMBDHVNU', 'TGCAYRSWMKVHDBNA'))"


READS = f"reads AS (SELECT doc_id AS read_id, source AS bin, lang AS library, {sql_bases('text')} AS seq FROM documents)"
FAMILIES = """fam AS (SELECT read_id, seq, grp FROM reads LEFT JOIN (SELECT substr(seq, 1, 40) AS head, min(read_id) AS grp FROM reads
  WHERE length(seq) >= 40 GROUP BY 1 HAVING count(*) > 1) ON head = substr(seq, 1, 40))"""
REFS = f"refs AS (SELECT item_id AS ref_id, {sql_bases('text')} AS seq FROM benchmark)"
PANEL = f"""panel AS (SELECT 'P' || ref_id AS pair, substr(seq, 1, 20) AS fwd,
  {sql_rc('substr(seq, 101, 20)')} AS rev FROM refs WHERE length(seq) >= 120)"""
MEMBERSHIP = """membership AS (SELECT bin, CASE WHEN share >= 0.6 THEN 'member' WHEN share <= 0.4 THEN 'competitor'
  ELSE 'mixed' END AS role FROM (SELECT source AS bin, avg(quality) AS share
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1))"""


def _title(w):
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record header per sentence of every document, in seven dialects.

    doc_id, idx, database, header
    """
    d = documents(spark, sf_dir)
    s = d.select("doc_id", F.posexplode(F.split("text", "[.\n]+")).alias("idx", "sentence"))
    w = F.regexp_extract_all("sentence", F.lit("([A-Za-z]{3,})"), F.lit(1))
    s = S.bind(s, w=w).where(F.size("w") >= 2)
    g, e = _title(F.get("w", F.lit(0))), F.lower(F.get("w", F.lit(1)))
    o = _title(F.get("w", F.size("w") - 1))
    acc = F.lpad(F.col("doc_id").cast("string"), 6, "0")
    kind = F.pmod(F.col("doc_id") + F.col("idx"), F.lit(7))
    c = F.concat
    lit = F.lit
    header = (
        F.when(kind == 0, c(lit("AB"), acc, lit(".1.1500 Bacteria;"), o, lit("ota;"), o, lit("ales;"), g, lit(";"), g, lit(" "), e))
        .when(kind == 1, c(lit("KJ"), acc, lit("|k__Fungi;p__"), o, lit("mycota;g__"), g, lit(";s__"), g, lit("_"), e, lit("|SH1")))
        .when(kind == 2, c(lit("CC"), acc, lit(".1.1740_U|18S_rRNA|nucleus||Eukaryota|TSAR|"), o, lit("|"), g, lit("|"), g, lit("_"), e))
        .when(kind == 3, c(lit("NR_"), acc, lit(".1 "), g, lit(" "), e, lit(" strain X 16S ribosomal RNA")))
        .when(kind == 4, c(lit("GCA_"), acc, lit("|AE1.1/1-2|Eukaryota;Opisthokonta;"), o, lit(";"), g, lit(" "), e))
        .when(kind == 5, c(lit("RS_GCF"), acc, lit(" d__Archaea;p__"), o, lit("ota;g__"), g, lit(";s__"), g, lit(" "), e, lit(" [loc=1]")))
        .otherwise(c(lit("CD"), acc, lit(".1.900 Bacteria;Cyanobacteriota;Chloroplast;"), g, lit(";uncultured bacterium"))))
    db = (F.when(kind.isin(0, 6), "SILVA_SSU.fasta").when(kind == 1, "UNITE_ITS.fasta").when(kind == 2, "PR2_SSU.fasta")
          .when(kind == 3, "bacteria.16S.fna").when(kind == 4, "ROD.fasta").otherwise("GTDB_ssu.fna"))
    return S.bind(s, database=db, header=header).select("doc_id", "idx", "database", "header")


HEADERS = """sents AS (SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INTEGER AS idx
  FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS s FROM documents)),
hw AS (SELECT doc_id, idx, regexp_extract_all(sentence, '[A-Za-z]{3,}') AS w FROM sents),
hp AS (SELECT doc_id, idx, (doc_id + idx) % 7 AS kind, lpad(doc_id::VARCHAR, 6, '0') AS acc,
  upper(left(w[1], 1)) || lower(substr(w[1], 2)) AS g, lower(w[2]) AS e,
  upper(left(w[-1], 1)) || lower(substr(w[-1], 2)) AS o FROM hw WHERE len(w) >= 2),
headers AS (SELECT doc_id, idx,
  CASE WHEN kind IN (0, 6) THEN 'SILVA_SSU.fasta' WHEN kind = 1 THEN 'UNITE_ITS.fasta' WHEN kind = 2 THEN 'PR2_SSU.fasta'
    WHEN kind = 3 THEN 'bacteria.16S.fna' WHEN kind = 4 THEN 'ROD.fasta' ELSE 'GTDB_ssu.fna' END AS database,
  CASE kind WHEN 0 THEN 'AB' || acc || '.1.1500 Bacteria;' || o || 'ota;' || o || 'ales;' || g || ';' || g || ' ' || e
    WHEN 1 THEN 'KJ' || acc || '|k__Fungi;p__' || o || 'mycota;g__' || g || ';s__' || g || '_' || e || '|SH1'
    WHEN 2 THEN 'CC' || acc || '.1.1740_U|18S_rRNA|nucleus||Eukaryota|TSAR|' || o || '|' || g || '|' || g || '_' || e
    WHEN 3 THEN 'NR_' || acc || '.1 ' || g || ' ' || e || ' strain X 16S ribosomal RNA'
    WHEN 4 THEN 'GCA_' || acc || '|AE1.1/1-2|Eukaryota;Opisthokonta;' || o || ';' || g || ' ' || e
    WHEN 5 THEN 'RS_GCF' || acc || ' d__Archaea;p__' || o || 'ota;g__' || g || ';s__' || g || ' ' || e || ' [loc=1]'
    ELSE 'CD' || acc || '.1.900 Bacteria;Cyanobacteriota;Chloroplast;' || g || ';uncultured bacterium' END AS header FROM hp)"""


def sql_kmers(k: int, source: str = "reads", key: str = "read_id", step: int = 1) -> str:
    """CTEs yielding kmers(key, pos, kmer): every k-mer, cut from overlapping pieces."""
    return f"""kpiece AS (SELECT {key}, length(seq) AS n, c, substr(seq, c * 256 + 1, {256 + k}) AS s FROM (
  SELECT {key}, seq, unnest(range(0, length(seq) // 256 + 1)) AS c FROM {source})),
kmers AS (SELECT {key}, c * 256 + i AS pos, substr(s, i + 1, {k}) AS kmer FROM (
  SELECT *, unnest(range(0, 256)) AS i FROM kpiece) WHERE c * 256 + i + {k} <= n AND (c * 256 + i) % {step} = 0)"""
