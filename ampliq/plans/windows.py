"""Designs inside the windows of a group's backbones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import window_design as W
from ..session import cut_lineage
from .binding import FAMILIES, READS, families, families_of, reads, sql_kmers, sql_rc
from .design import MASK_SQL, TM_SQL
from .panel import wilson_sql
from .registry import query

#: Groups are ``families``; bins are sources, those with an even last digit stand for full-length libraries. A bin with a member is a member
#: bin, the other bins of its languages are competitors. The marked locus is the second quarter of a backbone.
_RULES = W.Rules(lengths=(20, 20), max_mm=0, min_reads=25)
_BACK = f"""{READS}, {FAMILIES},
mb AS MATERIALIZED (SELECT fam.read_id, fam.seq, grp, bin, library, right(bin, 1) IN ('0', '2', '4', '6', '8') IS TRUE AS long FROM fam JOIN reads ON reads.read_id = fam.read_id),
ml AS MATERIALIZED (SELECT grp, length(seq) AS n, min(read_id) AS bb FROM mb WHERE grp IS NOT NULL AND length(seq) >= 120 GROUP BY ALL),
bl(grp, n) AS (SELECT grp, max(n) FROM ml GROUP BY 1 UNION ALL SELECT bl.grp, max(ml.n) FROM bl JOIN ml ON ml.grp = bl.grp AND bl.n >= 1.5 * ml.n GROUP BY bl.grp),
bk AS MATERIALIZED (SELECT bl.grp, bb AS ref_id, mb.seq, length(mb.seq) AS n FROM bl JOIN ml ON ml.grp = bl.grp AND ml.n = bl.n JOIN mb ON read_id = bb)"""

_SQL = f"""WITH RECURSIVE {_BACK},
wins AS (SELECT ref_id, pos, 20 AS len, dir, CASE dir WHEN 'F' THEN w ELSE {sql_rc('w')} END AS oligo FROM (
  SELECT ref_id, pos, substr(seq, pos + 1, 20) AS w FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - 19)) AS pos FROM bk)), (VALUES ('F'), ('R')) d(dir)),
{TM_SQL}, {MASK_SQL},
{sql_kmers(20)},
o AS (SELECT DISTINCT oligo FROM cm),
site AS MATERIALIZED (SELECT oligo, read_id, '+' AS strand, pos AS start FROM kmers JOIN o ON kmer = oligo
  UNION ALL SELECT oligo, read_id, '-', pos FROM kmers JOIN (SELECT oligo, {sql_rc('oligo')} AS back FROM o) ON kmer = back),
bf AS MATERIALIZED (SELECT DISTINCT oligo, strand, read_id FROM site),
size AS (SELECT grp, count(*) AS n, count(*) FILTER (long) AS nl FROM mb WHERE grp IS NOT NULL GROUP BY 1),
ask AS (SELECT DISTINCT grp, oligo, CASE dir WHEN 'F' THEN '+' ELSE '-' END AS strand FROM cm JOIN bk USING (ref_id)),
un AS MATERIALIZED (SELECT ask.grp, ask.oligo, ask.strand, count(*) = any_value(size.n) AS in_all, count(*) FILTER (long) = any_value(nl) AND any_value(nl) > 0 AS in_long
  FROM ask JOIN bf USING (oligo, strand) JOIN mb ON mb.read_id = bf.read_id AND mb.grp = ask.grp JOIN size ON size.grp = ask.grp GROUP BY ALL),
uo AS (SELECT cm.*, grp, n, in_all, in_long FROM cm JOIN bk USING (ref_id) JOIN un USING (grp, oligo) WHERE un.strand = CASE dir WHEN 'F' THEN '+' ELSE '-' END),
pb AS MATERIALIZED (SELECT grp, backbone, f_pos, r_end, fwd, rev, bp, base FROM (
  SELECT f.grp, f.ref_id AS backbone, f.pos AS f_pos, r.pos + 20 AS r_end, f.oligo AS fwd, r.oligo AS rev, r.pos + 20 - f.pos AS bp, f.in_all AND r.in_all AS al, f.in_long AND r.in_long AS lo,
    CASE WHEN f.pos >= f.n // 2 OR r.pos + 20 <= f.n // 4 THEN 'long' ELSE 'all' END AS base
  FROM (SELECT *, unnest([pos // 400, pos // 400 + 1]) AS cell FROM uo WHERE dir = 'F') f JOIN (SELECT *, (pos + 20) // 400 AS cell FROM uo WHERE dir = 'R') r ON f.ref_id = r.ref_id AND f.cell = r.cell
  WHERE r.pos + 20 - f.pos BETWEEN 60 AND 400 AND r.pos >= f.pos + 20 AND f.pm & r.pm <> 0) WHERE CASE base WHEN 'all' THEN al ELSE lo END),
rb AS MATERIALIZED (SELECT ask.*, bf.read_id FROM ask JOIN bf USING (oligo, strand) JOIN mb ON mb.read_id = bf.read_id WHERE mb.grp IS DISTINCT FROM ask.grp),
rf AS MATERIALIZED (SELECT p.*, read_id FROM (SELECT DISTINCT grp, fwd, rev FROM pb) p JOIN rb f ON f.grp = p.grp AND f.oligo = fwd AND f.strand = '+'),
rv AS (SELECT rf.grp, fwd, rev, count(*) AS rivals FROM rf JOIN rb r ON r.grp = rf.grp AND r.oligo = rev AND r.strand = '-' AND r.read_id = rf.read_id GROUP BY ALL),
w0 AS (SELECT grp, ref_id AS backbone, n, unnest(range(0, greatest(1, floor((n - 700) / 300)::INT + 2))) AS win FROM bk),
wn AS (SELECT grp, backbone, win, least(win * 300, greatest(0, n - 700)) AS s, least(n, least(win * 300, greatest(0, n - 700)) + 700) AS e FROM w0),
wc AS MATERIALIZED (SELECT * FROM (SELECT pb.*, win, coalesce(rivals, 0) AS rivals, row_number() OVER (PARTITION BY pb.grp, pb.backbone, win ORDER BY coalesce(rivals, 0), bp > 150, bp, pb.fwd, pb.rev, f_pos) AS place
  FROM pb JOIN wn ON wn.backbone = pb.backbone AND f_pos >= s AND r_end <= e LEFT JOIN rv ON rv.grp = pb.grp AND rv.fwd = pb.fwd AND rv.rev = pb.rev) WHERE place <= 8),
ch AS (SELECT DISTINCT grp, fwd, rev, base FROM wc),
hf AS MATERIALIZED (SELECT c.*, s.read_id, s.strand, s.start FROM (SELECT DISTINCT grp, fwd, rev FROM ch) c JOIN site s ON s.oligo = fwd),
hit AS (SELECT DISTINCT grp, fwd, rev, s.read_id FROM hf s JOIN site t ON t.oligo = rev AND t.read_id = s.read_id AND t.strand <> s.strand
  WHERE CASE WHEN s.strand = '+' THEN t.start + 20 - s.start ELSE s.start + 20 - t.start END BETWEEN 60 AND 400),
hk AS (SELECT hit.grp, fwd, rev, bin, count(*) AS k FROM hit JOIN reads USING (read_id) GROUP BY ALL),
bn AS (SELECT bin, count(*) AS n FROM reads GROUP BY 1),
ro AS (SELECT DISTINCT a.grp, b.bin, right(b.bin, 1) IN ('0', '2', '4', '6', '8') IS TRUE AS long, (a.grp, b.bin) IN (SELECT (grp, bin) FROM mb WHERE grp IS NOT NULL) AS member
  FROM (SELECT DISTINCT grp, library FROM mb WHERE grp IS NOT NULL) a JOIN (SELECT DISTINCT library, bin FROM mb) b USING (library)),
rt AS (SELECT ch.*, ro.bin, member, n, coalesce(k, 0) AS k FROM ch JOIN ro ON ro.grp = ch.grp AND (base = 'all' OR long) JOIN bn ON bn.bin = ro.bin
  LEFT JOIN hk ON hk.grp = ch.grp AND hk.fwd = ch.fwd AND hk.rev = ch.rev AND hk.bin = ro.bin),
wf AS (SELECT grp, fwd, rev, base, count(*) FILTER (member) AS member_bins, count(*) FILTER (member AND k / n::DOUBLE >= 0.2) AS covered_bins,
  min({wilson_sql('k', 'n', False)}) FILTER (member) AS low, max({wilson_sql('k', 'n', True)}) FILTER (NOT member AND n >= 25) AS high FROM rt GROUP BY ALL HAVING count(*) FILTER (member) > 0),
mm AS (SELECT wc.*, member_bins, covered_bins, CASE WHEN high > 0 THEN low / high END AS fold FROM wc LEFT JOIN wf USING (grp, fwd, rev, base)),
wi AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, backbone, win) AS candidates, row_number() OVER (PARTITION BY grp, backbone, win ORDER BY fold DESC NULLS LAST, place) AS won FROM mm) WHERE won = 1)
SELECT wn.grp, wn.backbone, wn.win AS "window", s AS start, e AS "end", coalesce(candidates, 0) AS candidates, fwd, rev, f_pos, r_end, bp, base, rivals, member_bins, covered_bins, round(fold, 6) AS fold
FROM wn LEFT JOIN wi ON wi.backbone = wn.backbone AND wi.win = wn.win WHERE e - s >= 120"""


def _members(r):
    even = F.coalesce(F.right("bin", F.lit(1)).isin("0", "2", "4", "6", "8"), F.lit(False))
    return families_of(r, "bin", "library").withColumn("long", even)


@query("backbones", "OPT-02", f"WITH RECURSIVE {_BACK} SELECT grp, ref_id AS seq_id, n FROM bk")
def backbones(spark, sf):
    return W.backbones(families(spark, sf)).select("grp", "seq_id", F.length("seq").cast("long").alias("n"))


@query("window_designs", "OPT-02", _SQL)
def window_designs(spark, sf):
    r = cut_lineage(reads(spark, sf))
    m = cut_lineage(_members(r))
    own = m.where("grp is not null").select("grp", "library", "bin").distinct()
    bins = m.select("library", "bin", "long").distinct()
    roles = own.select("grp", "library").distinct().join(bins, "library").select("grp", "bin", "long").distinct()
    roles = roles.join(own.select("grp", "bin", F.lit("member").alias("role")).distinct(), ["grp", "bin"], "left").withColumn("role", F.coalesce("role", F.lit("competitor")))
    n = F.length("seq")
    loci = m.select("seq_id", F.floor(n / 4).alias("lo"), F.floor(n / 2).alias("hi"))
    return W.window_designs(m.select("seq_id", "grp", "long", "seq"), r.select("read_id", "bin", "seq"), roles, loci, _RULES).withColumn("fold", F.round("fold", 6))
