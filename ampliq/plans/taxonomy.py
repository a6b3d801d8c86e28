"""Header and organism-name queries (TAX family, FLT-11..14, GRF-08, GRF-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import seq as S
from ..operators import lineage as L
from .binding import HEADERS, documents, headers, table
from .registry import query

UNNAMED_SQL = "(" + ", ".join(f"'{t}'" for t in N.UNNAMED_TOKENS) + ")"
UNINF = "|".join(N.UNINFORMATIVE)


def sql_words(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^a-z]+'), lambda w: w <> '')"


def sql_unnamed(expr: str) -> str:
    w = sql_words(expr)
    return f"(len({w}) = 0 OR coalesce(({w})[1] IN {UNNAMED_SQL}, false) OR coalesce(({w})[2] IN {UNNAMED_SQL}, false))"


ORGANISM_SQL = f"""org AS (SELECT doc_id, idx, database, header, CASE
  WHEN regexp_matches(header, '^(RS_|GB_)') AND contains(header, 's__') THEN
    CASE WHEN regexp_matches(trim(regexp_extract(header, 's__([^;\\[]+)', 1)), '^[A-Z][a-z]+(_[A-Z]+)? [a-z][a-z0-9-]+$')
          AND NOT regexp_matches(trim(regexp_extract(header, 's__([^;\\[]+)', 1)), ' (sp|cf|aff)$')
         THEN trim(regexp_extract(header, 's__([^;\\[]+)', 1))
         ELSE nullif(regexp_extract(header, 'g__([A-Z][a-z]+(?:_[A-Z]+)?)(?:;|\\s|$)', 1), '') END
  WHEN regexp_matches(header, '\\|(18S|16S)_rRNA\\|') THEN
    CASE WHEN regexp_matches(replace(bars[-1], '_', ' '), '^[A-Z][a-z]+ [a-z][a-z-]+$')
          AND NOT regexp_matches(replace(bars[-1], '_', ' '), ' (sp|cf|aff)$') THEN replace(bars[-1], '_', ' ')
         WHEN regexp_matches(bars[-2], '^[A-Z][a-z]{{2,}}$') THEN bars[-2] END
  WHEN regexp_matches(header, '^\\S+\\s+(Candidatus [A-Z][a-z]+|[A-Z][a-z]+)\\s+[a-z][a-z-]+')
    THEN regexp_extract(header, '^\\S+\\s+((?:Candidatus )?[A-Z][a-z]+\\s+[a-z][a-z-]+)', 1)
  WHEN contains(header, ';') THEN walked[1]
  ELSE nullif(regexp_extract(header, '^\\S+\\s+(\\S+\\s+\\S+)', 1), '') END AS name FROM (
  SELECT *, list_filter(list_transform(list_reverse(path), lambda n: CASE WHEN n = '' OR regexp_matches(lower(n), '{UNINF}') THEN NULL
    WHEN regexp_matches(n, '^[A-Z][a-z]+ [a-z][a-z-]+$') AND regexp_matches(n, ' (sp|spp|cf|aff)$') THEN string_split(n, ' ')[1]
    WHEN regexp_matches(n, '^[A-Z][a-z]+ [a-z][a-z-]+$') OR regexp_matches(n, '^[A-Z][a-z]{{2,}}$')
      OR regexp_matches(n, '^Candidatus [A-Z][a-z]+( [a-z][a-z-]+)?$') THEN n END), lambda x: x IS NOT NULL) AS walked FROM (
  SELECT *, list_filter(list_transform(string_split(header, '|'), lambda x: trim(x)), lambda x: x <> '') AS bars,
    list_transform(list_filter(list_transform(string_split(header, ';'), lambda x: trim(x)), lambda x: x <> ''),
      lambda x: trim(regexp_replace(trim(replace(regexp_replace(trim(string_split(x, '|')[1]), '^[kpcofgs]__', ''), '_', ' ')),
        '^\\S*\\d\\S*\\s+', ''))) AS path FROM headers)))"""


@query("header_parse", "TAX-01",
       f"""WITH {HEADERS}, p AS (SELECT *, string_split(header, '|') AS bars FROM headers),
raw AS (SELECT doc_id, idx, database, header, CASE database
  WHEN 'UNITE_ITS.fasta' THEN string_split(bars[2], ';') WHEN 'PR2_SSU.fasta' THEN bars[5:]
  WHEN 'ROD.fasta' THEN string_split(bars[3], ';')
  WHEN 'SILVA_SSU.fasta' THEN string_split(regexp_replace(header, '^[^ ]* ', ''), ';')
  WHEN 'GTDB_ssu.fna' THEN string_split(regexp_replace(header, '^[^ ]* ', ''), ';') ELSE [] END AS t FROM p),
tok AS (SELECT doc_id, idx, database, header, flatten(list_transform(list_transform(t, lambda x: regexp_replace(trim(x), '^[kpcofgs]__', '')),
  lambda x: CASE WHEN contains(x, '_') THEN [x, regexp_replace(x, '_+', ' ', 'g')] ELSE [x] END)) AS t FROM raw)
SELECT doc_id, idx, CASE database WHEN 'bacteria.16S.fna' THEN 'Bacteria' WHEN 'GTDB_ssu.fna' THEN '?'
    WHEN 'SILVA_SSU.fasta' THEN 'Bacteria' ELSE 'Eukaryota' END AS domain,
  coalesce(list_has_any(t, ['Chloroplast', 'Mitochondria']), false) AS organelle,
  database NOT IN ('bacteria.16S.fna', 'GTDB_ssu.fna') AS has_taxonomy,
  CASE WHEN database IN ('bacteria.16S.fna', 'GTDB_ssu.fna') THEN NULL ELSE len(t) END AS n_tokens FROM tok""")
def header_parse(spark, sf):
    h = headers(spark, sf).withColumn("p", N.parse_header("header", "database"))
    return h.select("doc_id", "idx", "p.domain", "p.organelle", "p.has_taxonomy",
                    F.when(F.col("p.has_taxonomy"), F.size("p.tokens")).cast("long").alias("n_tokens"))


@query("hit_class_counts", "TAX-02 AGG-12 AGG-13",
       f"""WITH {HEADERS}, d AS (SELECT *, CASE WHEN contains(header, 'Eukaryota') OR contains(header, 'k__Fungi') THEN 'Eukaryota' WHEN contains(header, 'Bacteria;') OR database = 'bacteria.16S.fna' THEN 'Bacteria' ELSE '?' END AS domain,
  contains(header, 'Chloroplast') AS organelle, database NOT IN ('bacteria.16S.fna', 'GTDB_ssu.fna') AS taxonomy FROM headers),
t(target, own) AS (VALUES ('cyano', 'Bacteria'), ('fungi', 'Eukaryota')),
c AS (SELECT target, database, CASE WHEN (target = 'cyano' AND regexp_matches(header, '\\bCyanobacteriota')) OR (target = 'fungi' AND (regexp_matches(header, '\\b(k__)?Fungi') OR contains(header, '[Eubacterium]')))
    THEN CASE WHEN organelle THEN 'organelle' ELSE 'in' END
  WHEN domain = '?' THEN 'unknown' WHEN domain <> own THEN 'other_domain' WHEN taxonomy THEN 'same_domain' ELSE 'unknown' END AS class FROM d CROSS JOIN t)
SELECT target, database, count(*) FILTER (class = 'in') AS n_in, count(*) FILTER (class = 'organelle') AS n_organelle,
  count(*) FILTER (class = 'same_domain') AS n_same, count(*) FILTER (class = 'other_domain') AS n_other,
  count(*) FILTER (class = 'unknown') AS n_unknown, count(*) FILTER (class IN ('same_domain', 'other_domain')) AS off_clade
FROM c GROUP BY ALL""")
def hit_class_counts(spark, sf):
    targets = F.array(F.struct(F.lit("cyano").alias("target"), F.array(F.lit("Cyanobacteriota")).alias("clade"), F.lit("Bacteria").alias("own")),
                      F.struct(F.lit("fungi").alias("target"), F.array(F.lit("[Eubacterium]"), F.lit("Fungi")).alias("clade"), F.lit("Eukaryota").alias("own")))
    h = headers(spark, sf).withColumn("p", N.parse_header("header", "database")).select("database", "p", F.explode(targets).alias("t"))
    c = h.select("database", "t.target", N.hit_class("p", F.col("t.clade"), F.col("t.own")).alias("class"))
    return L.class_counters(c, ["target", "database"], "class")


@query("binomial_identity", "TAX-03",
       f"""WITH {HEADERS}, m AS (SELECT doc_id, idx, header,
  coalesce(nullif(regexp_extract(header, '[;|]\\s*([A-Z][a-z]{{2,}})[ _]([a-z]{{2,}})', 1), ''),
           nullif(regexp_extract(header, '\\b([A-Z][a-z]{{3,}})\\s+([a-z]{{3,}})\\b', 1), '')) AS g,
  coalesce(nullif(regexp_extract(header, '[;|]\\s*([A-Z][a-z]{{2,}})[ _]([a-z]{{2,}})', 2), ''),
           nullif(regexp_extract(header, '\\b([A-Z][a-z]{{3,}})\\s+([a-z]{{3,}})\\b', 2), '')) AS e FROM headers)
SELECT doc_id, idx, CASE WHEN g IS NULL THEN nullif(regexp_extract(header, 'g__([A-Za-z_]+)', 1), '')
  WHEN NOT {sql_unnamed("g || ' ' || e")} THEN g END AS genus,
  CASE WHEN g IS NOT NULL AND NOT {sql_unnamed("g || ' ' || e")} THEN g || ' ' || e END AS species FROM m""")
def binomial_identity(spark, sf):
    return headers(spark, sf).select("doc_id", "idx", N.binomial("header").alias("b")).select(
        "doc_id", "idx", "b.genus", "b.species")


@query("organism_name", "TAX-04", f"WITH {HEADERS}, {ORGANISM_SQL} SELECT doc_id, idx, name FROM org")
def organism_name(spark, sf):
    return headers(spark, sf).select("doc_id", "idx", N.organism("header").alias("name"))


PLACE = "(" + ", ".join(f"'{t}'" for t in N.PLACEHOLDER_EPITHETS) + ")"
HIGH = "|".join(N.HIGH_RANK_ENDINGS)


@query("name_predicates", "FLT-11 FLT-12 FLT-13 FLT-14 TAX-08",
       f"""WITH {HEADERS}, {ORGANISM_SQL} SELECT doc_id, idx, {sql_unnamed('name')} AS unnamed,
  regexp_matches(lower(header), '{"|".join(N.UNNAMED_TOKENS)}') AS mentions_unnamed,
  NOT contains(name, ' ') AND (lower(name) IN ({", ".join(f"'{t}'" for t in N.HIGH_RANK_NAMES)}) OR regexp_matches(name, '({HIGH})$')) AS above_genus,
  regexp_extract(name, '^(Candidatus \\S+|\\S+)', 1) AS genus,
  CASE WHEN lower(regexp_extract(name, '^(?:Candidatus \\S+|\\S+)\\s+(\\S+)', 1)) NOT IN {PLACE}
    THEN nullif(regexp_extract(name, '^(?:Candidatus \\S+|\\S+)\\s+(\\S+)', 1), '') END AS epithet
FROM org WHERE name IS NOT NULL""")
def name_predicates(spark, sf):
    h = headers(spark, sf).withColumn("name", N.organism("header")).where("name IS NOT NULL")
    return h.select("doc_id", "idx", N.is_unnamed("name").alias("unnamed"), N.mentions_unnamed("header").alias("mentions_unnamed"),
                    N.above_genus("name").alias("above_genus"), N.genus_of("name").alias("genus"),
                    N.epithet_of("name").alias("epithet"))


NOISE = "(" + ", ".join(f"'{t}'" for t in N.STRICT_NOISE) + ")"


@query("binomial_strict", "TAX-05",
       f"""WITH {HEADERS}, p AS (SELECT doc_id, idx, list_filter(list_transform(string_split_regex(header, '[|;]'),
   lambda x: regexp_replace(trim(x), '^[a-z]__', '')), lambda x: regexp_matches(x, '^[A-Z][a-z]+_[a-z][a-z-]+$')
   AND lower(string_split(x, '_')[1]) NOT IN {NOISE} AND lower(string_split(x, '_')[2]) NOT IN {NOISE}) AS hits,
  list_filter(string_split_regex(header, '\\s+'), lambda w: w <> '') AS words FROM headers)
SELECT doc_id, idx, coalesce(replace(hits[1], '_', ' '), CASE WHEN regexp_matches(words[2], '^[A-Z][a-z]+$')
  AND regexp_matches(words[3], '^[a-z][a-z-]+$') AND lower(words[2]) NOT IN {NOISE} AND lower(words[3]) NOT IN {NOISE}
  THEN words[2] || ' ' || words[3] END) AS species FROM p""")
def binomial_strict(spark, sf):
    return headers(spark, sf).select("doc_id", "idx", N.strict_binomial("header").alias("species"))


@query("accession_tokens", "TAX-06 TAX-07",
       f"""WITH {HEADERS} SELECT doc_id, idx, nullif(regexp_extract(header, '^([A-Z]{{1,2}}_?[0-9]{{5,8}})', 1), '') AS accession,
  len(list_distinct(list_filter(string_split_regex(lower(header), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ('strain', 'uncultured')))) AS n_tokens
FROM headers""")
def accession_tokens(spark, sf):
    return headers(spark, sf).select("doc_id", "idx", N.accession("header").alias("accession"),
                                     F.size(N.token_set("header", ("strain", "uncultured"))).cast("long").alias("n_tokens"))


@query("lineage_text", "TAX-09 TAX-12",
       f"""WITH {HEADERS}, t AS (SELECT doc_id, idx, database, header, CASE WHEN database LIKE 'UNITE%' THEN string_split(header, '|')[2]
  WHEN database LIKE 'PR2%' THEN array_to_string(string_split(header, '|')[5:], ';')
  WHEN contains(header, ' ') THEN regexp_replace(header, '^[^ ]* ', '') ELSE '' END AS lineage,
  CASE WHEN regexp_matches(database, 'UNITE|ITS') THEN 'ITS' WHEN regexp_matches(upper(database), 'LSU|28S|23S') THEN 'LSU' ELSE 'SSU' END AS locus
  FROM headers)
SELECT doc_id, idx, lineage, locus, CASE WHEN (idx % 2 = 0) AND regexp_matches(header, 'Eukaryota|Fungi|Dikarya') THEN 'LSU_FUNGAL'
  WHEN idx % 2 = 0 THEN 'LSU' ELSE locus END AS corrected FROM t""")
def lineage_text(spark, sf):
    h = headers(spark, sf).withColumn("locus", N.locus_of("database"))
    asked = F.when(F.col("idx") % 2 == 0, "LSU").otherwise(F.col("locus"))
    return h.select("doc_id", "idx", N.taxonomy_of("header", "database").alias("lineage"), "locus",
                    N.corrected_locus(asked, "header").alias("corrected"))


@query("non_fungal_eukaryote", "TAX-10",
       f"""WITH {HEADERS}, b AS (SELECT doc_id, idx, database, header, string_split(header, '|') AS bars FROM headers)
SELECT doc_id, idx, CASE WHEN contains(header, '|') AND NOT contains(header, ';') THEN
    CASE WHEN list_contains(bars, 'Eukaryota') AND NOT list_contains(bars, 'Fungi') THEN
      trim(replace(coalesce(list_filter(list_reverse(bars), lambda t: NOT regexp_matches(replace(t, '_', ' '), '(^| )X+( |$)')
        AND NOT regexp_matches(t, '(^|_)sp\\.?$') AND t <> 'Eukaryota' AND regexp_matches(trim(replace(t, '_', ' ')), '^[A-Z]')
        AND NOT {sql_unnamed("replace(t, '_', ' ')")})[1], 'Eukaryota'), '_', ' ')) END END AS name FROM b""")
def non_fungal_eukaryote(spark, sf):
    return headers(spark, sf).select("doc_id", "idx", N.non_fungal_eukaryote("header").alias("name"))


@query("name_agreement", "TAX-16 TAX-11",
       f"""WITH {HEADERS}, {ORGANISM_SQL}, n AS (SELECT doc_id, idx, name FROM org WHERE name IS NOT NULL),
pair AS (SELECT a.doc_id, a.idx, a.name AS x, b.name AS y FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1),
g AS (SELECT *, CASE WHEN regexp_matches(gx0, '^[a-z]') AND NOT regexp_matches(gx0, '{N.HIGHER_TAXON}') THEN gx0 END AS gx,
  CASE WHEN regexp_matches(gy0, '^[a-z]') AND NOT regexp_matches(gy0, '{N.HIGHER_TAXON}') THEN gy0 END AS gy FROM (
  SELECT *, lower(regexp_extract(x, '^\\S+')) AS gx0, lower(regexp_extract(y, '^\\S+')) AS gy0 FROM pair)),
h AS (SELECT *, list_filter(string_split_regex(lower(x), '[^a-z]+'), lambda t: regexp_matches(t, '{N.HIGHER_TAXON}')) AS hx,
  coalesce(list_filter(string_split_regex(lower(y), '[^a-z]+'), lambda t: regexp_matches(t, '{N.HIGHER_TAXON}')), []) AS hy FROM g)
SELECT doc_id, idx, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN CASE WHEN gx = gy THEN 'agree' ELSE 'disagree' END
  WHEN len(hx) > 0 AND len(hy) > 0 THEN CASE WHEN list_has_any(hx, hy) THEN 'agree' ELSE 'disagree' END
  ELSE 'not comparable' END AS verdict FROM h""")
def name_agreement(spark, sf):
    n = S.bind(headers(spark, sf), x=N.organism("header")).select("doc_id", "idx", "x").where("x IS NOT NULL")
    nxt = n.select("doc_id", (F.col("idx") - 1).alias("idx"), F.col("x").alias("y"))
    return n.join(nxt, ["doc_id", "idx"], "left").select("doc_id", "idx", N.name_agreement("x", "y").alias("verdict"))


@query("bin_name_normalised", "TAX-14 SRC-06",
       """SELECT doc_id, regexp_extract(raw, '^(.*)_([^_]*)$', 1).replace('_', '-') || '_' || regexp_extract(raw, '^(.*)_([^_]*)$', 2) AS name
FROM (SELECT doc_id, upper(left(lang, 1)) || (doc_id % 3) || '_' || (doc_id % 9) || '_' || replace(source, 'src', 'BIN') AS raw FROM documents)""")
def bin_name_normalised(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.concat(F.upper(F.substring("lang", 1, 1)), (F.col("doc_id") % 3).cast("string"), F.lit("_"),
                   (F.col("doc_id") % 9).cast("string"), F.lit("_"), F.regexp_replace("source", "src", "BIN"))
    return d.select("doc_id", N.bin_name(raw).alias("name"))


@query("source_cell_parse", "TAX-15",
       """WITH c AS (SELECT doc_id, source || ' [' || n_chars || ']: ' || lang || ' name | ' || lang || ': ' || source AS cell FROM documents),
s AS (SELECT doc_id, unnest(list_transform(string_split(cell, '|'), lambda x: trim(x))) AS part FROM c)
SELECT doc_id, trim(regexp_replace(regexp_extract(part, '^([^:]*):', 1), '\\[[^\\]]*\\]', '')) AS db,
  trim(regexp_extract(part, '^[^:]*:(.*)$', 1)) AS name FROM s""")
def source_cell_parse(spark, sf):
    d = table(spark, sf, "documents")
    cell = F.concat("source", F.lit(" ["), F.col("n_chars").cast("string"), F.lit("]: "), "lang", F.lit(" name | "), "lang",
                    F.lit(": "), "source")
    return d.select("doc_id", F.explode(N.source_cell(cell)).alias("x")).select("doc_id", "x.db", "x.name")


@query("type_material", "TAX-13 TAX-19",
       """SELECT page_id, CASE WHEN regexp_matches(html, '(?i)from\\s+TYPE\\s+material|\\btype\\s+strain\\b') THEN 'yes'
  WHEN page_id % 2 = 0 THEN 'no' ELSE 'no_information' END AS type_flag,
  CASE WHEN regexp_matches(lower(html), 'fungi|ascomyc|basidiomyc|its|28s|18s|petriella|parascedosporium|trichoderma|metarhizium')
    THEN 'fungal' ELSE 'prokaryotic' END AS guess FROM pages""")
def type_material(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", N.type_material("html", F.col("page_id") % 2 == 0).alias("type_flag"),
                    N.domain_guess("html").alias("guess"))


LABELS = {"en": "english", "de": "german", "fr": "french"}


@query("label_translation", "TAX-20",
       """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE lang END AS label FROM documents""")
def label_translation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.translate_label("lang", LABELS).alias("label"))


# ---- lineage consensus -------------------------------------------------------------------

RANKS_SQL = """items AS (SELECT doc_id, idx, list_transform(list_filter(list_transform(string_split(lineage, ';'), lambda x: trim(x)),
   lambda x: x <> ''), lambda x: trim(replace(regexp_replace(x, '^[kpcofgs]__', ''), '_', ' '))) AS it FROM lin),
stop AS (SELECT *, list_position(list_transform(it, lambda n: n = '' OR regexp_matches(lower(n),
   '^(uncultured|unidentified|unclassified|metagenome|environmental|incertae|unknown)') OR regexp_matches(n, ' sp\\.?$')
   OR contains(n, 'Incertae sedis') OR contains(lower(n), 'metagenome')), true) AS s FROM items),
ranked AS (SELECT doc_id, idx, CASE WHEN s IS NULL OR s = 0 THEN it ELSE it[:s - 1] END AS ranks FROM stop)"""
LIN_SQL = """lin AS (SELECT doc_id, idx, CASE WHEN database LIKE 'UNITE%' THEN string_split(header, '|')[2]
  WHEN database LIKE 'PR2%' THEN array_to_string(string_split(header, '|')[5:], ';')
  WHEN contains(header, ' ') THEN regexp_replace(header, '^[^ ]* ', '') ELSE '' END AS lineage FROM headers)"""


@query("lineage_consensus", "GRF-08",
       f"""WITH {HEADERS}, {LIN_SQL}, {RANKS_SQL},
full_r AS (SELECT * FROM ranked WHERE len(ranks) > 0), n AS (SELECT doc_id, count(*) AS n FROM full_r GROUP BY 1),
c AS (SELECT doc_id, pos, name, count(*) AS k FROM (SELECT doc_id, unnest(ranks) AS name, generate_subscripts(ranks, 1) AS pos FROM full_r) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k DESC, name) AS rn FROM c) WHERE rn = 1),
cut AS (SELECT doc_id, min(pos) FILTER (k::DOUBLE / n < 0.51) AS stop FROM best JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(string_agg(name, ';' ORDER BY pos) FILTER (pos < coalesce(stop, 1000000)), '') AS lineage
FROM best JOIN cut USING (doc_id) GROUP BY 1""")
def lineage_consensus(spark, sf):
    r = S.bind(headers(spark, sf), ranks=N.ranks(N.taxonomy_of("header", "database"))).select("doc_id", "ranks")
    return L.rank_consensus(r.where(F.size("ranks") > 0), "doc_id", "ranks", 0.51)


FIELDS_SQL = """fl AS (SELECT doc_id, idx, list_filter(list_transform(CASE
  WHEN regexp_matches(header, '^\\S+\\s') AND contains(regexp_replace(header, '^\\S+\\s+', ''), ';') THEN string_split(regexp_replace(header, '^\\S+\\s+', ''), ';')
  WHEN contains(header, '|') THEN CASE WHEN contains(header, ';') THEN string_split(list_filter(string_split(header, '|'), lambda p: contains(p, ';'))[1], ';')
    ELSE string_split(header, '|')[4:] END ELSE [] END,
  lambda x: lower(trim(regexp_replace(regexp_replace(trim(x), '^[a-z]__', ''), '[^A-Za-z ]+', ' ', 'g')))),
  lambda x: x <> '' AND x NOT IN ('incertae sedis', 'unclassified')) AS f FROM headers)"""


@query("dominant_lineage_depth", "GRF-09",
       f"""WITH {HEADERS}, {FIELDS_SQL}, c AS (SELECT doc_id, f, count(*) AS k FROM fl WHERE len(f) > 0 GROUP BY ALL),
d AS (SELECT doc_id, f AS dom FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, array_to_string(f, ';')) AS rn FROM c) WHERE rn = 1),
m AS (SELECT doc_id, idx, dom, f, list_position([f[i] <> dom[i] FOR i IN range(1, least(len(f), len(dom)) + 1)], true) AS p FROM fl JOIN d USING (doc_id))
SELECT doc_id, idx, array_to_string(dom, ';') AS dominant, CASE WHEN p > 0 THEN p - 1 ELSE least(len(f), len(dom)) END AS depth FROM m""")
def dominant_lineage_depth(spark, sf):
    f = S.bind(headers(spark, sf), f=N.lineage_fields("header")).select("doc_id", "idx", "f")
    dom = L.dominant_lineage(f, "doc_id", "f")
    return f.join(dom, "doc_id").select("doc_id", "idx", F.concat_ws(";", "dominant").alias("dominant"),
                                        N.common_depth("f", "dominant").cast("long").alias("depth"))


@query("taxonomy_nodes", "SNK-05",
       f"""WITH {HEADERS}, {LIN_SQL}, {RANKS_SQL},
p AS (SELECT DISTINCT array_to_string(ranks[:i], ';') AS path, i AS depth FROM (SELECT ranks, unnest(range(1, len(ranks) + 1)) AS i FROM ranked))
SELECT path, depth, CASE WHEN depth > 1 THEN regexp_replace(path, ';[^;]*$', '') END AS parent, regexp_extract(path, '[^;]*$') AS name FROM p""")
def taxonomy_nodes(spark, sf):
    r = S.bind(headers(spark, sf), ranks=N.ranks(N.taxonomy_of("header", "database"))).select("ranks")
    return L.path_nodes(r, "ranks").select("path", F.col("depth").cast("long").alias("depth"), "parent", "name")
