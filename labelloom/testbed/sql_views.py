"""The same views as SQL, written from their definitions and not from the Spark code."""

from labelloom.testbed.views import TYPE_LETTERS

# pairs of article and label
ANNOTATIONS = """
ann AS (SELECT DISTINCT l_orderkey AS pmid, 'D'||p_type||'_'||p_brand AS label, 'T'||p_type AS parent,
               l_linestatus='F' AS gold,
               (l_returnflag='R' OR (l_returnflag='A' AND l_linenumber%2=1)) AS weak
        FROM lineitem JOIN part ON l_partkey=p_partkey),
golden AS (SELECT DISTINCT pmid, label, parent FROM ann WHERE gold),
weak0 AS (SELECT DISTINCT pmid, label, parent FROM ann WHERE weak),
valid_parent AS (SELECT DISTINCT pmid, parent FROM golden),
weak AS (SELECT weak0.* FROM weak0 SEMI JOIN valid_parent USING (pmid, parent)),
lab AS (SELECT DISTINCT 'D'||p_type||'_'||p_brand AS label, 'T'||p_type AS parent FROM part),
valid AS (SELECT pmid, label FROM valid_parent JOIN lab USING (parent)),
occ AS (SELECT l_orderkey AS pmid, 'CD'||p_type||'_'||p_brand AS cui, l_linenumber AS entity_id
        FROM lineitem JOIN part ON l_partkey=p_partkey
        WHERE l_returnflag='R' OR (l_returnflag='A' AND l_linenumber%2=1)),
cross_walk AS (SELECT 'C'||label AS cui, label AS source_code, 'MAIN' AS source FROM lab WHERE NOT ends_with(label, '#7')
          UNION ALL SELECT 'D'||label, label, 'MAIN' FROM lab WHERE NOT ends_with(label, '#7')
          UNION ALL SELECT 'A'||label, label, 'OTHER' FROM lab WHERE NOT ends_with(label, '#7'))
"""

# per-label confusion counts from an explicit article x label table
FREQUENCIES = ANNOTATIONS + """,
grid AS (SELECT d.pmid, l.label, l.parent FROM (SELECT DISTINCT l_orderkey AS pmid FROM lineitem) d CROSS JOIN lab l),
marked AS (SELECT grid.pmid, grid.label,
                  v.pmid IS NOT NULL AS is_valid, g.pmid IS NOT NULL AS is_gold, w.pmid IS NOT NULL AS is_weak
           FROM grid LEFT JOIN valid_parent v ON v.pmid=grid.pmid AND v.parent=grid.parent
                     LEFT JOIN golden g ON g.pmid=grid.pmid AND g.label=grid.label
                     LEFT JOIN weak w ON w.pmid=grid.pmid AND w.label=grid.label),
freq AS (SELECT label, count(*) FILTER (is_weak) AS total_weak,
                count(*) FILTER (is_weak AND NOT is_gold) AS fp,
                count(*) FILTER (is_gold AND NOT is_weak) AS fn,
                count(*) FILTER (is_gold) AS total_gold,
                count(*) FILTER (is_valid AND NOT is_gold AND NOT is_weak) AS tn
         FROM marked GROUP BY label),
ratios AS (SELECT *, 1 - fp_ratio AS precision, 1 - fn_ratio AS recall,
                  total_weak - fp AS tp
           FROM (SELECT *, fp::DOUBLE/nullif(total_weak,0) AS fp_ratio, fn::DOUBLE/nullif(total_gold,0) AS fn_ratio FROM freq))
"""

H = "('0x'||substr(md5({}),1,8))::BIGINT"


def draw(text: str) -> str:
    return "(" + H.format(text) + "/4294967296::DOUBLE)"


DATASET = ANNOTATIONS + f""",
nwl0 AS (SELECT valid.label, valid.pmid, CASE WHEN g.pmid IS NULL THEN 0 ELSE 1 END AS target
         FROM valid ANTI JOIN weak0 USING (pmid, label) LEFT JOIN golden g ON g.pmid=valid.pmid AND g.label=valid.label),
nwl AS (SELECT *, CASE WHEN r <= 0.2::DOUBLE THEN 'test' WHEN r <= 0.4::DOUBLE THEN 'dev' ELSE 'train' END AS split
        FROM (SELECT *, {draw("'10|'||pmid")} AS r FROM nwl0)),
scored AS (SELECT *, 0.6::DOUBLE*{draw("'p|'||pmid||label")} + 0.4::DOUBLE*target AS prob FROM nwl),
base AS (SELECT valid.pmid, valid.label, CASE WHEN g.pmid IS NULL THEN 0 ELSE 1 END AS gold, m.base,
                CASE m.base WHEN 'weak' THEN (CASE WHEN w.pmid IS NULL THEN 0 ELSE 1 END)
                            ELSE (CASE WHEN {draw("'b|'||valid.pmid||valid.label")} > 0.8::DOUBLE THEN 1 ELSE 0 END) END AS pred
         FROM valid LEFT JOIN golden g ON g.pmid=valid.pmid AND g.label=valid.label
                    LEFT JOIN weak0 w ON w.pmid=valid.pmid AND w.label=valid.label
                    CROSS JOIN (VALUES ('weak'), ('draw')) m(base))
"""

ARTICLES = """
article AS (SELECT doc_id AS pmid, split_part(text, chr(10), 1) AS title,
                   substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract_text,
                   o_orderdate::DATE AS date_completed, year(o_orderdate)::VARCHAR AS year, lang
            FROM documents JOIN orders ON doc_id=o_orderkey),
words AS (SELECT DISTINCT doc_id AS pmid,
                 unnest(string_split_regex(lower(text), '[^a-zàâçéèêëîïôöûùüÿñæœß]+')) AS cui FROM documents),
concept(cui, lang) AS (VALUES ('the','en'),('and','en'),('une','fr'),('les','fr'),('und','de'),('der','de'),('que','es'),('los','es')),
text_weak AS (SELECT DISTINCT pmid, lang AS label FROM words JOIN concept USING (cui) WHERE lang IN (SELECT lang FROM documents)),
text_golden AS (SELECT doc_id AS pmid, lang AS label FROM documents),
langs AS (SELECT DISTINCT lang AS label FROM documents),
""" + f"""
text_rows AS (SELECT label, pmid, target,
                     CASE WHEN r <= 0.2::DOUBLE THEN 'test' WHEN r <= 0.4::DOUBLE THEN 'dev' ELSE 'train' END AS split
              FROM (SELECT l.label, d.doc_id AS pmid, CASE WHEN d.lang=l.label THEN 1 ELSE 0 END AS target,
                           {draw("'10|'||d.doc_id")} AS r
                    FROM documents d CROSS JOIN langs l)
              ANTI JOIN text_weak USING (pmid, label))
"""

_LETTERS = " ".join(f"WHEN '{t}' THEN '{x}01'" for t, x in TYPE_LETTERS.items())

THESAURUS = f"""
typ AS (SELECT DISTINCT p_type, CASE p_type {_LETTERS} END AS tnum FROM part),
raw AS (SELECT p_partkey AS k, p_name, p_brand, p_type, tnum, lpad(regexp_extract(p_brand,'[0-9]+'),3,'0') AS bnum,
               lpad(p_partkey::VARCHAR,9,'0') AS pnum, (1995+p_partkey%7)::INTEGER AS introduced,
               CASE WHEN p_partkey%5=2 AND p_partkey%3=2 THEN 'item '||p_partkey ELSE p_name||' '||p_partkey END AS name
        FROM part JOIN typ USING (p_type)),
rec AS (SELECT 'T'||p_type AS ui, p_type AS name, 1990 AS introduced, 1 AS n_concepts, NULL::BIGINT AS k, 'MT'||p_type AS concept FROM typ
        UNION ALL SELECT DISTINCT 'B'||bnum, p_brand, 1990, 1, NULL::BIGINT, 'MB'||bnum FROM raw
        UNION ALL SELECT 'P'||pnum, name, introduced, CASE WHEN k%5=0 THEN 2 ELSE 1 END, k, 'M'||k FROM raw),
pos AS (SELECT tnum AS tn, 'T'||p_type AS ui FROM typ
        UNION SELECT tnum||'.'||bnum, 'B'||bnum FROM raw
        UNION SELECT tnum||'.'||bnum||'.'||pnum, 'P'||pnum FROM raw),
anc AS (SELECT DISTINCT a.ui AS ancestor, d.ui AS descendant FROM pos a JOIN pos d ON starts_with(d.tn, a.tn||'.')),
par AS (SELECT DISTINCT c.ui AS label, p.ui AS parent FROM pos c JOIN pos p
        ON p.tn||'.' = left(c.tn, length(c.tn) - strpos(reverse(c.tn), '.') + 1) AND contains(c.tn, '.')),
leaf AS (SELECT ui FROM rec ANTI JOIN (SELECT DISTINCT ancestor AS ui FROM anc) USING (ui)),
added AS (SELECT rec.*, raw.p_brand, raw.p_type, raw.p_name, raw.bnum FROM rec JOIN raw ON 'P'||raw.pnum = rec.ui WHERE rec.introduced=1999),
term AS (SELECT name AS term, min(ui) AS term_ui FROM (SELECT name, ui FROM rec UNION ALL SELECT 'alias '||k, ui FROM rec WHERE k IS NOT NULL) GROUP BY name),
scr AS (SELECT 'S'||k AS scr_ui, p_name||' '||k AS term, (CASE WHEN k%3=0 THEN 'M' ELSE 'N' END)||k AS concept,
               p_brand, 'B'||bnum AS brand_ui, k FROM raw WHERE k%5=2),
old_host AS (SELECT a.ui, min(o.ui) AS host_ui, min_by(o.name, o.ui) AS host_name
             FROM added a JOIN rec o ON o.introduced<=1998 AND o.k%5=0 AND 'M'||(o.k+1) = a.concept GROUP BY a.ui),
found AS (SELECT ui, coalesce(by_concept, by_exception, by_name, by_note) AS scr_ui,
                 CASE WHEN by_concept IS NOT NULL THEN 'concept' WHEN by_exception IS NOT NULL THEN 'exception'
                      WHEN by_name IS NOT NULL THEN 'name' WHEN by_note IS NOT NULL THEN 'note' END AS found_by
          FROM (SELECT a.ui, (SELECT min(scr_ui) FROM scr s WHERE s.concept=a.concept) AS by_concept,
                       CASE WHEN a.k%5=2 AND a.k%11=3 THEN (SELECT min(scr_ui) FROM scr s WHERE s.k=a.k+5) END AS by_exception,
                       CASE WHEN a.k%5=2 THEN (SELECT min(scr_ui) FROM scr s WHERE s.term=a.name) END AS by_name,
                       CASE WHEN a.k%5=2 THEN (SELECT min(scr_ui) FROM scr s WHERE s.k=a.k) END AS by_note
                FROM added a)),
entry AS (SELECT k, p_brand AS name, (1996+k%3)::INTEGER AS year_to FROM raw WHERE k%5=3
          UNION ALL SELECT k, p_type, (1996+k%2)::INTEGER FROM raw WHERE k%5=3
          UNION ALL SELECT k, 'Gone '||k, NULL FROM raw WHERE k%5 IN (0,3)
          UNION ALL SELECT k, p_type, 1992 FROM raw WHERE k%5=3
          UNION ALL SELECT k, p_type, NULL FROM raw WHERE k%5=0),
newest AS (SELECT k, name, year_to FROM (SELECT *, max(year_to) OVER (PARTITION BY k) AS last FROM entry)
           WHERE last IS NULL OR year_to=last),
host AS (SELECT ui, '1' AS category, host_name, host_ui, 'NRW' AS relation FROM old_host
         UNION ALL
         SELECT f.ui, '2', s.p_brand, s.brand_ui, NULL FROM found f JOIN scr s USING (scr_ui) ANTI JOIN old_host USING (ui)
         UNION ALL
         SELECT f.ui, '2', 'Gone host', NULL, NULL FROM found f JOIN scr s USING (scr_ui) ANTI JOIN old_host USING (ui) WHERE s.k%4=0
         UNION ALL
         SELECT a.ui, '3', n.name, t.term_ui, NULL
         FROM added a JOIN newest n USING (k) LEFT JOIN term t ON t.term=n.name
         ANTI JOIN old_host USING (ui) ANTI JOIN (SELECT ui FROM found WHERE scr_ui IS NOT NULL) USING (ui)),
hosts AS (SELECT * FROM host UNION ALL SELECT ui, '4', NULL, NULL, NULL FROM added ANTI JOIN host USING (ui)),
types AS (SELECT h.ui, any_value(category) AS category, any_value(relation) AS relation, count(host_name) AS n_hosts,
                 (count(host_name)=0)::BIGINT AS emersion, greatest(count(host_name)-count(host_ui), 0) AS succession,
                 count(*) FILTER (is_parent) AS subdivision, count(*) FILTER (is_above AND NOT is_parent) AS submersion,
                 count(*) FILTER (is_below) AS overtopping,
                 count(*) FILTER (host_ui IS NOT NULL AND NOT is_parent AND NOT is_above AND NOT is_below) AS detachment
          FROM (SELECT hosts.*, EXISTS (SELECT 1 FROM par WHERE par.label=hosts.ui AND par.parent=hosts.host_ui) AS is_parent,
                       EXISTS (SELECT 1 FROM anc WHERE anc.ancestor=hosts.host_ui AND anc.descendant=hosts.ui) AS is_above,
                       EXISTS (SELECT 1 FROM anc WHERE anc.ancestor=hosts.ui AND anc.descendant=hosts.host_ui) AS is_below
                FROM hosts) h GROUP BY h.ui),
phex AS (SELECT DISTINCT h.ui, m.member FROM hosts h JOIN (SELECT ancestor AS head, descendant AS member FROM anc
         UNION SELECT ui, ui FROM rec) m ON m.head=h.host_ui),
panno AS (SELECT l_orderkey AS pmid, 'P'||lpad(l_partkey::VARCHAR,9,'0') AS label FROM lineitem),
dated AS (SELECT pmid, label, o_orderdate::DATE AS date_completed FROM panno JOIN orders ON pmid=o_orderkey),
pocc AS (SELECT l_orderkey AS pmid, 'CP'||lpad(l_partkey::VARCHAR,9,'0') AS cui FROM lineitem
         WHERE l_returnflag='R' OR (l_returnflag='A' AND l_linenumber%2=1)),
pcui AS (SELECT ui AS label, CASE WHEN k%3<>0 THEN 'C'||ui END AS cui FROM rec WHERE k IS NOT NULL)
"""
