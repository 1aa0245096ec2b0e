"""Queries over the name index: terms, matches, ranking, decisions, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.text import normalize_name
from veriframe.operators import fuzzy, resolve, retrieval
from veriframe.plans.adapters import ADAPTERS, adapter, ctes
from veriframe.plans.registry import query
from veriframe.plans.text_queries import NAMES_CTES, drop_filler_sql, fold_sql, translit_sql
from veriframe.session import cut_lineage
from veriframe.sources.tables import read_table

_STOPS = "'имени', 'им', 'атындагы', 'of', 'the', 'named', 'after'"
TERM_CTES = NAMES_CTES + f""",
cutwords AS (
  SELECT text, list_filter(CASE WHEN len(list_filter(string_split(folded, ' '), lambda w: w IN ({_STOPS}))) = 0 THEN string_split(folded, ' ')
    ELSE string_split(folded, ' ')[1:list_position(list_transform(string_split(folded, ' '), lambda w: w IN ({_STOPS})), true) - 1] END,
    lambda w: length(w) > 1) AS w FROM normed),
inits AS (SELECT text, w, array_to_string(list_transform(w, lambda x: x[1]), '') AS i FROM cutwords),
made AS (
  SELECT text, i AS acronym FROM inits WHERE length(i) BETWEEN 3 AND 6
  UNION SELECT text, left(w[1], 3) || i[2:] FROM inits WHERE len(w) >= 2 AND left(w[1], 3) IN ('каз', 'kaz')
    AND length(left(w[1], 3) || i[2:]) BETWEEN 4 AND 8),
terms AS (
  SELECT qid, text, kind FROM raw_names
  UNION SELECT r.qid, m.acronym, 'generated' FROM raw_names r JOIN made m USING (text) WHERE r.kind = 'label'),
term_norms AS (
  SELECT text, {drop_filler_sql('folded')} AS name FROM (SELECT text, {fold_sql('text')} AS folded FROM (SELECT DISTINCT text FROM terms))),
nterms AS (SELECT DISTINCT qid, name, kind FROM terms JOIN term_norms USING (text) WHERE name <> ''),
name_queries AS ({ADAPTERS['name_queries']}),
qtexts AS (SELECT query, {drop_filler_sql('f')} AS norm FROM (SELECT query, {fold_sql('query')} AS f FROM (SELECT DISTINCT query FROM name_queries))),
qids AS (SELECT q.query_id, t.norm FROM name_queries q JOIN qtexts t USING (query)),
norms AS (SELECT DISTINCT norm FROM qtexts),
others AS (SELECT norm, {drop_filler_sql('f')} AS variant FROM (SELECT norm, {fold_sql('t')} AS f FROM (SELECT norm, {translit_sql('norm')} AS t FROM norms))),
variants AS (SELECT norm, norm AS variant FROM norms WHERE norm <> '' UNION SELECT norm, variant FROM others WHERE variant <> '')
"""

SAME = """(starts_with(n, w) OR (length(n) >= 6 AND starts_with(w, n)) OR (length(w) >= 7 AND length(n) >= 7 AND left(w, 7) = left(n, 7)))"""
# The distance functions of the checking SQL count bytes, so Cyrillic letters become single ASCII signs first.
_SHORT = """translate({}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()')"""
POOL_CTES = TERM_CTES + f""",
fw AS (
  SELECT qid, CASE kind WHEN 'label' THEN 'names' WHEN 'alias' THEN 'aliases' ELSE 'acronyms' END AS field, unnest(string_split(f, ' ')) AS word
  FROM terms JOIN (SELECT text, {fold_sql('text')} AS f FROM (SELECT DISTINCT text FROM terms)) USING (text)),
tfs AS (SELECT qid, field, word, count(*) AS tf FROM fw WHERE word <> '' GROUP BY ALL),
flens AS (SELECT qid, field, count(*) AS len FROM tfs GROUP BY ALL),
favgs AS (SELECT field, sum(len)::DOUBLE / (SELECT count(*) FROM index_entries) AS mean FROM flens GROUP BY field),
holding AS (SELECT field, word, count(*) AS h, (SELECT count(*) FROM index_entries) AS n FROM tfs GROUP BY ALL),
vals AS (
  SELECT word AS found, qid, sum(CASE field WHEN 'names' THEN 2.0::DOUBLE WHEN 'acronyms' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
    * (1 + 0.25::DOUBLE * log10(1 + coalesce(sitelinks, 0))) * ln(1 + (n - h + 0.5::DOUBLE) / (h + 0.5::DOUBLE))
    * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * len / mean)))) AS value
  FROM tfs JOIN flens USING (qid, field) JOIN favgs USING (field) JOIN holding USING (field, word) JOIN index_entries USING (qid) GROUP BY ALL),
qw AS (SELECT DISTINCT variant, len(list_distinct(string_split(variant, ' '))) AS total, unnest(list_distinct(string_split(variant, ' '))) AS word FROM variants),
ww AS (
  SELECT * FROM (
    SELECT word, found, CASE WHEN word = found THEN 1.0::DOUBLE
      WHEN length(word) >= 4 AND starts_with(found, word) THEN 0.375::DOUBLE * length(found) / (length(found) + 0.3::DOUBLE * (length(found) - length(word)))
      WHEN length(word) >= 5 AND d <= least(6, floor(length(word) * 0.2 + 0.5)) THEN 0.45::DOUBLE * length(found) / (length(found) + d) END AS weight
    FROM (SELECT word, found, levenshtein({_SHORT.format('word')}, {_SHORT.format('found')}) AS d
      FROM (SELECT DISTINCT word FROM qw) CROSS JOIN (SELECT DISTINCT found FROM vals))) WHERE weight IS NOT NULL),
ws AS (SELECT word, qid, sum(weight * value) AS s FROM ww JOIN vals USING (found) GROUP BY ALL),
vq AS (SELECT variant, total, qid, sum(s) AS s, count(*) AS n FROM qw JOIN ws USING (word) GROUP BY ALL),
vk AS (SELECT * FROM (SELECT *, max(n = total) OVER (PARTITION BY variant) AS has_all FROM vq) WHERE NOT has_all OR n = total),
hits AS (SELECT v.norm, k.qid, max(round(k.s * k.n, 6)) AS score FROM variants v JOIN vk k USING (variant) GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, qid) AS rank FROM hits) WHERE rank <= 12)
"""
MATCH_CTES = POOL_CTES + f""",
stubs AS (SELECT qid, sitelinks, coalesce(sitelinks, 0) = 0 AND commons_category IS NULL AND media_sitelink IS NULL AND lat IS NULL AS stub
  FROM index_entries),
asked AS (SELECT p.norm, p.qid, v.variant, t.name, t.kind, string_split(v.variant, ' ') AS vw, string_split(t.name, ' ') AS nw
  FROM pool p JOIN variants v USING (norm) JOIN nterms t USING (qid)),
matches AS (
  SELECT norm, qid, variant, name, kind, CASE WHEN variant = name THEN 3
    WHEN starts_with(name, variant || ' ') OR starts_with(variant, name || ' ') THEN 2
    WHEN len(list_filter(vw, lambda w: length(w) >= 2 AND len(list_filter(nw, lambda n: {SAME})) > 0)) = len(vw) THEN 1 ELSE 0 END AS level
  FROM asked),
rated_names AS (
  SELECT *, (CASE level WHEN 3 THEN CASE kind WHEN 'label' THEN 1.0 WHEN 'alias' THEN 0.95 ELSE 0.9 END
    WHEN 2 THEN 0.75 WHEN 1 THEN 0.6 ELSE 0.4 END)::DOUBLE AS match FROM matches),
quality AS (SELECT norm, qid, max(match) AS match FROM rated_names GROUP BY ALL HAVING max(match) >= 0.6),
scored AS (
  SELECT q.*, e.stub, 0.7::DOUBLE * match + (0.3::DOUBLE * least(1.0::DOUBLE, log10(coalesce(e.sitelinks, 0) + 1) / log10(151.0::DOUBLE))
    - CASE WHEN e.stub THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM quality q JOIN stubs e USING (qid)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY round(score, 9) DESC, qid) AS rank FROM scored),
decided AS (
  SELECT n.norm, CASE WHEN a.qid IS NULL THEN 'not_found' WHEN a.stub AND a.match < 0.95 THEN 'ambiguous'
    WHEN b.qid IS NULL OR a.score - b.score >= 0.1 THEN 'resolved'
    WHEN a.match >= 0.95 AND b.match < 0.95 AND NOT a.stub THEN 'resolved' ELSE 'ambiguous' END AS status, a.qid
  FROM norms n LEFT JOIN ranked a ON a.norm = n.norm AND a.rank = 1 LEFT JOIN ranked b ON b.norm = n.norm AND b.rank = 2)
"""


def inputs(spark, sf_dir):
    return adapter(spark, sf_dir, "name_queries"), adapter(spark, sf_dir, "index_entries")


def texts(spark, sf_dir, generated=True):
    """Normalized query variants and index terms, written once because several joins read them."""
    queries, index = inputs(spark, sf_dir)
    _, variants = resolve.normalized_queries(queries)
    names = resolve.index_terms(index) if generated else resolve.name_rows(index)
    return cut_lineage(variants), cut_lineage(resolve.normalized_terms(names))


def pooled(spark, sf_dir):
    """(pool, variants, normalized terms, index) of all name queries."""
    queries, index = inputs(spark, sf_dir)
    variants, raw = cut_lineage(resolve.normalized_queries(queries)[1]), cut_lineage(resolve.index_terms(index))
    return cut_lineage(retrieval.search(variants, raw, index)), variants, cut_lineage(resolve.normalized_terms(raw)), index


@query("acronyms", TERM_CTES + "SELECT DISTINCT r.text AS name, m.acronym FROM raw_names r JOIN made m USING (text) WHERE r.kind = 'label'")
def acronyms(spark, sf_dir):
    labels = resolve.name_rows(adapter(spark, sf_dir, "index_entries")).filter("kind = 'label'").select(
        F.col("text").alias("name")).distinct()
    return labels.select("name", F.explode(resolve.acronyms(F.col("name"))).alias("acronym")).distinct()


@query("index_terms", TERM_CTES + "SELECT DISTINCT qid, text, kind FROM terms")
def index_terms(spark, sf_dir):
    return resolve.index_terms(adapter(spark, sf_dir, "index_entries"))


@query("query_variants", TERM_CTES + "SELECT norm, variant FROM variants")
def query_variants(spark, sf_dir):
    return resolve.normalized_queries(adapter(spark, sf_dir, "name_queries"))[1]


@query("resolve_pairs", MATCH_CTES + "SELECT DISTINCT variant, name, CAST(level AS BIGINT) AS level FROM matches WHERE level > 0")
def resolve_pairs(spark, sf_dir):
    pool, variants, terms, _ = pooled(spark, sf_dir)
    found = resolve.pool_matches(pool, variants, terms).where("level > 0")
    return found.select("variant", "name", F.col("level").cast("bigint").alias("level")).distinct()


@query("match_quality", MATCH_CTES + """
SELECT norm, name, kind, CAST(round(100 * max(match)) AS BIGINT) AS match_percent FROM rated_names GROUP BY ALL""")
def match_quality(spark, sf_dir):
    pool, variants, terms, _ = pooled(spark, sf_dir)
    quality = resolve.match_quality(F.col("level"), F.col("kind"))
    return resolve.pool_matches(pool, variants, terms).groupBy("norm", "name", "kind").agg(
        F.round(100 * F.max(quality)).cast("bigint").alias("match_percent"))


@query("is_stub", ctes("index_entries") + """
SELECT qid, coalesce(sitelinks, 0) = 0 AND commons_category IS NULL AND media_sitelink IS NULL AND lat IS NULL AS stub FROM index_entries""")
def is_stub(spark, sf_dir):
    return adapter(spark, sf_dir, "index_entries").select("qid", resolve.is_stub().alias("stub"))


@query("resolve_rank", MATCH_CTES + """
SELECT norm, qid, rank, CAST(round(score * 10000) AS BIGINT) AS score FROM ranked WHERE rank <= 12""")
def resolve_rank(spark, sf_dir):
    queries, index = inputs(spark, sf_dir)
    _, ranked, _ = resolve.resolve(queries, index)
    return ranked.select("norm", "qid", "rank", F.round(F.col("score") * 10000).cast("bigint").alias("score"))


@query("resolve_decide", MATCH_CTES + """
SELECT query_id, status, CASE WHEN status = 'resolved' THEN qid END AS qid FROM qids JOIN decided USING (norm)""")
def resolve_decide(spark, sf_dir):
    queries, index = inputs(spark, sf_dir)
    ids, _, decided = resolve.resolve(queries, index)
    return ids.join(decided, "norm").select("query_id", "status", "qid")


@query("resolve_cards", MATCH_CTES + """
SELECT r.norm, r.rank, r.qid, coalesce(name_ru, name_en, name_kk, r.qid) AS name, city_name, country, inception
FROM ranked r JOIN index_entries e USING (qid) JOIN decided d ON d.norm = r.norm WHERE rank <= 6 AND status = 'ambiguous'""")
def resolve_cards(spark, sf_dir):
    queries, index = inputs(spark, sf_dir)
    _, ranked, decided = resolve.resolve(queries, index)
    open_ranked = ranked.join(decided.filter("status = 'ambiguous'").select("norm"), "norm", "left_semi")
    return resolve.candidate_cards(open_ranked, index)


@query("search_and_or", POOL_CTES + "SELECT norm, qid, rank, CAST(round(score * 10000) AS BIGINT) AS score FROM pool")
def search_and_or(spark, sf_dir):
    pool = pooled(spark, sf_dir)[0]
    return pool.select("norm", "qid", "rank", F.round(F.col("score") * 10000).cast("bigint").alias("score"))


# --- fuzzy ------------------------------------------------------------------------------
# The checking SQL compares all pairs. Its own distance, which may also edit between two swapped letters, is never above ours:
# it leaves out pairs that can't be close; the others, and all pairs of words, get the distance by rows of lists.


def _codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"


def _osa(a: str, b: str) -> str:
    """Edit distance with adjacent swaps: the state is the last two rows, the letter before and the letters of ``b``."""
    cell = """least(s[2][e[1] + 1] + 1, r[e[1]] + 1, s[2][e[1]] + (x[1][1] <> s[4][e[1]])::BIGINT,
        CASE WHEN e[1] > 1 AND x[1][1] = s[4][e[1] - 1] AND s[3][1] = s[4][e[1]] THEN s[1][e[1] - 1] + 1 ELSE 9999 END)"""
    row = f"list_reduce(list_transform(range(1, len(s[4]) + 1), lambda j: [j]), lambda r, e: list_append(r, {cell}), [s[2][1] + 1])"
    start = f"[range(0, length({b}) + 1), range(0, length({b}) + 1), [-1], {_codes(b)}]"
    return f"list_reduce(list_transform({_codes(a)}, lambda ch: [[ch]]), lambda s, x: [s[2], {row}, x[1], s[4]], {start})[2][-1]"


_FILLERS = " OR ".join(f"damerau_levenshtein({_SHORT.format('w')}, {_SHORT.format(repr(f))}) <= 2" for f in fuzzy.FILLER_LIKE)


def _bound(a: str, b: str) -> str:
    return f"(1 - damerau_levenshtein({_SHORT.format(a)}, {_SHORT.format(b)}) / greatest(length({a}), length({b}))::DOUBLE)"


def _fuzzy_ctes(variants: str, names: str) -> str:
    """Common table ``close`` (variant, name, similarity) over all pairs of the two given selections."""
    def words(column: str, source: str) -> str:
        return f"""SELECT {column}, array_to_string(ws, ' ') AS whole, ws FROM (
          SELECT {column}, CASE WHEN len(kept) > 0 THEN kept ELSE ws END AS ws FROM (
            SELECT {column}, ws, list_filter(ws, lambda w: NOT (length(w) >= 5 AND ({_FILLERS}))) AS kept
            FROM (SELECT {column}, string_split({column}, ' ') AS ws FROM ({source}))))"""

    return f""",
fv AS ({words("variant", variants)}), fn AS ({words("name", names)}),
vlong AS (SELECT variant, i, ws[i] AS a FROM (SELECT variant, ws, unnest(range(1, len(ws) + 1)) AS i FROM fv) WHERE length(ws[i]) >= 3),
nword AS (SELECT DISTINCT name, unnest(ws) AS b FROM fn),
wtable AS (SELECT a, b, 1 - {_osa("a", "b")} / greatest(length(a), length(b))::DOUBLE AS s
  FROM (SELECT DISTINCT a FROM vlong) CROSS JOIN (SELECT DISTINCT b FROM nword)),
best AS (SELECT variant, i, name, max(s) AS s FROM vlong JOIN wtable USING (a) JOIN nword USING (b) GROUP BY ALL),
wholes AS (
  SELECT variant, name, 1 - {_osa("a", "b")} / greatest(length(a), length(b))::DOUBLE AS s
  FROM (SELECT variant, v.whole AS a, name, n.whole AS b FROM fv v CROSS JOIN fn n WHERE {_bound("v.whole", "n.whole")} >= 0.75)),
close AS (
  SELECT variant, name, round(max(s), 9) AS similarity FROM (
    SELECT variant, name, s FROM wholes UNION ALL SELECT variant, name, avg(s) FROM best GROUP BY variant, name)
  GROUP BY variant, name HAVING round(max(s), 9) >= 0.75)"""


@query("osa_similarity", f"""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS b FROM part),
typed AS (
  SELECT substring(b, 2, 1) || substring(b, 1, 1) || substring(b, 3) AS a FROM w
  UNION SELECT substring(b, 1, 2) || substring(b, 4) FROM w UNION SELECT b || right(b, 1) FROM w
  UNION SELECT substring(b, 1, length(b) // 2 - 1) || substring(b, length(b) // 2 + 1, 1) || substring(b, length(b) // 2, 1)
    || substring(b, length(b) // 2 + 2) FROM w)
SELECT * FROM (SELECT a, b, {_osa("a", "b")} AS distance FROM typed CROSS JOIN w)
WHERE 1 - distance / greatest(length(a), length(b))::DOUBLE >= 0.75""")
def osa_similarity(spark, sf_dir):
    """Words with a swap at the start, a letter left out, one doubled, a swap in the middle, and the words they are close to."""
    words = read_table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    half = F.floor(F.length("b") / 2).cast("int")
    part = lambda at, n=None: F.substring(F.col("b"), at, F.length("b") if n is None else n)
    one = F.lit(1)
    typed = F.array(
        F.concat(part(F.lit(2), one), part(one, one), part(F.lit(3))), F.concat(part(one, F.lit(2)), part(F.lit(4))),
        F.concat(F.col("b"), F.right("b", one)),
        F.concat(part(one, half - 1), part(half + 1, one), part(half, one), part(half + 2)))
    return fuzzy.near_texts(words.select(F.explode(typed).alias("a")), words)


@query("fuzzy_rank", TERM_CTES + _fuzzy_ctes("SELECT DISTINCT variant FROM variants", "SELECT DISTINCT name FROM nterms WHERE kind <> 'generated'") + """
SELECT variant, name, CAST(round(similarity * 10000) AS BIGINT) AS similarity FROM close""")
def fuzzy_rank(spark, sf_dir):
    variants, terms = texts(spark, sf_dir, generated=False)
    found = fuzzy.fuzzy_matches(variants, terms)
    return found.select("variant", "name", F.round(F.col("similarity") * 10000).cast("bigint").alias("similarity"))


@query("resolve_suggest", MATCH_CTES + ", open AS (SELECT v.* FROM variants v JOIN decided USING (norm) WHERE status = 'not_found')"
       + _fuzzy_ctes("SELECT DISTINCT variant FROM open", "SELECT DISTINCT name FROM nterms") + """,
named AS (
  SELECT norm, qid, 0 AS src, -max(similarity) AS key, sitelinks FROM open JOIN close USING (variant)
  JOIN (SELECT DISTINCT name, qid FROM nterms) USING (name) JOIN index_entries USING (qid) GROUP BY ALL),
local AS (
  SELECT norm, qid, 1 AS src, 0.0 AS key, sitelinks FROM open
  JOIN index_entries ON variant = lower(replace(city_name, 'City ', 'zz'))),
first AS (
  SELECT *, row_number() OVER (PARTITION BY norm, qid ORDER BY src, key) AS r FROM (SELECT * FROM named UNION ALL SELECT * FROM local)),
placed AS (
  SELECT norm, qid, src, row_number() OVER (PARTITION BY norm ORDER BY src, key, sitelinks DESC NULLS LAST, qid) AS place
  FROM first WHERE r = 1)
SELECT norm, qid, place, src FROM placed WHERE place <= 6""")
def resolve_suggest(spark, sf_dir):
    pool, variants, terms, index = pooled(spark, sf_dir)
    decided = resolve.decide(resolve.rank_candidates(pool, variants, terms, index), variants)
    open_variants = cut_lineage(variants.join(decided.filter("status = 'not_found'").select("norm"), "norm", "left_semi"))
    located = index.withColumn("place_id", F.col("city_name"))
    places = located.select("city_name").distinct().select(
        normalize_name(F.regexp_replace("city_name", "City ", "zz")).alias("place_name"), F.col("city_name").alias("place_id"))
    return fuzzy.suggestions(open_variants, terms.select("qid", "name").distinct(), located, places)
