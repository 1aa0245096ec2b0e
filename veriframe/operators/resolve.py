"""Name queries to entities: terms, blocking, match quality, ranking, decision.

Retrieval works on *distinct* words and texts: a query typed a billion times is looked up once, and names are compared
inside its pool only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import fold_text, let, normalize_name, query_variants
from veriframe.operators.ranking import top_k
from veriframe.operators.retrieval import search
from veriframe.session import cut_lineage, stored

# --- fixed values ---------------------------------------------------------------
ACRONYM_STOPS = ["имени", "им", "атындагы", "of", "the", "named", "after"]
SYLLABLE_HEADS = ["каз", "kaz"]
TERM_QUALITY = {"label": 1.0, "alias": 0.95, "generated": 0.9}


# --- terms -----------------------------------------------------------------------


def name_rows(index: DataFrame) -> DataFrame:
    """Labels and aliases of index entries in long form (qid, text, kind)."""
    def entry(column: str, kind: str) -> Column:
        return F.struct(F.col(column).alias("text"), F.lit(kind).alias("kind"))

    labels = F.array(*[entry(c, "label") for c in ("name_en", "name_ru", "name_kk")])
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(
        a.alias("text"), F.lit("alias").alias("kind")))
    return index.select("qid", F.inline(F.concat(labels, aliases))).filter("text <> ''")


def acronyms(name: Column) -> Column:
    """Initials of the words before a stop word, plus the variant with a whole first syllable."""
    def before_stop(words: Column) -> Column:
        stops = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ACRONYM_STOPS), i)), lambda i: i.isNotNull())
        return F.slice(words, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(words)))

    def build(kept: Column, initials: Column) -> Column:
        first = F.coalesce(F.get(kept, F.lit(0)), F.lit(""))
        syllable = F.lit(None).cast("string")
        for start in SYLLABLE_HEADS:
            syllable = F.when(first.startswith(start), F.lit(start)).otherwise(syllable)
        syllabic = F.when(F.size(kept) >= 2, F.concat(syllable, F.substring(initials, 2, 1000)))
        return let(syllabic, lambda y: F.array_compact(F.array(
            F.when(F.length(initials).between(3, 6), initials), F.when(F.length(y).between(4, 8), y))))

    kept_words = F.filter(let(F.split(fold_text(name), " "), before_stop), lambda w: F.length(w) > 1)
    initials_of = lambda kept: F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), "")
    return let(kept_words, lambda kept: let(initials_of(kept), lambda i: build(kept, i)))


def index_terms(index: DataFrame) -> DataFrame:
    """Labels, aliases and generated acronyms (qid, text, kind), distinct."""
    names = name_rows(index)
    # Names repeat across entries: acronyms are made once per distinct label, and stored, since a filter on them would else
    # go below the distinct and make them for every row. The same holds for normalized texts below.
    labels = names.filter(F.col("kind") == "label").select("text").distinct()
    made = stored(labels.select("text", acronyms(F.col("text")).alias("made")), "acronyms").select("text", F.explode("made").alias("acronym"))
    generated = names.filter(F.col("kind") == "label").join(made, "text").select(
        "qid", F.col("acronym").alias("text"), F.lit("generated").alias("kind")
    )
    return names.unionByName(generated).distinct()


def normalized_terms(terms: DataFrame) -> DataFrame:
    """(qid, name, kind) with normalized names; the normalization runs once per distinct text."""
    texts = stored(terms.select("text").distinct().select("text", normalize_name(F.col("text")).alias("name")), "names")
    return terms.join(texts, "text").filter("name <> ''").select("qid", "name", "kind").distinct()


def normalized_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id -> norm, norm -> variant): equal queries collapse into one normalized text."""
    texts = stored(queries.select("query").distinct().select(
        "query", normalize_name(F.substring(F.trim("query"), 1, 120)).alias("norm")
    ), "norms")
    ids = queries.join(texts, "query").select("query_id", "norm")
    norms = texts.select("norm").distinct()
    return ids, norms.select("norm", F.explode(query_variants(F.col("norm"))).alias("variant"))


# --- match quality ------------------------------------------------------------------


def same_word(word: Column, name_word: Column) -> Column:
    """Prefix of the name word, extension of a long enough name word, or the same long stem."""
    return (
        name_word.startswith(word)
        | ((F.length(name_word) >= config.MIN_EXTENDED_WORD) & word.startswith(name_word))
        | ((F.length(word) >= config.STEM_PREFIX) & (F.length(name_word) >= config.STEM_PREFIX)
           & (F.substring(word, 1, config.STEM_PREFIX) == F.substring(name_word, 1, config.STEM_PREFIX)))
    )


def words_covered(variant: Column, name: Column) -> Column:
    words, names = F.split(variant, " "), F.split(name, " ")
    return F.forall(words, lambda w: (F.length(w) >= 2) & F.exists(names, lambda n: same_word(w, n)))


def match_level(variant: Column, name: Column) -> Column:
    """3 equal, 2 one starts the other, 1 all query words in the name, 0 a search hit only."""
    starts = name.startswith(F.concat(variant, F.lit(" "))) | variant.startswith(F.concat(name, F.lit(" ")))
    return F.when(variant == name, 3).when(starts, 2).when(words_covered(variant, name), 1).otherwise(0)


def pool_matches(pool: DataFrame, variants: DataFrame, terms: DataFrame) -> DataFrame:
    """(norm, qid, variant, name, kind, level) of the names of every query's retrieval pool.

    The pool bounds the work: a dozen entries a query, whatever words the names share.
    """
    rows = pool.select("norm", "qid").join(terms, "qid").join(variants, "norm")
    return rows.withColumn("level", match_level(F.col("variant"), F.col("name")))


def match_quality(level: Column, kind: Column) -> Column:
    exact = F.lit(0.4)
    for name, quality in TERM_QUALITY.items():
        exact = F.when(kind == name, quality).otherwise(exact)
    return F.when(level == 3, exact).when(level == 2, 0.75).when(level == 1, 0.6).otherwise(0.4)


# --- ranking and decision -------------------------------------------------------------


def popularity(sitelinks: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(sitelinks + 1) / F.log10(F.lit(151.0)))


def is_stub() -> Column:
    """No article, no media category by claim or sitelink, and no coordinates: an entry that nothing documents."""
    return (
        (F.coalesce("sitelinks", F.lit(0)) == 0) & F.col("commons_category").isNull() & F.col("media_sitelink").isNull()
        & (F.col("lat").isNull() | F.col("lon").isNull())
    )


def static_score(index: DataFrame) -> DataFrame:
    """The part of the score that does not depend on the query."""
    links, stub = F.coalesce("sitelinks", F.lit(0)), is_stub()
    return index.select("qid", stub.alias("stub"), links.alias("sitelinks"),
                        (0.3 * popularity(links) - F.when(stub, 0.1).otherwise(0.0)).alias("base"))


def rank_candidates(pool: DataFrame, variants: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """The entries of each query's pool with match (at least 0.6), score and rank."""
    rated = pool_matches(pool, variants, terms).withColumn("match", match_quality(F.col("level"), F.col("kind")))
    best = rated.groupBy("norm", "qid").agg(F.max("match").alias("match")).filter(F.col("match") >= config.MIN_MATCH)
    scored = best.join(static_score(index), "qid").withColumn("score", 0.7 * F.col("match") + F.col("base"))
    return top_k(scored, ["norm"], [F.desc("score"), F.col("qid")], config.RETRIEVAL_POOL)


def decide(ranked: DataFrame, norms: DataFrame) -> DataFrame:
    """resolved / ambiguous / not_found per normalized query, from its first two candidates."""
    top = ranked.filter(F.col("rank") <= 2).groupBy("norm").agg(
        *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}")
          for r in (1, 2) for c in ("qid", "match", "score", "stub")]
    )
    exact = config.EXACT_MATCH
    status = (
        F.when(F.col("qid_1").isNull(), "not_found")
        .when(F.col("match_1") < config.MIN_MATCH, "ambiguous")
        .when(F.col("stub_1") & (F.col("match_1") < exact), "ambiguous")
        .when(F.col("qid_2").isNull() | (F.col("score_1") - F.col("score_2") >= config.MIN_LEAD), "resolved")
        .when((F.col("match_1") >= exact) & (F.col("match_2") < exact) & ~F.col("stub_1"), "resolved")
        .otherwise("ambiguous")
    )
    return norms.select("norm").distinct().join(top, "norm", "left").select(
        "norm", status.alias("status"), F.when(status == "resolved", F.col("qid_1")).alias("qid")
    )


def candidate_cards(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Display rows of the six best candidates per query."""
    cards = index.select(
        "qid", F.coalesce("name_ru", "name_en", "name_kk", "qid").alias("name"), "city_name", "country", "inception"
    )
    return ranked.filter(F.col("rank") <= config.CARDS_CAP).join(cards, "qid").select(
        "norm", "rank", "qid", "name", "city_name", "country", "inception"
    )


def resolve(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id -> norm, ranked candidates per norm, decision per norm)."""
    ids, variants = normalized_queries(queries)
    # All are read by several joins below: write them once instead of normalizing for each.
    ids, variants, raw = cut_lineage(ids), cut_lineage(variants), cut_lineage(index_terms(index))
    pool = search(variants, raw, index)
    ranked = cut_lineage(rank_candidates(pool, variants, normalized_terms(raw), index))
    return ids, ranked, decide(ranked, ids)
