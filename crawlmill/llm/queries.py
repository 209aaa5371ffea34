"""Queries of the llm operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlmill.llm import encoding, language, main_content, neighbours, packing, residue, signs, site_lines, tokens
from crawlmill.session import cut
from crawlmill.sources.tables import table

PAIR_SIMILARITY = 0.85
#: As many lists are searched as find this share of the ten most similar; none is pruned.
SEARCH = neighbours.KnnSettings(probes=32, prune=9.0, degree=48, recall=0.99)


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages")


def _lines(spark: SparkSession, root: str, sketch: bool = True) -> DataFrame:
    return cut(signs.line_signs(_pages(spark, root), table(spark, root, "lang_samples"), sketch))


def _sound(rows: DataFrame, lines: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return residue.without_residue(rows, residue.residue_pages(lines, table(spark, root, "crawler_queue")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    # neighbours below the wanted similarity need not leave the lists; 0.849 leaves room for rounding
    settings = neighbours.KnnSettings(min_similarity=PAIR_SIMILARITY - 0.001)
    found = neighbours.neighbours(neighbours.usable_vectors(_pages(spark, root)), settings)
    return neighbours.similar_pairs(found, PAIR_SIMILARITY)


def p2_search(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar vectors of every page whose id is divisible by 20, against all pages."""
    return neighbours.neighbours(neighbours.usable_vectors(_pages(spark, root)), SEARCH, "id % 20 = 0")


def p3_languages(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every page and of every line in another language."""
    pages = _pages(spark, root)
    profiles = language.fit_profiles(table(spark, root, "lang_samples"), pages)
    return language.label_languages(pages, profiles)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    faults = language.language_faults(_pages(spark, root), p3_languages(spark, root))
    return _sound(faults, _lines(spark, root, False), spark, root)


def p5_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Kinds and scores of the evidence against every page that p5_found gives."""
    return residue.evidence(_lines(spark, root, False), table(spark, root, "crawler_queue"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_evidence(spark, root).select("id").distinct()


def _sound_lines(lines: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return _sound(lines, lines, spark, root)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.repeated_lines(_sound_lines(_lines(spark, root), spark, root))


def p6_repeated(spark: SparkSession, root: str) -> DataFrame:
    """Lines repeated over their site as of p6_found, pages with residue counted and given too."""
    return site_lines.repeated_lines(_lines(spark, root))


def p6_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of like lines on ten documents of a site or more."""
    lines = _sound_lines(_lines(spark, root), spark, root)
    return site_lines.cluster_report(site_lines.clusters(lines), lines)


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    """Every summary without the lines repeated over its site, with changing names or not."""
    lines = _lines(spark, root)
    found = site_lines.clusters(_sound_lines(lines, spark, root))
    return site_lines.without_texts(_pages(spark, root), lines, found)


def p7_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Probability of every non-blank line to be furniture."""
    pages = _pages(spark, root)
    return main_content.label_blocks(pages, main_content.fit_labeller(pages, _lines(spark, root)))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    pages, lines = _pages(spark, root), _lines(spark, root)
    blocks = main_content.label_blocks(pages, main_content.fit_labeller(pages, lines))
    return _sound(blocks.where("furniture >= 0.5").select("id", "line_no"), lines, spark, root)


def p7_main(spark: SparkSession, root: str) -> DataFrame:
    """The main body of every page."""
    pages = _pages(spark, root)
    return main_content.main_text(pages, main_content.fit_labeller(pages, _lines(spark, root)))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_ids(table(spark, root, "documents"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container, place and length of every piece of every document."""
    return packing.pack(tokens.token_counts(table(spark, root, "documents")))


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and unused room of the packing."""
    return packing.fill(p9_containers(spark, root))


def p9_faults(spark: SparkSession, root: str) -> DataFrame:
    """Missing, doubled, overfull and overlapping pieces of the packing."""
    counts = cut(tokens.token_counts(table(spark, root, "documents")))
    return packing.faults(counts, cut(packing.pack(counts)))


def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    """Garbled documents with their text as far as it can be restored, and the chain that restores it."""
    dictionaries = encoding.fit_dictionaries(table(spark, root, "lang_samples"))
    return encoding.restored(table(spark, root, "documents"), dictionaries)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_restored(spark, root).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_search": p2_search,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p9_faults": p9_faults,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
    "p7_found": p7_found,
    "p7_blocks": p7_blocks,
    "p7_main": p7_main,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p5_found": p5_found,
    "p5_evidence": p5_evidence,
    "p6_found": p6_found,
    "p6_repeated": p6_repeated,
    "p6_clusters": p6_clusters,
    "p6_clean": p6_clean,
}

_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')"
_SPACE = r"[\t\r\f\v \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: p2_found compares all pairs; for the small tables of the SQL check only.
SQL: dict[str, str] = {
    # what a right packing of any table has
    "p9_faults": "select 0 as missing, 0 as doubled, 0 as overfull, 0 as overlapping",
    "p6_repeated": f"""
        with l as (select id, coalesce(url, '') as u, coalesce({_HOST}, '?' || url, '?') as h, unnest(string_split(summary, chr(10))) as line,
            generate_subscripts(string_split(summary, chr(10)), 1)::int as line_no from pages where summary is not null),
        f as (select id, u, h, line_no, regexp_replace(trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '{_SPACE}', ' ', 'g')), '[0-9]+', '0', 'g') as t from l)
        select id, line_no from f where t <> '' and (h, t) in (select (h, t) from f group by h, t having count(distinct u) >= 10)""",
    "p2_found": """
        with v as (select id, list_transform(embedding, lambda x: x::double) as e from pages
          where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p as (select a.id as i, b.id as j, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.id <> b.id),
        r as (select *, row_number() over (partition by i order by s desc, j) as k from p)
        select distinct least(i, j) as id_a, greatest(i, j) as id_b from r where k <= 10 and s >= 0.85""",
}
