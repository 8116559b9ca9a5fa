"""Claim attribution: candidate anchors, verification, recovery and gating.

A candidate row is one claim with its few ranked anchors:
answer_id, claim_id, claim_text, anchors array<struct<rank, anchor_id, terms>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import FACTORS
from evidar.functions.expr import let
from evidar.functions.terms import HYPOTHETICAL_LABEL, attribution_terms, coverage_in, coverage_of, critical_in, words
from evidar.operators.ranking import top_k

CLAIM = ["answer_id", "claim_id"]
#: What tells lists of hits apart, and the claims of one list that are compared with its quotes at a time.
HITS, BLOCK = ["_n", "_x", "_y"], 128
# Fixed values.
VERIFY_COVERAGE, RECOVER_COVERAGE, MAX_ANCHORS, RECOVER_FROM = 0.4, 0.7, 3, 4
NO_SUPPORT = "The fixed lecture does not provide enough directly supported information to answer this question."


def rank_anchors(claims: DataFrame, hits: DataFrame, anchors: DataFrame, max_per_claim: int = 4) -> DataFrame:
    """Best anchors of the chunks retrieved for each claim, as rows.

    ``claims``: answer_id, claim_id, text.  ``hits``: answer_id, claim_id, chunk_id, rank.
    ``anchors``: anchor_id, chunk_id, exact_quote.  Texts are canonical.
    """
    open_claims = claims.filter(~F.col("text").startswith(HYPOTHETICAL_LABEL)).select(
        *CLAIM, F.array_distinct(words("text")).alias("_claim"))
    # Words of a quote once, and their repeats (mostly none) apart: distinct words meet without a look at every pair of them.
    quotes = anchors.select("anchor_id", "chunk_id", words("exact_quote").alias("_all")).select(
        "anchor_id", "chunk_id", F.array_distinct("_all").alias("_quote"),
        F.when(F.size(F.array_distinct("_all")) < F.size("_all"), F.filter("_all", lambda w, i: F.array_position(F.col("_all"), w) != i + 1)).alias("_again"))
    # Claims with the same hits, up to their hashes, meet the quotes of one of them: words travel once a claim and once a block of claims, not once
    # a hit, and a pair of claim and quote never leaves its task.
    hashes = [F.sum(F.shiftright(F.xxhash64(F.lit(seed), "chunk_id", "rank"), 24)).alias(name) for seed, name in enumerate(HITS[1:])]
    listed = open_claims.join(hits.groupBy(*CLAIM).agg(F.count(F.lit(1)).alias(HITS[0]), *hashes), CLAIM)
    lists = listed.groupBy(*HITS).agg(F.min(F.struct(*CLAIM)).alias("_one"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    one = lists.select("_one.*", *HITS, "_blocks")
    shown = hits.select(*CLAIM, "chunk_id", F.col("rank").alias("_hit")).join(one.select(*CLAIM), CLAIM, "left_semi").join(one, CLAIM)
    shown = shown.select(*HITS, "_blocks", "chunk_id", "_hit").join(quotes, "chunk_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = listed.join(lists.select(*HITS, "_blocks"), HITS).withColumn("_block", F.pmod(F.xxhash64(*CLAIM), F.col("_blocks")).cast("int")).drop("_blocks")
    rows = dealt.join(shown.drop("_blocks"), [*HITS, "_block"])
    again = F.when(F.col("_again").isNotNull(), F.size(F.filter("_again", lambda w: F.array_contains(F.col("_claim"), w)))).otherwise(0)
    overlap = F.size(F.array_intersect("_quote", "_claim")) + again
    scored = rows.select(*HITS, "_block", *CLAIM, "anchor_id", "_hit", overlap.alias("overlap"))
    once = scored.groupBy(*HITS, "_block", *CLAIM, "anchor_id").agg(F.max("overlap").alias("overlap"), F.min("_hit").alias("_hit"))
    order = [F.col("overlap").desc(), F.col("_hit"), F.col("anchor_id")]
    return top_k(once, [*HITS, "_block", *CLAIM], order, max_per_claim).drop("_hit", *HITS, "_block")


def candidates(claims: DataFrame, ranked: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per claim with its ranked anchors and their terms (at most six)."""
    terms = anchors.select("anchor_id", F.array_distinct(attribution_terms("exact_quote")).alias("terms"))
    lists = ranked.join(terms, "anchor_id").groupBy(*CLAIM).agg(
        F.sort_array(F.collect_list(F.struct("rank", "anchor_id", "terms"))).alias("anchors"))
    blank = F.array().cast("array<struct<rank:int,anchor_id:string,terms:array<string>>>")
    return claims.select(*CLAIM, F.col("text").alias("claim_text")).join(lists, CLAIM, "left").withColumn(
        "anchors", F.coalesce("anchors", blank))


def direct_coverage(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """C3 for claims with given anchors. ``anchors``: answer_id, claim_id, exact_quote; ``terms`` where they are known already.

    Only terms of the claim itself can count, so no others leave a pair of claim and quote.
    """
    terms = F.col("terms") if "terms" in anchors.columns else attribution_terms("exact_quote")
    own = claims.select(*CLAIM, F.array_distinct(attribution_terms("text")).alias("_own"))
    shared = anchors.select(*CLAIM, terms.alias("_terms")).join(own, CLAIM).select(*CLAIM, F.explode(F.array_intersect("_own", "_terms")).alias("term"))
    evidence = shared.groupBy(*CLAIM).agg(F.collect_set("term").alias("_terms"))
    blank = F.array().cast("array<string>")
    return claims.join(evidence, CLAIM, "left").withColumn(
        "coverage", coverage_of(attribution_terms("text"), F.coalesce("_terms", blank))).drop("_terms")


def verify_attributions(candidate_rows: DataFrame, selections: DataFrame) -> DataFrame:
    """C4: accept external selections whose quotes really cover the claim.

    ``selections``: answer_id, item_pos, claim_id, anchor_ids. The first passing item per claim counts.
    """
    allowed = candidate_rows.select(*CLAIM, "claim_text", F.explode("anchors").alias("a")).select(
        *CLAIM, "claim_text", "a.anchor_id", "a.terms")
    asked = selections.select(*CLAIM, "item_pos", F.posexplode("anchor_ids").alias("pos", "anchor_id"))
    first = asked.groupBy(*CLAIM, "item_pos", "anchor_id").agg(F.min("pos").alias("pos"))
    known = first.join(allowed, [*CLAIM, "anchor_id"])
    few = top_k(known, [*CLAIM, "item_pos"], [F.col("pos")], MAX_ANCHORS, "_n")
    items = few.groupBy(*CLAIM, "item_pos", "claim_text").agg(
        F.sort_array(F.collect_list(F.struct("pos", "anchor_id")))["anchor_id"].alias("anchor_ids"),
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("_terms"))
    passing = items.withColumn("coverage", coverage_of(attribution_terms("claim_text"), F.col("_terms"))).filter(
        F.col("coverage") >= VERIFY_COVERAGE)
    return top_k(passing, CLAIM, [F.col("item_pos")], 1, "_n").select(*CLAIM, "anchor_ids", "coverage")


def best_subset(claim_terms: Column, anchors: Column) -> Column:
    """Smallest anchor subset that covers the claim, best coverage first; NULL if none."""

    def cover(pool: Column, claim: Column, critical: Column, size: int) -> Column:
        """Best covering subset of ``size`` anchors."""
        def option(mask: int) -> Column:
            places = [i for i in range(RECOVER_FROM) if mask >> i & 1]
            chosen = [F.get(pool, F.lit(i)) for i in places]
            return let(
                F.flatten(F.array(*[a["terms"] for a in chosen])),
                lambda evidence: F.when(F.size(pool) > places[-1], F.struct(
                    coverage_in(claim, critical, evidence).alias("coverage"), F.lit(-mask).alias("first"),
                    F.array(*[a["anchor_id"] for a in chosen]).alias("anchor_ids"))),
            )

        masks = [m for m in range(1, 1 << RECOVER_FROM) if m.bit_count() == size]
        return F.array_max(F.filter(F.array(*[option(m) for m in masks]), lambda o: o["coverage"] >= RECOVER_COVERAGE))

    def search(claim: Column) -> Column:
        """Fewest anchors first: larger subsets are looked at only where no smaller one covers the claim."""
        own = F.transform(F.slice(anchors, 1, RECOVER_FROM), lambda a: F.struct(a["anchor_id"].alias("anchor_id"), F.array_intersect(a["terms"], claim).alias("terms")))
        return let(critical_in(claim), lambda critical: let(own, lambda pool: F.coalesce(*[
            cover(pool, claim, critical, size) for size in range(1, MAX_ANCHORS + 1)])))

    return F.when(F.size(anchors) > 0, let(F.array_distinct(claim_terms), search))


def subset_cover(candidate_rows: DataFrame) -> DataFrame:
    """K10 for every claim that has a covering subset."""
    best = best_subset(attribution_terms("claim_text"), F.col("anchors"))
    return candidate_rows.withColumn("_best", best).filter("_best IS NOT NULL").select(
        *CLAIM, F.col("_best.anchor_ids").alias("anchor_ids"), F.col("_best.coverage").alias("coverage"))


def recover_attributions(candidate_rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified attributions plus near-verbatim ones that the verifier left out."""
    open_rows = candidate_rows.join(verified.select(*CLAIM), CLAIM, "left_anti")
    return verified.unionByName(subset_cover(open_rows))


def gate_claims(answers: DataFrame, claims: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grounded answers keep only verified claims; nothing left means a fixed refusal.

    ``answers``: answer_id, summary, grounding.  ``claims``: answer_id, claim_id, text (without the summary).
    """
    checked = verified.select(*CLAIM).distinct()
    grounded = answers.select("answer_id", "grounding")
    kept = claims.join(grounded, "answer_id").join(checked.withColumn("_ok", F.lit(True)), CLAIM, "left").filter(
        ~F.col("grounding") | F.coalesce("_ok", F.lit(False))).drop("_ok", "grounding")
    left = kept.groupBy("answer_id").agg(F.count(F.lit(1)).alias("claim_count"))
    summary_ok = checked.filter("claim_id = 'summary'").select("answer_id", F.lit(True).alias("_summary_ok"))
    gated = answers.join(left, "answer_id", "left").join(summary_ok, "answer_id", "left").fillna(0, ["claim_count"])
    own = F.when(~F.col("grounding") | F.coalesce("_summary_ok", F.lit(False)), F.coalesce("summary", F.lit(""))).otherwise("")
    refused = F.col("grounding") & (own == "") & (F.col("claim_count") == 0)
    return gated.withColumn("refused", refused).withColumn(
        "summary", F.when(refused, NO_SUPPORT).otherwise(own)).drop("_summary_ok"), kept


def attach_factors(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Study factors of every session, and the sessions with an unknown condition."""
    cells = F.create_map(*[
        part for name, (grounding, attribution, variant) in FACTORS.items()
        for part in (F.lit(name), F.struct(
            F.lit(grounding).alias("grounding"), F.lit(attribution).alias("attribution"), F.lit(variant).alias("core_variant")))
    ])
    looked = sessions.withColumn("_cell", F.try_element_at(cells, F.upper(F.trim("condition"))))
    known = looked.filter("_cell IS NOT NULL").select(*sessions.columns, "_cell.*")
    invalid = looked.filter("_cell IS NULL").select(*sessions.columns, F.lit("INVALID_STUDY_CONDITION").alias("error_code"))
    return known, invalid


def visible_citations(claims: DataFrame, verified: DataFrame, sessions: DataFrame) -> DataFrame:
    """Citations of retained claims, shown only where attribution is on.

    ``sessions``: answer_id, condition.
    """
    shown, _ = attach_factors(sessions)
    return verified.join(claims.select(*CLAIM), CLAIM, "left_semi").join(
        shown.filter("attribution").select("answer_id"), "answer_id", "left_semi")


def paired_core_check(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One core hash per variant, two overall, citations exactly where attribution is on.

    ``answers``: answer_id, condition, core_hash.  ``citations``: answer_id rows.
    """
    known, _ = attach_factors(answers)
    counts = citations.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_cited"))
    joined = known.join(counts, "answer_id", "left").fillna(0, ["_cited"])
    return joined.groupBy("core_variant").agg(
        F.count_distinct("core_hash").alias("n_hashes"),
        F.sum(F.when(~F.col("attribution"), F.col("_cited")).otherwise(0)).alias("hidden_citations"),
        F.sum(F.when(F.col("attribution"), F.col("_cited")).otherwise(0)).alias("shown_citations"),
    ).withColumn("ok", (F.col("n_hashes") == 1) & (F.col("hidden_citations") == 0) & (F.col("shown_citations") > 0))


def number_sources(citations: DataFrame) -> DataFrame:
    """Anchors of an answer numbered by first appearance. ``citations``: answer_id, pos, anchor_id."""
    from evidar.operators.slices import carry

    first = citations.groupBy("answer_id", "anchor_id").agg(F.min("pos").alias("first_pos"))
    return carry(first, ["answer_id"], None, ["first_pos", "anchor_id"], index="source_number")


def quote_audit(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Quote occurs in its page; rectangles lie inside the page.

    ``anchors``: anchor_id, doc_id, page, exact_quote, rectangles.  ``pages``: doc_id, page, text.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[\s\p{Z}\x{FEFF}]+", " "))
    edge = 1.01
    inside = F.forall(
        "rectangles",
        lambda r: (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0)
        & (r["x"] + r["width"] <= edge) & (r["y"] + r["height"] <= edge),
    )
    joined = anchors.join(pages.select("doc_id", "page", F.col("text").alias("_page")), ["doc_id", "page"], "left")
    found = F.contains(squeeze(F.col("_page")), squeeze(F.col("exact_quote")))
    return joined.select(
        "anchor_id", F.coalesce(found, F.lit(False)).alias("quote_found"), F.coalesce(inside, F.lit(True)).alias("rectangles_ok"))


def locate_quote(anchors: DataFrame, items: DataFrame, run: int = 5) -> DataFrame:
    """Text items that hold the longest run of quote words, at least ``run`` words.

    Quotes and pages meet on hashed runs of ``run`` words (whole quotes when shorter). Runs that
    continue on the same diagonal join into longer ones. ``anchors``: anchor_id, doc_id, page,
    exact_quote.  ``items``: doc_id, page, item_seq, str.
    """
    from pyspark.sql import Window

    from evidar.operators.slices import carry

    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    flat = items.select("doc_id", "page", "item_seq", F.posexplode(tokens(F.col("str"))).alias("_i", "token"))
    # Position of every token on its page, then the next words of the page.
    placed = carry(flat, ["doc_id", "page"], None, ["item_seq", "_i"], index="at")
    words_of = anchors.withColumn("_words", tokens(F.col("exact_quote"))).filter(F.size("_words") > 0)
    size = F.least(F.size("_words"), F.lit(run))
    grams = words_of.select(
        "anchor_id", "doc_id", "page", size.alias("size"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_words") - size), lambda s: F.xxhash64(
            F.array_join(F.slice(F.col("_words"), s + 1, size), " ")))).alias("quote_at", "gram"),
    )
    # Pages are cut into blocks; the first words of a block also end the block before.
    width = 4_096
    block = F.floor((F.col("at") - 1) / width)
    near = ((F.col("at") - 1) % width < run - 1) & (block > 0)
    copies = F.when(near, F.array(block, block - 1)).otherwise(F.array(block))
    blocks = placed.select("doc_id", "page", "at", "token", block.alias("_home"), F.explode(copies).alias("_block"))
    lead = Window.partitionBy("doc_id", "page", "_block").orderBy("at")
    ahead = [F.lead("token", k).over(lead) for k in range(1, run)]
    pages = blocks.withColumn("_next", F.array(F.col("token"), *ahead)).filter("_home = _block")
    shingles = pages.select(
        "doc_id", "page", "at", F.explode(F.sequence(F.lit(1), F.size(F.array_compact("_next")))).alias("size"), "_next"
    ).select("doc_id", "page", "at", "size", F.xxhash64(F.array_join(F.slice("_next", F.lit(1), F.col("size")), " ")).alias("gram"))
    matched = grams.join(shingles, ["doc_id", "page", "size", "gram"]).withColumn("diagonal", F.col("at") - F.col("quote_at"))
    along = Window.partitionBy("anchor_id", "diagonal").orderBy("quote_at")
    islands = matched.withColumn("island", F.col("quote_at") - F.row_number().over(along)).groupBy(
        "anchor_id", "doc_id", "page", "diagonal", "island"
    ).agg(F.min("quote_at").alias("quote_at"), F.min("at").alias("at"), (F.count(F.lit(1)) + F.max("size") - 1).alias("length"))
    best = top_k(islands, ["anchor_id"], [F.col("length").desc(), F.col("quote_at"), F.col("at")], 1, "_n")
    spans = best.select("anchor_id", "doc_id", "page", F.col("at").alias("_from"), "length")
    return placed.join(spans, ["doc_id", "page"]).filter(
        (F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_from") + F.col("length"))
    ).select("anchor_id", "doc_id", "page", "item_seq", "length").distinct()
