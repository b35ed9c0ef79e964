"""Queries over the driver's tables, one per operator or job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import standins as S
from skilltrail.functions import text as X
from skilltrail.operators import careers, extract, feedback, listings, lookup, rules, suggest
from skilltrail.operators.weights import pair_counts
from skilltrail.plans import jobs
from skilltrail.session import cut, scratch_path, tune
from skilltrail.sources import pages as page_source
from skilltrail.sources import tables
from skilltrail.streaming import flows

MIN_SUGGESTED = 3


def _joined(column, sep: str = ","):
    return F.array_join(column, sep)


def _model(spark, d):
    return careers.fit_career_model(S.document_listings(spark, d))


def suggest_careers(spark: SparkSession, d: str) -> DataFrame:
    ranked = careers.suggest_careers(S.passage_users(spark, d), _model(spark, d))
    return ranked.select("user_id", "career", F.round("sim", 6).alias("sim"), "rank")


def career_terms(spark, d):
    return _model(spark, d).terms


def skill_idf(spark, d):
    return _model(spark, d).idf.select("skill", "df", F.round("idf", 6).alias("idf"))


def career_vectors(spark, d):
    return _model(spark, d).vectors.select("career", "skill", F.round("weight", 6).alias("weight"))


def _document_search(spark, d, search):
    """Listings of the careers suggested to each passage, from stored listings."""
    stored, users = cut(S.document_listings(spark, d)), S.passage_users(spark, d)
    wanted = careers.suggest_careers(users, careers.fit_career_model(stored))
    return search(wanted.select("user_id", "career"), users, stored).select(
        "user_id", "career", "unique_url", "sim", "rank"
    )


def rank_listings(spark, d):
    return _document_search(spark, d, listings.rank_listings)


def jaccard_listings(spark, d):
    return _document_search(spark, d, listings.rank_listings_jaccard)


def _mined(spark, d):
    orders = cut(S.order_listings(spark, d))
    return orders, rules.frequent_itemsets(orders, S.brand_lexicon(spark, d))


def frequent_itemsets(spark, d):
    return _mined(spark, d)[1].select(
        "career", _joined("itemset").alias("items"), "freq", "n", "halvings"
    )


def skill_rules(spark, d):
    return rules.association_rules(_mined(spark, d)[1]).select(
        "career",
        _joined("antecedent").alias("antecedent"),
        "suggested",
        F.round("confidence", 6).alias("confidence"),
        "complexity",
        "rule_id",
    )


def ranked_rules(spark, d):
    """Rules with confidences of three digits, so that equal ones are equal on both sides."""
    found = rules.association_rules(_mined(spark, d)[1])
    found = found.withColumn("confidence", F.round("confidence", 3))
    return rules.ranked_rules(found).select("rule_id", "complexity", "confidence", "rank")


def described_listings(spark, d):
    """Ranked listings with the language of the document as title, its source as place."""
    named = S.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("unique_url"),
        F.col("lang").alias("title"),
        F.col("source").alias("location"),
    )
    return listings.describe_listings(rank_listings(spark, d), named)


def _suggestions(spark, d):
    orders, itemsets = _mined(spark, d)
    wanted, owned = S.customers_as_users(orders)
    return suggest.suggest_skills(
        wanted, owned, rules.association_rules(itemsets), S.brand_lexicon(spark, d)
    )


def suggest_skills(spark, d):
    return suggest.ordered_suggestions(_suggestions(spark, d)).select(
        "user_id",
        "career",
        "suggested",
        F.round("confidence", 6).alias("confidence"),
        "complexity",
        _joined("used").alias("used"),
        "rank",
    )


def plan_edges(spark, d):
    return suggest.plan_edges(_suggestions(spark, d)).select(
        "user_id",
        "career",
        "skill",
        "suggested",
        *[F.round(c, 6).alias(c) for c in ("strength", "total", "width")],
    )


def learning_plan(spark, d):
    return suggest.learning_plan(suggest.plan_edges(_suggestions(spark, d))).select(
        "user_id",
        "career",
        "suggested",
        F.round("strength", 6).alias("strength"),
        "n_used",
        F.round("score", 6).alias("score"),
        "tier",
        "rank",
    )


def skill_subsets(spark, d):
    _, owned = S.customers_as_users(S.order_listings(spark, d))
    found = [suggest.skill_subsets(owned, size) for size in (3, 2, 1)]
    return found[0].union(found[1]).union(found[2]).select("user_id", _joined("subset").alias("subset"))


def known_skills(spark, d):
    """Passage words of each user that the passage lexicon has as single words."""
    return suggest.known_skills(S.passage_users(spark, d), S.passage_lexicon(spark, d))


def user_term_counts(spark, d):
    return pair_counts(S.passage_users(spark, d), ["user_id"])


def extract_skills(spark, d):
    return extract.match_skills(S.texts(spark, d), S.passage_lexicon(spark, d), ["doc_id"])


def resume_skills(spark, d):
    chats = S.table(spark, d, "conversations")
    return extract.resume_skills(chats, S.passage_lexicon(spark, d), ["conv_id", "turn"])


def listings_with_skills(spark, d):
    """Pages as listings: visible text, skills found in it, pages without any dropped."""
    text = page_source.page_text(S.pages(spark, d))
    found = extract.with_skills(text, S.passage_lexicon(spark, d), ["page_id"])
    return found.where(tables.has_skills()).select(
        "page_id", "url", _joined("skills", "|").alias("skills")
    )


def visible_text(spark, d):
    return page_source.page_text(S.pages(spark, d)).select("page_id", "text")


def listing_fields(spark, d):
    return page_source.listing_fields(S.pages(spark, d), ["page_id"], block="li")


def result_pages(spark, d):
    """Suppliers of each nation as a results page with places, links before and after the column."""
    rows = S.table(spark, d, "supplier").join(
        S.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    result = F.format_string(
        '<h2><a href="http://jobs.example.com/rc/%d?a=1&amp;b=2" title="%s &amp; Co">x</a></h2>'
        "<div><span class='location'><span>%s, %d (%s)</span></span></div>",
        "s_suppkey", "s_name", "n_name", "s_suppkey", "n_name",
    )
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", result.alias("r")))), lambda x: x["r"]), ""
    )
    outside = "<h2><a href='/no'>no</a></h2>"
    pages = rows.groupBy(F.col("n_nationkey").alias("page_id")).agg(
        F.concat(
            F.lit(f"<body><table><tr><td>{outside}</td><td id='resultsCol'><table><tr><td>a</td></tr></table>"),
            listed, F.lit(f"</td><td>{outside}</td></tr></table></body>"),
        ).alias("html")
    )
    return page_source.listing_fields(pages, ["page_id"])


def ingest_new_listings(spark, d):
    seen = S.page_arrivals(S.table(spark, d, "pages"))
    return tables.new_listings(
        seen.where("not crawled_before"), seen.where("crawled_before"), ["page_id"]
    ).select("unique_url", "page_id")


def new_listing_count(spark, d):
    return ingest_new_listings(spark, d).agg(F.count("*").alias("n_new"))


def known_careers(spark, d):
    return tables.known_careers(S.order_listings(spark, d))


def career_listings(spark, d):
    """Listings of the careers that machinery customers ask for, written in title form."""
    orders = S.order_listings(spark, d)
    return orders.where(
        F.col("career") == X.format_career(F.lit("Machinery"))
    ).select("unique_url", _joined(F.array_sort("skills")).alias("skills"))


def career_titles(spark, d):
    lines = S.texts_with_source(spark, d).select(
        F.col("source").alias("category"), F.explode_outer(F.split("text", "\n")).alias("value")
    )
    return tables.career_titles(lines)


def user_skills_state(spark, d):
    return feedback.current_skills(S.skill_log(spark, d), order=("ts", "event_id"))


def merged_user_skills(spark, d):
    """Chat participants' logged skills and those read from what they wrote."""
    chats = S.table(spark, d, "conversations")
    read = extract.resume_skills(chats, S.passage_lexicon(spark, d), ["conv_id", "turn"])
    logged = feedback.current_skills(S.skill_log(spark, d), order=("ts", "event_id"))
    return feedback.add_skills(logged, read.select(F.col("conv_id").alias("user_id"), "skill"))


def _spelled(counters):
    entries = F.transform(
        F.array_sort(F.map_entries("spellings")),
        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
    )
    return counters.select("action", "formatted", "skill", _joined(entries).alias("spellings"), "n")


def feedback_counts(spark, d):
    return _spelled(feedback.skill_feedback(S.chat_feedback(spark, d)))


def career_feedback(spark, d):
    return feedback.career_feedback(S.part_suggestions(spark, d))


def promote_careers(spark, d):
    known = S.table(spark, d, "part").where("p_type = 'STANDARD'").select(
        X.format_career(F.concat_ws(" ", "p_name", "p_brand")).alias("career")
    )
    counters = feedback.career_feedback(S.part_suggestions(spark, d))
    return feedback.promote_careers(counters, known, MIN_SUGGESTED)


def career_display(spark, d):
    name = F.concat(
        X.format_career(F.col("p_name")), F.lit("/"), F.lower("p_type"), F.lit("&"),
        F.lower("p_brand"),
    )
    keys = S.table(spark, d, "part").select(name.alias("career")).distinct()
    return keys.select("career", X.career_display(F.col("career")).alias("display"))


def formatted_skills(spark, d):
    """Lookup keys of every line of the documents read as a skill."""
    lines = S.texts(spark, d).select(F.explode_outer(F.split("text", "\n")).alias("skill"))
    return lines.distinct().select("skill", X.format_skill(F.col("skill")).alias("formatted"))


def typeahead(spark, d):
    parts = S.table(spark, d, "part")
    kinds = parts.select("p_type").distinct()
    keystrokes = kinds.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("p_type")),
                lambda n: F.substring(F.col("p_type"), F.lit(1), n),
            )
        ).alias("term")
    )
    return lookup.typeahead(keystrokes, parts.select(F.col("p_name").alias("entry")))


def _requests_for_kinds(spark, d):
    parts = S.table(spark, d, "part")
    asked = parts.select(
        "p_partkey", X.format_career(F.substring_index("p_name", " ", 1)).alias("career")
    )
    return asked, parts.select(X.format_career(F.col("p_type")).alias("career"))


def known_requests(spark, d):
    return lookup.known_requests(*_requests_for_kinds(spark, d)).select("p_partkey", "career")


def unknown_requests(spark, d):
    return lookup.unknown_requests(*_requests_for_kinds(spark, d)).select("p_partkey", "career")


def url_extension(spark, d):
    return S.table(spark, d, "pages").select(
        "page_id",
        X.file_extension(F.col("url")).alias("extension"),
        X.has_allowed_extension(F.col("url"), ("html", "pdf")).alias("allowed"),
    )


def ingest_pages(spark, d):
    """Listing table after the crawl of all pages, one row per URL."""
    path = scratch_path(spark, "listings")
    crawl = S.crawl_pages(S.pages(spark, d))
    jobs.ingest_pages(crawl, S.passage_lexicon(spark, d), path)
    return _stored(spark, path)


def _stored(spark, path):
    return tables.read_listings(spark, path).select(
        "unique_url", "career", "searched_at", F.size("skills").alias("n_skills"),
        _joined("skills", "|").alias("skills"),
    )


def reextracted_listings(spark, d):
    """Documents as stored listings whose skills are found anew."""
    stored = S.texts_with_source(spark, d).select(
        F.col("source").alias("career"),
        F.col("doc_id").cast("string").alias("unique_url"),
        F.col("text").alias("listing_text"),
        *[F.lit(None).cast(t).alias(c) for c, t in
          (("searched_at", "timestamp"), ("title", "string"), ("location", "string"))],
        F.array().cast("array<string>").alias("skills"),
    )
    return jobs.reextract(stored, S.passage_lexicon(spark, d)).select(
        "career", "unique_url", F.size("skills").alias("n_skills"),
        F.sha2(_joined("skills", "|"), 256).alias("skills_sha"),
    )


def stream_ingest(spark, d):
    path = scratch_path(spark, "stream-listings")
    flows.ingest_stream(
        S.crawl_pages(S.stream_of(spark, d, "pages")), S.passage_lexicon(spark, d), path,
        scratch_path(spark, "stream-state"),
    ).awaitTermination()
    return _stored(spark, path)


def stream_feedback(spark, d):
    path = scratch_path(spark, "stream-counts")
    flows.feedback_stream(
        S.chat_words(S.stream_of(spark, d, "conversations")), path
    ).awaitTermination()
    return _spelled(flows.read_feedback(spark, path))


def stream_career_feedback(spark, d):
    """Every chat word as a suggested career, counted by a stream."""
    path = scratch_path(spark, "stream-careers")
    words = S.chat_words(S.stream_of(spark, d, "conversations"))
    flows.career_stream(words.withColumn("action", F.lit("add_career")), path).awaitTermination()
    return flows.read_careers(spark, path)


def merged_career_feedback(spark, d):
    """Career counters with the same suggestions added once more."""
    suggestions = S.part_suggestions(spark, d)
    return feedback.merge_career_feedback(feedback.career_feedback(suggestions), suggestions)


def decoded_references(spark, d):
    """Document texts written in numeric references, every character one, and decoded again."""
    chars = F.split("text", "")
    form = lambda c, i: F.when(
        i % 2 == 0, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))
    ).otherwise(F.concat(F.lit("&#x"), F.lpad(F.hex(F.ascii(c)), 8, "0"), F.lit(";")))
    # An empty text is one empty piece, which is no character.
    coded = F.when(F.col("text") == "", "").otherwise(F.array_join(F.transform(chars, form), ""))
    return S.texts(spark, d).select("doc_id", X.unescape(coded).alias("text"))


def merged_feedback(spark, d):
    """Counters of added skills first, then the other suggestions folded into them."""
    words = S.chat_feedback(spark, d)
    first, second = words.where("action = 'add_skill'"), words.where("action <> 'add_skill'")
    skills, counts = jobs.fold_feedback(first)
    return _spelled(jobs.fold_feedback(second, skills, counts)[0])


def latest_suggestions(spark, d):
    """First five suggestions per user and career, as a career page lists them."""
    return suggest.ordered_suggestions(_suggestions(spark, d), 5).select(
        "user_id", "career", "suggested", "rank"
    )


def saved_model_careers(spark, d):
    """Career suggestions from a model written and read back."""
    path = scratch_path(spark, "model")
    _model(spark, d).save(path)
    ranked = careers.suggest_careers(
        S.passage_users(spark, d), careers.CareerModel.load(spark, path)
    )
    return ranked.select("user_id", "career", "sim", "rank")


def rule_upsert(spark, d):
    """Confident rules of a new run over doubtful ones of an old run, marked by 0."""
    table = cut(rules.association_rules(_mined(spark, d)[1]))
    old = table.where("confidence < 0.2").withColumn("confidence", F.lit(0.0))
    return tables.upsert_rules(table.where("confidence >= 0.15"), old).select(
        "rule_id", F.round("confidence", 6).alias("confidence")
    )


def locations(spark, d):
    """Customers' addresses as listing locations, and a link per customer."""
    nations = S.table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = S.table(spark, d, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    place = F.concat("n_name", F.lit(", "), "c_mktsegment", F.lit(" "), "c_custkey", F.lit(" ("),
                     "c_name", F.lit(")"))
    return customers.select(
        "c_custkey",
        X.clean_location(place).alias("location"),
        X.listing_link("http://jobs.example.com/", F.concat(F.lit("/"), "c_name")).alias("link"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        suggest_careers,
        career_terms,
        skill_idf,
        career_vectors,
        rank_listings,
        jaccard_listings,
        frequent_itemsets,
        skill_rules,
        ranked_rules,
        described_listings,
        suggest_skills,
        plan_edges,
        learning_plan,
        skill_subsets,
        known_skills,
        user_term_counts,
        extract_skills,
        resume_skills,
        listings_with_skills,
        visible_text,
        listing_fields,
        result_pages,
        ingest_new_listings,
        new_listing_count,
        known_careers,
        career_listings,
        career_titles,
        user_skills_state,
        merged_user_skills,
        feedback_counts,
        career_feedback,
        promote_careers,
        career_display,
        formatted_skills,
        typeahead,
        known_requests,
        unknown_requests,
        url_extension,
        ingest_pages,
        reextracted_listings,
        stream_ingest,
        stream_feedback,
        stream_career_feedback,
        merged_career_feedback,
        decoded_references,
        merged_feedback,
        latest_suggestions,
        saved_model_careers,
        rule_upsert,
        locations,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query):
        return lambda spark, sf_dir: query(tune(spark), sf_dir)

    return {name: bound(query) for name, query in QUERIES.items()}
