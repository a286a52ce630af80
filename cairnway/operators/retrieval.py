"""Facts as passages, questions routed to them, gear matched with pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import skew
from cairnway.functions import text

# Question vocabulary.
STOPWORDS = (
    "the a an is are was were do does did i you my me it this that of for to in on and or be can could would should about "
    "there any some have has"
).split()
QUESTION_WORDS = "what which where when why how whose whom who tell explain mean please".split()
DOMAIN_WORDS = (
    "trail trails route routes path track trailhead hike hiking trek walk way ways relation segment segments component "
    "components map osm openstreetmap geometry line hash route_shape terrain elevation climb ascent descent slope steep "
    "distance length gain loss relief profile surface weather rain rainfall snow wind temperature cold heat condition "
    "conditions forecast precipitation mud suitability suitable caution adverse favourable favorable unfavorable "
    "unfavourable gear clothing footwear jacket shell shoes socks gloves trousers equipment preparation pack product "
    "products shop buy purchase difficulty scale sac grade demand demanding complexity source sources official estimated "
    "evidence measured computed inferred inference benchmark model missing unavailable unknown require required requires "
    "necessary essential optional recommend recommended safety kilometre kilometres kilometer kilometers metre metres "
    "meter meters"
).split()
TOPIC_WORDS = {
    "identity": "name names identity osm openstreetmap id relation member way identifier",
    "difficulty": "difficult difficulty hard easy grade sac level challenging strenuous",
    "condition": (
        "condition conditions muddy mud wet rain rainy slippery snow ice cold hot wind weather temperature current "
        "currently today dry storm"
    ),
    "suitability": (
        "suitable suitability fit okay good bad recommend worth should caution adverse favourable favorable unfavourable "
        "unfavorable unfit status marked rated judged assessment"
    ),
    "gear": (
        "gear wear wearable clothes clothing jacket shell shoes boots socks glove hat layer carry pack need bring equipment "
        "essential necessary required optional prepare preparation recommend trousers waterproof footwear rainproof"
    ),
    "products": "product products buy shop shopping purchase link store price all",
    "terrain": (
        "elevation climb ascent descent slope steep gain terrain distance long km flat relief profile height metres meters"
    ),
    "necessity": (
        "need needs necessary all really actually every essential optional must have buy product products want require "
        "mandatory skip avoid enough"
    ),
    "reasoning": "why reason reasons because caused justify justified marked rated explained evidence based meant means",
    "provenance": (
        "source come came from where official estimated verify verified authoritative osmmap openstreetmap dataset gis "
        "recorded live cached measure measured inferred inference benchmark model"
    ),
    "missing": "missing unavailable unknown not known lack available evidence data nothing absent null",
    "demands": (
        "demanding demand demands hard tough strenuous exertion effort physical climb steep ascent score complexity"
    ),
}
REASON_TOPICS = "reasoning suitability condition gear provenance demands terrain".split()
ALL_TOPICS = "necessity gear products".split()
REASON_WORDS = "why reason because justify justified explained".split()
ALL_WORDS = "all really actually every necessary".split()
PURCHASE_WORDS = "buy shop shopping purchase price prices cost".split()
INTENTS = {
    "rainfall": "rainfall rain rained raining precipitation wet mm shower showers downpour",
    "difficulty": "difficult difficulty hard hardest easy grade graded strenuous challenging steep",
    "gear": (
        "gear wear clothes clothing jacket shell shoes boots socks layer pack equipment essential prepare preparation bring "
        "carry need needs necessary kit trousers waterproof footwear lamp headlamp poles"
    ),
    "condition": (
        "condition conditions muddy mud slippery snow ice cold hot wind weather warm dry storm temperature caution adverse "
        "favourable favorable warning why"
    ),
    "suitability": "suitable suitability fit okay good bad recommend worth should unfavourable unfavorable unfit status",
    "activity": (
        "altitude acclimatisation acclimatization overnight technical mountaineering ferrata kind type activity trip"
    ),
}
INSTRUCTION_SHAPES = [
    "ignore all previous", "ignore previous instructions", "ignore the above", "disregard previous", "disregard all",
    "system prompt", "your instructions", "reveal the developer", "print your full rules", "new instructions", "you are now",
    "act as", "override your",
]
NON_DISTINCTIVE = (
    "and any are bag buy cold dry for from gear hiking its mud muddy online pair rain rainy set snow the this trails warm "
    "wet weather with your"
).split()


def words_sql(column: str) -> str:
    dropped = text.quoted(STOPWORDS + QUESTION_WORDS)
    found = f"regexp_extract_all(lower({column}), '([a-z0-9]+)', 1)"
    return f"array_distinct(filter({found}, w -> length(w) > 2 AND w NOT IN ({dropped})))"


def _stems_sql(w: str) -> str:
    return (
        f"array_compact(array({w}, CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN concat(left({w}, length({w}) - 3), 'y') "
        f"WHEN {w} LIKE '%es' AND length({w}) > 3 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) END, "
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3) END, "
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN concat(left({w}, length({w}) - 3), 'e') END, "
        f"CASE WHEN {w} RLIKE '(.)\\\\1ing$' AND length({w}) > 5 THEN left({w}, length({w}) - 4) END))"
    )


def route_questions(questions: DataFrame) -> DataFrame:
    """Words of each question, the topics it reaches and whether it is about a trail at all."""
    q = questions.withColumn("words", F.expr(words_sql("question")))
    q = q.withColumn("routing", F.expr(f"array_distinct(flatten(transform(words, w -> {_stems_sql('w')})))"))
    topics = F.array_compact(
        F.array(*[F.when(F.arrays_overlap("routing", text.listed(words.split())), topic) for topic, words in TOPIC_WORDS.items()])
    )
    return q.withColumns(
        {
            "topics": topics,
            "in_domain": F.arrays_overlap("routing", text.listed(DOMAIN_WORDS)),
            "wants_reason": F.arrays_overlap("routing", text.listed(REASON_WORDS)),
            "wants_all": F.arrays_overlap("routing", text.listed(ALL_WORDS)),
        }
    )


def intents(questions: DataFrame) -> DataFrame:
    """Up to three topics a question names, purchase first."""
    q = questions.withColumn("words", F.expr(words_sql("question")))
    named = {"products": PURCHASE_WORDS, **{k: v.split() for k, v in INTENTS.items()}}
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap("words", text.listed(w)), k) for k, w in named.items()]))
    return q.withColumn("intents", F.slice(found, 1, 3))


def score_passages(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Every passage of the asked trail that the question reaches, with its score.

    The boost ranks passages; only words or topics admit them.
    """
    q = route_questions(questions).where(F.col("in_domain") & (F.size("words") > 0))
    p = passages.withColumn("passage_words", F.expr(words_sql("text")))
    met = q.join(p, "trail_id")
    overlap = F.size(F.array_intersect("words", "passage_words")).cast("double")
    on_topic = F.array_contains("topics", F.col("topic"))
    reason = F.col("wants_reason") & F.col("topic").isin(REASON_TOPICS)
    everything = F.col("wants_all") & F.col("topic").isin(ALL_TOPICS)
    hit = lambda test, points: F.when(test, points).otherwise(0.0)
    return met.where((overlap > 0) | on_topic | reason | everything).withColumn(
        "score", overlap + hit(on_topic, 3.0) + hit(reason, 2.0) + hit(everything, 3.5) + F.col("boost")
    )


def best_passages(scored: DataFrame, limit: int) -> DataFrame:
    keys = ["conv_id", "turn"]
    return skew.top_per_group(scored, keys, [F.col("score").desc(), F.col("text")], limit, "place")


def quarantine(passages: DataFrame) -> DataFrame:
    """Marks passages shaped like an instruction with the shape found; they are never quoted."""
    low = F.lower("text")
    shape = F.coalesce(*[F.when(F.contains(low, F.lit(s)), s) for s in INSTRUCTION_SHAPES])
    return passages.withColumns({"shape": shape, "usable": shape.isNull() & (F.length(F.trim("text")) > 0)})


def passages(assessed: DataFrame, gear: DataFrame) -> DataFrame:
    """Facts of every trail as (topic, text, source, boost); absent facts give no row."""
    c = F.col

    def fact(topic: str, source: str, boost: float, pattern: str, *values: str) -> Column:
        ready = F.lit(True)
        for value in values:
            ready = ready & c(value).isNotNull()
        body = text.filled(pattern, *[c(v) for v in values])
        return F.when(
            ready,
            F.struct(F.lit(topic).alias("topic"), body.alias("text"), F.lit(source).alias("source"), F.lit(boost).alias("boost")),
        )

    facts = [
        fact("identity", "map", 0.5, "This trail is map feature %d.", "feature_id"),
        fact("terrain", "measured", 1.0, "The route is %.1f km long.", "distance_km"),
        fact("terrain", "measured", 1.0, "The sampled ascent is %.0f m.", "gain_m"),
        fact("terrain", "measured", 1.0, "The steepest sampled section is %.1f percent.", "max_slope_pct"),
        fact("terrain", "map", 0.5, "The recorded surface is %s.", "surface"),
        fact("difficulty", "map", 1.5, "The recorded grade is %s.", "sac_scale"),
        fact("difficulty", "model", 1.0, "The estimated tier is %s.", "estimate_tier"),
        fact("condition", "inference", 1.5, "Current conditions are assessed as %s.", "condition_status"),
        fact("reasoning", "inference", 2.4, "The condition score is %d of 100.", "condition_score"),
        fact("suitability", "inference", 1.5, "The route is rated %s.", "suitability"),
    ]
    gaps = F.transform(
        "missing",
        lambda m: F.struct(
            F.lit("missing").alias("topic"), F.concat(F.lit("No data for "), F.replace(m, F.lit("_"), F.lit(" ")), F.lit(".")).alias("text"),
            F.lit("inference").alias("source"), F.lit(0.5).alias("boost"),
        ),
    )
    rows = assessed.select(c("feature_id").alias("trail_id"), F.inline(F.concat(F.array_compact(F.array(*facts)), gaps)))
    carried = gear.select(
        c("feature_id").alias("trail_id"), F.lit("gear").alias("topic"),
        F.concat("item", F.lit(" ("), "priority", F.lit(").")).alias("text"), F.lit("rules").alias("source"),
        F.when(c("priority") == "essential", 1.5).otherwise(1.0).alias("boost"),
    )
    return rows.unionByName(carried)


def item_terms(items: DataFrame) -> DataFrame:
    """(need, term): the words that identify an item, without its caveat."""
    phrase = F.trim(F.regexp_replace(F.lower("item"), r"[,:(].*$", ""))
    dropped = text.quoted(NON_DISTINCTIVE)
    return items.withColumn("phrase", phrase).select(
        "need",
        F.explode(F.expr(f"array_distinct(filter(regexp_extract_all(phrase, '([a-z0-9]+)', 1), w -> length(w) >= 4 AND w NOT IN ({dropped})))")).alias("term"),
    ).distinct()


def about(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """(need, page_id) where a word of the page starts with a word of the item.

    Page words are spread over their beginnings, so the prefix test is an equi-join.
    """
    words = pages.select("page_id", F.explode(F.expr("array_distinct(regexp_extract_all(lower(concat(title, ' ', content)), '([a-z0-9]+)', 1))")).alias("w"))
    starts = words.where(F.length("w") >= 4).select(
        "page_id", F.explode(F.expr("transform(sequence(4, length(w)), n -> left(w, n))")).alias("term")
    ).distinct()
    return starts.join(terms, "term").select("need", "page_id").distinct()


def triage(results: DataFrame, matched: DataFrame) -> DataFrame:
    """Per item and result: product (first 3), related (first 2), or rejected with a reason."""
    r = results.join(matched.withColumn("about", F.lit(True)), ["need", "page_id"], "left")
    kind = (
        F.when(F.col("off_topic"), "off_topic")
        .when(F.col("is_product"), "product")
        .when(F.col("about"), "related")
        .otherwise("unrelated")
    )
    placed = skew.position(r.withColumn("kind", kind), ["need", "kind"], [F.col("page_id")], "place")
    shown = (
        F.when((F.col("kind") == "product") & (F.col("place") <= 3), "product")
        .when((F.col("kind") == "product") & F.col("about"), "related")
        .when(F.col("kind") == "related", "related")
    )
    reason = F.when(F.col("kind") == "off_topic", "unrelated product category").when(
        shown.isNull(), "not about this preparation item"
    )
    return placed.select("need", "page_id", shown.alias("shown_as"), reason.alias("rejected_because"))


def cards(triaged: DataFrame) -> DataFrame:
    """One card per item: its direct product, or a fallback, and how much was found."""
    return triaged.groupBy("need").agg(
        F.min(F.when(F.col("shown_as") == "product", F.col("page_id"))).alias("direct_page"),
        F.count_if(F.col("shown_as") == "product").alias("products"),
        F.least(F.count_if(F.col("shown_as") == "related"), F.lit(2).cast("long")).alias("related"),
        F.count("rejected_because").alias("rejected"),
    ).withColumn(
        "status",
        F.when(F.col("products") > 0, "products_found").when(F.col("related") > 0, "related_only").otherwise("fallback_link"),
    )
