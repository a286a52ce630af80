"""Search results: canonical URLs, safety, references, names in whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import text

# Vocabulary of candidate names.
TRAIL_WORDS = (
    "trail trails trek treks trekking hike hikes hiking route routes path paths footpath walk walking loop peak peaks "
    "summit ridge pass waterfall waterfalls falls mountain mountains hill hills mala shola circuit valley gorge canyon "
    "basecamp nature reserve sanctuary forest"
).split()
DESTINATION_WORDS = (
    "peak hill hills mala ridge valley waterfall waterfalls falls forest sanctuary cave lake pass gorge shola reservoir"
).split()
GENERIC_NAMES = [
    "hiking trails", "hiking trail", "trekking trails", "trekking trail", "trekking routes", "trekking route",
    "hiking routes", "hiking route", "hiking", "trekking", "nature trails", "nature trail", "trails", "trail", "treks",
    "trek", "hikes", "hike", "routes", "route", "walking routes", "walking route", "best trails", "top trails",
]
ROUTE_IDENTITY_WORDS = (
    "trail trails trek treks trekking hike hikes hiking loop circuit route routes path paths footpath walk walking track"
).split()
NON_TRAIL_WORDS = (
    "bus stand power house resort hotel homestay lodge cottage villa centre center academy hospital clinic temple church "
    "mosque dam tour tours travel travels adventure adventures camp camps camping package packages booking book guide "
    "guides operator company holiday trips trip crown palace estate tower market junction corner office bank atm parking "
    "gate entrance exit check post view roof bridge station village town city plantation factory warehouse college school "
    "university railway airport causeway bungalow"
).split()
SENTENCE_LEADS = (
    "a after all an and are as at be before best book but by check consider discover do during each embark enjoy explore "
    "for from get go going good great here how if in is it its join journey just know looking make many may more most much "
    "must need not now of on one only or pack perfect plan reach ready reaching read remember safety start take the their "
    "there these this those through to top try unlike until upon very visit want what when where which while why with you "
    "your"
).split()
CAPITALISED_RUN = r"\b([A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){0,3})\b"
EDITORIAL_NAME = r"(?i)\b(best|top\s+\d+|guide|tours?|packages?|booking|tips|near|around|trekking\s+in|hiking\s+in|buy)\b"
# Page shapes.
PRODUCT_MARKERS = ["/product/", "/products/", "/item/", "/items/", "/p/", "/dp/", "/buy/", "/shop/", "/store/"]
PRODUCT_KEYS = ["pid", "productid", "product_id", "itemid", "item_id", "sku", "pdp", "variantid"]
PRODUCT_ID_PATH = r"(^|/)(p|dp|prod|item)[-_]?(\d{4,})(\.|/|$)"
LISTING_PATH = r"(^|/)(itm|listing)/([^/]+/)?(\d{4,})(\.|/|$)"
EDITORIAL_TEXT = (
    r"\breview\b|\breviews\b|\bbuying guide\b|\bhow to (choose|buy|pick)\b|\b(best|top)\s+\d+\s+\w+|"
    r"\b(best|top)\b[^.]{0,40}\b20\d\d\b|\btested\b|\b\d{4}\s*:\s*tested\b|\bvs\.?\s+\w+|\bversus\b|"
    r"\bcompared?\s+(to|with)\b|\broundup\b|\bwhat (is|are)\b|\bdeal of the day\b"
)
EDITORIAL_SEGMENTS = "blog blogs review reviews guide guides article articles news magazine expert-advice".split()
OFF_TOPIC = [
    "equestrian", "horse", "equine", "pony", "stable", "saddle", "bridle", "veterinary", "vet ", "dog ", "cat ",
    "aquarium", "cattle", "livestock",
]
MAX_URL_LENGTH = 2048

_URL = r"^([^:/?#]*):?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no fragment, no trailing slash."""
    clean = F.trim(url)
    path = F.regexp_replace(F.regexp_replace(_piece(clean, 4), "/+", "/"), "/+$", "")
    asked = _piece(clean, 6)
    return F.concat(
        F.lower(_piece(clean, 1)), F.lit("://"), F.lower(_piece(clean, 3)),
        F.when(path == "", "/").otherwise(path),
        F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""),
    )


def is_safe(url: Column) -> Column:
    """An absolute web link with a host, without credentials or control characters."""
    clean = F.trim(url)
    host = _piece(clean, 3)
    ok = (
        F.length(clean).between(1, MAX_URL_LENGTH)
        & ~clean.rlike(r"[\x00-\x1f]")
        & F.lower(_piece(clean, 1)).isin("http", "https")
        & (host != "")
        & ~F.contains(host, F.lit("@"))
    )
    return F.coalesce(ok, F.lit(False))


def clean_urls(results: DataFrame) -> DataFrame:
    """Results with canonical URL, safety flag and the map feature the URL names."""
    url = canonical_url(F.col("url"))
    feature = r"(?i)openstreetmap\.org/(relation|way)/(\d+)"
    ref = F.expr("try_cast(nullif(_ref, '') AS BIGINT)")
    return results.withColumns(
        {
            "canonical_url": F.when(F.length(F.trim("url")) > 0, url).otherwise(""),
            "safe": is_safe(F.col("url")),
            "_kind": F.lower(F.regexp_extract("url", feature, 1)),
            "_ref": F.regexp_extract("url", feature, 2),
        }
    ).withColumns(
        {
            "ref_type": F.when(ref > 0, F.col("_kind")),
            "ref_id": F.when(ref > 0, ref),
        }
    ).drop("_kind", "_ref")


def merge_results(results: DataFrame, cap: int) -> DataFrame:
    """For each place the results of all its queries in query order, each page once, cut at the
    report's size."""
    order = [F.col("query_no"), F.col("rank")]
    once = skew.top_per_group(results, ["place_id", "canonical_url"], order, 1)
    return skew.top_per_group(once, ["place_id"], order, cap)


def classify(results: DataFrame) -> DataFrame:
    """Product page, editorial and off-topic flags from URL shape and text."""
    low = F.lower(F.col("url"))
    path, asked = F.lower(_piece(F.col("url"), 4)), F.lower(_piece(F.col("url"), 6))
    keyed = asked.rlike("|".join(f"{k}=" for k in PRODUCT_KEYS))
    product = (
        low.rlike("|".join(PRODUCT_MARKERS)) | keyed | path.rlike(PRODUCT_ID_PATH) | path.rlike(LISTING_PATH)
    )
    words = F.lower(F.concat("title", F.lit(". "), "content"))
    editorial = words.rlike(EDITORIAL_TEXT) | F.arrays_overlap(F.split(path, "/"), text.listed(EDITORIAL_SEGMENTS))
    return results.withColumns(
        {
            "is_product": product,
            "is_editorial": editorial,
            "off_topic": words.rlike("|".join(OFF_TOPIC)),
            "retailer": F.regexp_replace(F.lower(_piece(F.col("url"), 3)), r"^www\.", ""),
            "clean_title": F.trim(F.regexp_replace("title", r"\s+", " ")),
        }
    )


def names_in(results: DataFrame) -> DataFrame:
    """Trail names from titles, else from capitalised runs of the whole body.

    Every test is a column function; a page's runs are exploded, never looped over.
    """
    titled = results.withColumn(
        "part", F.explode(F.array_append(F.split("title", r"\s+[|\-–—]\s+"), F.col("title")))
    )

    def tested(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.withColumn("name", F.trim(F.regexp_replace(F.col(name), r"\s+", " "))).withColumn(
            "name_key", text.name_key("name")
        )
        keyed = keyed.withColumn("_w", F.split("name_key", " "))
        route = F.arrays_overlap("_w", text.listed(TRAIL_WORDS))
        place = F.arrays_overlap("_w", text.listed(DESTINATION_WORDS))
        facility = F.arrays_overlap("_w", text.listed(NON_TRAIL_WORDS)) & ~F.arrays_overlap(
            "_w", text.listed(ROUTE_IDENTITY_WORDS)
        )
        return keyed.where(
            F.length("name").between(3, 160) & route & ~facility
            & ~F.col("name_key").isin(GENERIC_NAMES)
            & ~F.col("name").rlike(EDITORIAL_NAME)
            & ~F.col("name_key").rlike(r"^(\d+ )?(best|top|great)\b|^\d+ \w+")
            & ~(F.col("name").rlike(r"(?i)\b(trekking|hiking)\b") & ~place)
        ).drop("_w")

    from_title = tested(titled, "part").select("page_id", "name", "name_key").distinct()
    rest = results.join(from_title.select("page_id").distinct(), "page_id", "left_anti")
    runs = rest.withColumn("run", F.explode(F.regexp_extract_all("content", F.lit(CAPITALISED_RUN), F.lit(1))))
    lead = F.lower(F.get(F.split("run", r"\s+"), F.lit(0)))
    many = runs.where(F.col("run").rlike(r"\s") & ~lead.isin(SENTENCE_LEADS))
    from_body = tested(many, "run").select("page_id", "name", "name_key").distinct()
    found = from_title.withColumn("found_in", F.lit("title")).unionByName(
        from_body.withColumn("found_in", F.lit("body"))
    )
    return skew.top_per_group(found, ["name_key"], [F.col("found_in").desc(), F.col("page_id"), F.col("name")], 1)


def prefer_first(first: DataFrame, second: DataFrame, cap: int) -> DataFrame:
    """For each place the candidates of the first source, then those of the second with a new name,
    cut at a cap."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    keyed = both.withColumn("name_key", text.name_key("name")).where(F.col("name_key") != "")
    once = skew.top_per_group(keyed, ["place_id", "name_key"], [F.col("src"), F.col("candidate_id")], 1)
    kept = once.unionByName(
        # The first source keeps its own repeats: only later sources are compared by name.
        keyed.where(F.col("src") == 0).join(once.select("candidate_id", "src"), ["candidate_id", "src"], "left_anti")
    )
    return skew.top_per_group(kept, ["place_id"], [F.col("src"), F.col("candidate_id")], cap).select(
        "place_id", "candidate_id", "name", F.when(F.col("src") == 0, "model").otherwise("rules").alias("source")
    )


def supported(candidates: DataFrame, listed: DataFrame, results: DataFrame) -> DataFrame:
    """Proposed names kept only when a source they list is a result that mentions them.

    ``listed`` has (candidate_id, url). The mention is tested on whole words of title and body, once
    for each name and address however many candidates share them.
    """
    pages = results.select("canonical_url", F.concat_ws(" ", "title", "content").alias("body"))
    pages = pages.groupBy("canonical_url", "body").agg(F.count(F.lit(1)).alias("times"))
    pages = pages.withColumn("body_key", F.concat(F.lit(" "), text.name_key("body"), F.lit(" ")))
    asked = listed.withColumn("canonical_url", canonical_url(F.col("url"))).join(
        candidates.select("candidate_id", text.name_key("name").alias("name_key")), "candidate_id"
    )
    mentions = (
        asked.select("canonical_url", "name_key").distinct()
        .join(pages, "canonical_url")
        .where(F.contains("body_key", F.concat(F.lit(" "), "name_key", F.lit(" "))))
        .groupBy("canonical_url", "name_key")
        .agg(F.sum("times").alias("times"))
    )
    met = asked.join(mentions, ["canonical_url", "name_key"]).groupBy("candidate_id").agg(F.sum("times").alias("sources"))
    return candidates.join(met, "candidate_id")
