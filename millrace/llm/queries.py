"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions.normal import bare_uuid, label, source_name
from millrace.functions.times import DAY_MS, day_text, floor_div, millis
from millrace.llm import distinct, leakage, mixing, stuffing, topn
from millrace.session import broadcast_up_to, cut_lineage, spread

NONE = "(none)"


def _day(column: str) -> Column:
    return day_text(floor_div(millis(F.col(column)), DAY_MS))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "auction").where("a_id IS NOT NULL").groupBy(F.col("a_id").alias("auction")).agg(F.max("category").alias("category"))


def _bid_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Bitmaps of bidders and auctions per day and category.

    Bids are reduced to their bitmap words per auction and day before they meet the auction's category, so a hot auction
    is no hotter than the words of its days.
    """
    bid = table(spark, d, "bid").where("b_date_time IS NOT NULL").select("auction", _day("b_date_time").alias("day"), "bidder")
    words = distinct.with_cell(bid, F.col("bidder")).select("auction", "day", "cell.slice", "cell.word", "cell.mask")
    words = words.groupBy("auction", "day", "slice", "word").agg(F.bit_or("mask").alias("mask"))
    told = words.join(_categories(spark, d), "auction", "left").withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit(NONE)))
    told = distinct.with_cell(told, F.col("auction"), "own")
    both = F.array(
        F.struct(F.lit("bid.bidder").alias("field"), F.when(F.col("slice").isNotNull(), F.struct("slice", "word", "mask")).alias("cell")),
        F.struct(F.lit("bid.auction").alias("field"), F.col("own").alias("cell")),
    )
    return distinct.bitmaps(told.select("day", "category", F.explode(both).alias("x")).select("x.field", "day", "category", "x.cell"), ["field", "day", "category"])


def _ads(spark: SparkSession, d: str) -> DataFrame:
    """Ad events with a time and a user: day, labels, campaign and user; an ad of several campaigns counts in the first by id alone."""
    campaign = table(spark, d, "campaign").select(bare_uuid(F.col("c_ad_id")).alias("ad"), bare_uuid(F.col("campaign_id")).alias("campaign")).where("ad IS NOT NULL")
    campaign = broadcast_up_to(campaign.groupBy("ad").agg(F.min("campaign").alias("campaign")), 100_000)
    ads = table(spark, d, "ad_event").where("event_time IS NOT NULL AND user_id IS NOT NULL").select(
        _day("event_time").alias("day"), label(F.col("ad_type")).alias("ad_type"), label(F.col("event_type")).alias("event_type"), bare_uuid(F.col("ad_id")).alias("ad"), bare_uuid(F.col("user_id")).alias("user")
    )
    told = ads.where("user IS NOT NULL").join(campaign, "ad", "left")
    return told.select("day", *(F.coalesce(c, F.lit(NONE)).alias(c) for c in ("ad_type", "event_type", "campaign")), "user")


def _ad_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Bitmaps of users per day, ad type, event type and campaign."""
    dims = ["day", "ad_type", "event_type", "campaign"]
    return distinct.bitmaps(distinct.with_cell(_ads(spark, d), F.col("user")), dims)


def p1_distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    """Estimates per field for every combination of day and groups; ``*`` stands for all values of a group."""
    every = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    bids = ["field", "day", "category"]
    one = distinct.estimates(distinct.roll_up(_bid_bitmaps(spark, d), bids, [["field", *s] for s in distinct.combinations(bids[1:])]), bids)
    ads = ["day", "ad_type", "event_type", "campaign"]
    two = distinct.estimates(distinct.roll_up(_ad_bitmaps(spark, d), ads, distinct.combinations(ads)), ads)
    one = one.select("field", every("day"), every("category"), *(F.lit("*").alias(c) for c in ads[1:]), "estimate")
    two = two.select(F.lit("ad_event.user_id").alias("field"), every("day"), F.lit("*").alias("category"), *(every(c) for c in ads[1:]), "estimate")
    return one.unionByName(two).withColumn("standard_error", F.lit(distinct.STANDARD_ERROR))



_P1_COLUMNS = ["field", "day", "category", "ad_type", "event_type", "campaign"]


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of different ids of every combination, and whether p1_distinct_ids is within four standard errors of it, or (small sets, where each collision is whole) three ids."""
    every = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    bid = table(spark, d, "bid").where("b_date_time IS NOT NULL").select("auction", _day("b_date_time").alias("day"), "bidder").distinct()
    told = bid.join(_categories(spark, d), "auction", "left").withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit(NONE)))
    ids = F.explode(F.array(F.struct(F.lit("bid.bidder").alias("field"), F.col("bidder").alias("id")), F.struct(F.lit("bid.auction").alias("field"), F.col("auction").alias("id"))))
    bids = told.select("day", "category", ids.alias("x")).select("x.field", "day", "category", "x.id").where("id IS NOT NULL").distinct()
    one = bids.groupingSets([[F.col(c) for c in ("field", *s)] for s in distinct.combinations(["day", "category"])], F.col("field"), F.col("day"), F.col("category"))
    one = one.agg(F.count_distinct("id").alias("exact")).select("field", every("day"), every("category"), *(F.lit("*").alias(c) for c in _P1_COLUMNS[3:]), "exact")
    dims = ["day", *_P1_COLUMNS[3:]]
    ads = _ads(spark, d).select(*dims, "user").distinct()
    two = ads.groupingSets([[F.col(c) for c in s] for s in distinct.combinations(dims)], *(F.col(c) for c in dims)).agg(F.count_distinct("user").alias("exact"))
    two = two.select(F.lit("ad_event.user_id").alias("field"), every("day"), F.lit("*").alias("category"), *(every(c) for c in _P1_COLUMNS[3:]), "exact")
    estimates = p1_distinct_ids(spark, d)
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(3.0), 4 * F.col("standard_error") * F.col("exact"))
    return one.unionByName(two).join(estimates, _P1_COLUMNS, "full").select(*_P1_COLUMNS, "exact", within.alias("within"))


_ORDER = [("price", True), ("b_date_time", False), ("bid_id", False)]


def _ranked_bids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bid").select("auction", "price", "b_date_time", "bid_id").where("auction IS NOT NULL AND price IS NOT NULL")


def _best_by_category(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The best bids of each category.

    Each auction's highest price stands for one bid, so a histogram of these prices per category gives a safe threshold
    before any bid meets its category, if it holds n auctions at or above it. Only auctions that reach it can hold a winner, and of
    these only bids that reach it. A category without so many auctions has no threshold: all its bids are ranked.
    """
    bids = _ranked_bids(spark, d)
    best = bids.groupBy("auction").agg(F.max("price").alias("price"))
    category = table(spark, d, "auction").where("a_id IS NOT NULL AND category IS NOT NULL").groupBy(F.col("a_id").alias("auction")).agg(F.max("category").alias("category"))
    told = best.join(category, "auction")
    cut = topn.thresholds(topn.histogram(told, "category", "price", "auction"), "category", n, partial=True)
    reach = told.join(cut, "category").where(topn.bucket(F.col("price")) >= F.col("threshold")).select("auction", "category", "threshold")
    reach = broadcast_up_to(cut_lineage(reach), 200_000)
    high = bids.join(reach, "auction").where(topn.bucket(F.col("price")) >= F.col("threshold"))
    return topn.rank(high, "category", _ORDER, "bid_id", n, shards=64)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    by_auction = topn.top_n(_ranked_bids(spark, d), "auction", "price", _ORDER, "bid_id", 3)
    by_category = _best_by_category(spark, d, 10)
    shape = lambda df, level: df.select(F.lit(level).alias("level"), F.col(level).alias("group_key"), F.col("place").cast("long").alias("place"), "bid_id")
    return shape(by_auction, "auction").unionByName(shape(by_category, "category"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_item"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 20 words with one word changed, dropped or put in, or none."""
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_item"), leakage.Settings(edits=1))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn to meet mix_target, with their copies."""
    return mixing.mixed(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that p9_mix reaches."""
    return mixing.mixed(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_target"))[1]


def p9_tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the mix that is as even as mix_target, by one exponent of the sources' own shares."""
    return mixing.mixed(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_target"), towards_targets=False)[1]


def p9_tempered_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for p9_tempered_shares, with their copies."""
    return mixing.mixed(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_target"), towards_targets=False)[0]


def _limits(spark: SparkSession, d: str, towards_targets: bool) -> DataFrame:
    """Per source of mix_target: its documents, and whether what was drawn of it keeps its limits.

    within_repeats: no document is drawn more than max_repeats times, and none twice; within_document: the tokens drawn are those of
    its budget but for one document; own: all drawn are documents of this source.
    """
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    drawn, shares = mixing.mixed(spread(documents), table(spark, d, "mix_target"), towards_targets=towards_targets)
    got = drawn.groupBy("source").agg(F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows"), F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    known = documents.select("doc_id", source_name(F.col("source")).alias("source"))
    foreign = drawn.select("doc_id", "source").join(known, ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count("*").alias("foreign"))
    both = shares.join(got, "source", "left").join(foreign, "source", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "source",
        F.col("documents"),
        ((none("most") <= F.col("max_repeats")) & (none("ids") == none("rows"))).alias("within_repeats"),
        (F.abs(F.col("drawn") - F.col("budget")) <= none("longest")).alias("within_document"),
        (none("foreign") == 0).alias("own"),
    )


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits that p9_mix keeps."""
    return _limits(spark, d, True)


def p9_tempered_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits that p9_tempered_mix keeps."""
    return _limits(spark, d, False)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of every document, and those that return within it."""
    return stuffing.text_counts(table(spark, d, "documents"))


def p10_count_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """How many different words and pairs of neighbours the corpus has, by how often they occur."""
    return stuffing.count_spectrum(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_distinct_ids, p1_within_bound, p7_found, p8_found, p8_near, p9_mix, p9_shares, p9_limits, p9_tempered_mix, p9_tempered_shares, p9_tempered_limits, p10_found, p10_scores, p10_count_spectrum)}

_P8 = """
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') FROM eval_item WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 19], ' ') AS passage FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20))
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM windows a JOIN windows b ON a.passage = b.passage WHERE a.kind = 0 AND b.kind = 1
"""

#: One of the halves of an item's window is untouched by one edit; the other is held against 9 to 11 words beside it.
_P8_NEAR = """
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') FROM eval_item WHERE text IS NOT NULL),
docs AS (SELECT id, w, i, array_to_string(w[i : i + 9], ' ') AS ten FROM (SELECT *, unnest(range(1, len(w) - 8)) AS i FROM words WHERE kind = 0 AND len(w) >= 10)),
items AS (SELECT DISTINCT id, w[i : i + 9] AS one, w[i + 10 : i + 19] AS two FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM words WHERE kind = 1 AND len(w) >= 20)),
pairs AS (
  SELECT d.id AS doc_id, t.id AS item_id, t.two AS r, d.w[d.i + 10 : d.i + 20] AS x FROM docs d JOIN items t ON d.ten = array_to_string(t.one, ' ')
  UNION ALL
  SELECT d.id, t.id, list_reverse(t.one), list_reverse(d.w[greatest(d.i - 11, 1) : d.i - 1]) FROM docs d JOIN items t ON d.ten = array_to_string(t.two, ' '))
SELECT DISTINCT doc_id, item_id FROM pairs WHERE r = x[1:10] OR len(list_filter(range(0, 10), lambda i: r[1:i] = x[1:i] AND (
  (len(x) >= 10 AND r[i + 2 : 10] = x[i + 2 : 10]) OR (len(x) >= 9 AND r[i + 2 : 10] = x[i + 1 : 9]) OR (len(x) >= 11 AND r[i + 1 : 10] = x[i + 2 : 11])))) > 0
"""

_P10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (
    SELECT doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\r\n]') AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
held AS (SELECT doc_id, line_no, regexp_extract_all(line, '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM lines),
words AS (SELECT doc_id, unnest(w) AS k FROM held),
pairs AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM held)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LABEL = f"translate(lower(trim({{}}, {_BLANKS})), '_ ', '--')"
_UUID = f"translate(lower({{0}}), '-{{{{}}}}' || {_BLANKS}, '')"
_ID = f"CASE WHEN length({_UUID}) = 32 THEN {_UUID} END"


def _sets(field: str, dims: list[str], source: str) -> str:
    """Exact counts of all combinations of dims."""
    all_of = ", ".join(f"CASE WHEN grouping({c}) = 1 THEN '*' ELSE {c} END AS {c}" if c in dims else f"'*' AS {c}" for c in _P1_COLUMNS[1:])
    return f"SELECT {field} AS field, {all_of}, count(DISTINCT id) AS exact, TRUE AS within FROM {source} GROUP BY " + ("CUBE" if field.startswith("'") else "field, CUBE") + f" ({', '.join(dims)})"


_P1 = f"""
WITH cats AS (SELECT a_id, max(category) AS category FROM auction WHERE a_id IS NOT NULL GROUP BY 1),
b AS (SELECT bidder, auction, strftime(b_date_time, '%Y-%m-%d') AS day, coalesce(CAST(category AS VARCHAR), '{NONE}') AS category FROM bid LEFT JOIN cats ON a_id = auction WHERE b_date_time IS NOT NULL),
bids AS (SELECT 'bid.bidder' AS field, day, category, bidder AS id FROM b WHERE bidder IS NOT NULL UNION ALL SELECT 'bid.auction', day, category, auction FROM b WHERE auction IS NOT NULL),
camp AS (SELECT {_ID.format("c_ad_id")} AS ad, min({_ID.format("campaign_id")}) AS campaign FROM campaign GROUP BY 1),
e AS (SELECT strftime(event_time, '%Y-%m-%d') AS day, {_LABEL.format("ad_type")} AS ad_type, {_LABEL.format("event_type")} AS event_type, {_ID.format("ad_id")} AS ad, {_ID.format("user_id")} AS id FROM ad_event WHERE event_time IS NOT NULL),
ads AS (SELECT day, coalesce(ad_type, '{NONE}') AS ad_type, coalesce(event_type, '{NONE}') AS event_type, coalesce(campaign, '{NONE}') AS campaign, id FROM e LEFT JOIN camp ON camp.ad = e.ad WHERE id IS NOT NULL)
{_sets("field", ["day", "category"], "bids")} UNION ALL {_sets("'ad_event.user_id'", ["day", "ad_type", "event_type", "campaign"], "ads")}"""

_P9_LIMITS = f"""
WITH named AS (SELECT translate(lower(trim(source, {_BLANKS})), '-', '_') AS source FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text != ''),
listed AS (SELECT DISTINCT translate(lower(trim(source, {_BLANKS})), '-', '_') AS source FROM mix_target WHERE source IS NOT NULL AND weight IS NOT NULL)
SELECT l.source, count(n.source) AS documents, TRUE AS within_repeats, TRUE AS within_document, TRUE AS own FROM listed l LEFT JOIN named n ON n.source = l.source GROUP BY l.source"""

SQL = {
    "p1_within_bound": _P1,
    "p9_limits": _P9_LIMITS,
    "p9_tempered_limits": _P9_LIMITS,
    "p10_scores": _P10
    + """, w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, CAST(coalesce(sum(n) FILTER (n >= 4), 0) AS BIGINT) AS returning_words FROM (SELECT doc_id, k, count(*) AS n FROM words GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS pairs, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS returning_pairs FROM (SELECT doc_id, k, count(*) AS n FROM pairs GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, coalesce(words, 0) AS words, coalesce(pairs, 0) AS pairs, coalesce(returning_words, 0) AS returning_words, coalesce(returning_pairs, 0) AS returning_pairs
FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id""",
    "p10_count_spectrum": _P10
    + """SELECT 'word' AS kind, times, count(*) AS different FROM (SELECT k, count(*) AS times FROM words GROUP BY k) GROUP BY times
UNION ALL SELECT 'pair', times, count(*) FROM (SELECT k, count(*) AS times FROM pairs GROUP BY k) GROUP BY times""",
    "p7_found": """
WITH bids AS (SELECT DISTINCT bid_id, auction, price, b_date_time FROM bid WHERE auction IS NOT NULL AND price IS NOT NULL),
cats AS (SELECT a_id, max(category) AS category FROM auction WHERE category IS NOT NULL GROUP BY 1),
a AS (SELECT auction AS k, bid_id, row_number() OVER (PARTITION BY auction ORDER BY price DESC, b_date_time ASC NULLS LAST, bid_id) AS place FROM bids),
c AS (SELECT category AS k, bid_id, row_number() OVER (PARTITION BY category ORDER BY price DESC, b_date_time ASC NULLS LAST, bid_id) AS place FROM bids JOIN cats ON a_id = auction)
SELECT 'auction' AS level, k AS group_key, place, bid_id FROM a WHERE place <= 3
UNION ALL SELECT 'category', k, place, bid_id FROM c WHERE place <= 10""",
    "p8_found": _P8,
    "p8_near": _P8_NEAR,
}
