"""Queries over facets, counts, rankings and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators import facets as O
from folioloom.operators import votes as V
from folioloom.plans.tables import WEEK, load, weekday

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_WEEK = ", ".join(f"('{d}', {i})" for i, d in enumerate(WEEK))
_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""
SELECT event_type, """ + ", ".join(f"count(*) FILTER (WHERE dayname(ts) = '{d}') AS {d.lower()}" for d in WEEK) + """
FROM events GROUP BY event_type""")
def weekday_heatmap(spark, sf_dir) -> DataFrame:
    """Events by type and weekday, zero where there are none."""
    e = load(spark, sf_dir, "events", "event_type", "ts").withColumn("day", weekday("ts"))
    grid = O.heat_map(e, "event_type", "day", WEEK)
    return grid.select("event_type", *[F.col(d).alias(d.lower()) for d in WEEK])


@query(f"""
SELECT d.day, d.position, coalesce(c.n, 0) AS n FROM (VALUES {_WEEK}) d(day, position)
LEFT JOIN (SELECT dayname(ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) c ON c.day = d.day""")
def weekday_counts(spark, sf_dir) -> DataFrame:
    """Errors by weekday, in the order of the week."""
    e = load(spark, sf_dir, "events", "event_type", "ts").where("event_type = 'error'")
    return O.in_fixed_order(O.counted(e.withColumn("day", weekday("ts")), "day"), "day", WEEK)


@query("""
SELECT event_type, day, n FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, day) AS k FROM (
    SELECT event_type, dayname(ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1""")
def top_weekday(spark, sf_dir) -> DataFrame:
    """The busiest weekday of each type; of equals the first as text."""
    e = load(spark, sf_dir, "events", "event_type", "ts").withColumn("day", weekday("ts"))
    return O.top_by_text(O.counted(e, "event_type", "day"), "event_type", "day", "n")


@query("""
SELECT day, position FROM (SELECT DISTINCT dayname(ts) AS day FROM events) e JOIN (VALUES """ + _WEEK + """) d(name, position) ON e.day = d.name""")
def weekday_order(spark, sf_dir) -> DataFrame:
    """The place of each weekday in a list of its own."""
    days = load(spark, sf_dir, "events", "ts").select(weekday("ts").alias("day")).distinct()
    return days.select("day", O.position_in(F.col("day"), WEEK).cast("int").alias("position"))


_SEARCHED = "english, spanish, zh, category_label, note"


@query(f"""
SELECT id, category, mention_count FROM term_stats
WHERE category = 'animal' AND contains(lower(concat_ws(' ', {_SEARCHED}, array_to_string(terms, ' '))), 'o')""")
def facet_search(spark, sf_dir) -> DataFrame:
    """one facet set, another at "all", and a substring search over all fields."""
    t = load(spark, sf_dir, "term_stats")
    fields = [F.col(c.strip()) for c in _SEARCHED.split(",")] + [F.array_join("terms", " ")]
    return t.where(O.facet(F.col("category"), "animal") & O.facet(F.col("id"), O.ALL) & O.search(fields, " O ")).select("id", "category", "mention_count")


@query("""
SELECT id, row_number() OVER (ORDER BY first_chapter, mention_count DESC, english, id) AS by_chapter,
  row_number() OVER (ORDER BY english, mention_count DESC, id) AS by_name,
  row_number() OVER (ORDER BY mention_count DESC, first_chapter, english, id) AS by_count FROM term_stats""")
def facet_sorted(spark, sf_dir) -> DataFrame:
    """O2: the three orders of terms."""
    t = load(spark, sf_dir, "term_stats", "id", "english", "mention_count", "first_chapter")
    orders = {"by_chapter": ["first_chapter", F.desc("mention_count"), "english", "id"], "by_name": ["english", F.desc("mention_count"), "id"], "by_count": [F.desc("mention_count"), "first_chapter", "english", "id"]}
    return t.select("id", *[F.row_number().over(Window.orderBy(*o)).alias(n) for n, o in orders.items()])


@query("""
SELECT id, list_transform(list_filter(chapters, lambda c: c.mention_count > 3), lambda c: c.chapter) AS chapters_often
FROM term_stats WHERE len(list_filter(chapters, lambda c: c.mention_count > 3)) > 0
  AND len(list_filter(chapters, lambda c: c.chapter = 6 AND c.mention_count > 0)) > 0""")
def nested_filter(spark, sf_dir) -> DataFrame:
    """terms present in chapter 6, with the chapters that mention them often."""
    t = load(spark, sf_dir, "term_stats", "id", "chapters").where(F.exists("chapters", lambda c: (c["chapter"] == 6) & (c["mention_count"] > 0)))
    return O.keep_nested(t, "chapters", lambda c: c["mention_count"] > 3).select("id", F.col("chapters.chapter").alias("chapters_often"))


@query("""
WITH c AS (SELECT category, sum(mention_count) AS total FROM term_stats GROUP BY 1)
SELECT category, CAST(total AS BIGINT) AS total, round(total / max(total) OVER (), 6) AS share,
  round(CASE WHEN total = 0 THEN 0 ELSE 0.12 + total / max(total) OVER () * 0.72 END, 6) AS intensity FROM c""")
def category_share(spark, sf_dir) -> DataFrame:
    """Mentions by category, as a share of the largest and as a strength of colour."""
    c = O.counted(load(spark, sf_dir, "term_stats"), "category", value=F.col("mention_count"), name="total")
    return O.share_of_most(c, "total", 0.12, 0.72).select("category", "total", "share", "intensity").withColumns({"share": F.round("share", 6), "intensity": F.round("intensity", 6)})


@query("""
WITH x AS (SELECT id, category, UNNEST(chapters) AS c FROM term_stats)
SELECT category, count(DISTINCT id) AS terms, count(DISTINCT c.chapter) AS chapters, CAST(sum(c.mention_count) AS BIGINT) AS mentions,
  array_to_string(list_sort(list(DISTINCT c.chapter)), ' ') AS coverage FROM x GROUP BY category""")
def coverage(spark, sf_dir) -> DataFrame:
    """Distinct terms and chapters, mentions, and the chapters in order."""
    x = load(spark, sf_dir, "term_stats").select("id", "category", F.inline("chapters"))
    return x.groupBy("category").agg(
        F.countDistinct("id").alias("terms"), F.countDistinct("chapter").alias("chapters"), F.sum("mention_count").alias("mentions"),
        F.array_join(F.array_sort(F.collect_set("chapter")), " ").alias("coverage"))


@query("""
SELECT id, mention_count, row_number() OVER (ORDER BY mention_count DESC, id) AS rank FROM term_stats QUALIFY rank <= 8""")
def ranking_top8(spark, sf_dir) -> DataFrame:
    """The eight terms mentioned most."""
    return O.ranking(load(spark, sf_dir, "term_stats", "id", "mention_count"), 8, F.desc("mention_count"), F.col("id"))


@query("""
WITH x AS (SELECT id, UNNEST(chapters) AS c FROM term_stats)
SELECT c.chapter AS chapter, CAST(sum(c.mention_count) AS BIGINT) AS total FROM x GROUP BY 1""")
def chapter_totals(spark, sf_dir) -> DataFrame:
    """A4: the sum over all terms, chapter by chapter."""
    return load(spark, sf_dir, "term_stats").select(F.inline("chapters")).groupBy("chapter").agg(F.sum("mention_count").alias("total"))


@query("""
WITH x AS (SELECT id, UNNEST(chapters) AS c FROM term_stats)
SELECT id, """ + ", ".join(f"CAST(coalesce(sum(c.mention_count) FILTER (WHERE c.chapter = {k}), 0) AS BIGINT) AS ch{k}" for k in range(1, 21)) + """
FROM x GROUP BY id""")
def term_pivot(spark, sf_dir) -> DataFrame:
    """Mentions by term and chapter 1 to 20."""
    x = load(spark, sf_dir, "term_stats").select("id", F.inline("chapters"))
    grid = O.heat_map(x, "id", "chapter", range(1, 21), F.col("mention_count"))
    return grid.select("id", *[F.col(str(k)).alias(f"ch{k}") for k in range(1, 21)])


@query("""
WITH x AS (SELECT id, category, UNNEST(chapters) AS c FROM term_stats)
SELECT category, c.chapter AS chapter, CAST(sum(c.mention_count) AS BIGINT) AS shown, CAST((SELECT sum(mention_count) FROM term_stats) AS BIGINT) AS every_mention
FROM x WHERE contains(lower(id), 'a') GROUP BY 1, 2""")
def facet_independence(spark, sf_dir) -> DataFrame:
    """a heat map honours the search but not its own axes; the total honours nothing."""
    t = load(spark, sf_dir, "term_stats")
    whole = t.agg(F.sum("mention_count").alias("every_mention"))
    shown = t.where(O.search([F.col("id")], "a")).select("category", F.inline("chapters")).groupBy("category", "chapter").agg(F.sum("mention_count").alias("shown"))
    return shown.crossJoin(F.broadcast(whole))  # one row


_PEAKS = """
WITH y AS (SELECT s_nationkey AS nation, year(l_shipdate) - 1992 AS k, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
g AS (SELECT n.n_nationkey AS nation, r.k, coalesce(y.n, 0) AS n FROM nation n CROSS JOIN range(0, 8) r(k) LEFT JOIN y ON y.nation = n.n_nationkey AND y.k = r.k),
p AS (SELECT nation, CAST(sum(n) AS BIGINT) AS total, max(n) AS peak_value, min(k) FILTER (WHERE n > 0) AS f, max(k) FILTER (WHERE n > 0) AS l FROM g GROUP BY 1)
SELECT p.nation, total, peak_value, CAST((SELECT min(k) + 1 FROM g WHERE g.nation = p.nation AND g.n = p.peak_value) AS INTEGER) AS peak,
  CAST(coalesce(f + 1, 0) AS INTEGER) AS first, CAST(coalesce(l + 1, 0) AS INTEGER) AS last FROM p"""


def _peaks(spark, sf_dir) -> DataFrame:
    li, s = load(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate"), load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    # Counted by supplier before the join: the fact table's rows stay where they are.
    by = li.groupBy("l_suppkey", (F.year("l_shipdate") - 1992).alias("k")).agg(F.count(F.lit(1)).alias("n")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    y = by.groupBy(F.col("s_nationkey").alias("nation")).pivot("k", list(range(8))).agg(F.sum("n"))
    every = load(spark, sf_dir, "nation", F.col("n_nationkey").alias("nation")).join(y, "nation", "left")
    counts = F.array(*[F.coalesce(F.col(str(k)), F.lit(0).cast("bigint")) for k in range(8)])
    return every.select("nation", counts.alias("counts")).select("nation", *O.peaks(F.col("counts")))


@query(_PEAKS)
def entity_peaks(spark, sf_dir) -> DataFrame:
    """Total, peak, first and last year of each nation's shipments."""
    return _peaks(spark, sf_dir)


@query(f"""
WITH q AS ({_PEAKS})
SELECT nation, row_number() OVER (ORDER BY total DESC, nation) AS by_total, row_number() OVER (ORDER BY peak_value DESC, total DESC, nation) AS by_peak,
  row_number() OVER (ORDER BY n_regionkey, total DESC, nation) AS by_generation, row_number() OVER (ORDER BY last DESC, total DESC, nation) AS by_last
FROM q JOIN nation ON n_nationkey = nation""")
def entity_sorted(spark, sf_dir) -> DataFrame:
    """O1: the four orders of entities."""
    p = _peaks(spark, sf_dir).join(load(spark, sf_dir, "nation", F.col("n_nationkey").alias("nation"), "n_regionkey"), "nation")
    orders = {"by_total": [F.desc("total"), "nation"], "by_peak": [F.desc("peak_value"), F.desc("total"), "nation"], "by_generation": ["n_regionkey", F.desc("total"), "nation"], "by_last": [F.desc("last"), F.desc("total"), "nation"]}
    return p.select("nation", *[F.row_number().over(Window.orderBy(*o)).alias(n) for n, o in orders.items()])  # a row for each nation


@query("""
SELECT category_label, CAST(row_number() OVER (ORDER BY category_label COLLATE zh) AS INTEGER) AS place FROM (SELECT DISTINCT category_label FROM term_stats WHERE category_label IS NOT NULL)""")
def collated_themes(spark, sf_dir) -> DataFrame:
    """Distinct labels in Chinese order."""
    t = load(spark, sf_dir, "term_stats", "category_label").where("category_label is not null").distinct()
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.collate("category_label", "zh"))))


@query("""
SELECT 'category' AS control, category AS value, count(*) AS n FROM term_stats GROUP BY 2
UNION ALL SELECT 'first_chapter', CAST(first_chapter AS VARCHAR), count(*) FROM term_stats GROUP BY 2""")
def option_lists(spark, sf_dir) -> DataFrame:
    """The values a control offers, with their counts."""
    t = load(spark, sf_dir, "term_stats", "category", "first_chapter")
    lists = {"category": O.counted(t.select(F.col("category").alias("value")), "value"), "first_chapter": O.counted(t.select(F.col("first_chapter").cast("string").alias("value")), "value")}
    return O.tagged_union(lists, "control").select("control", "value", "n")


@query("""
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN category = 'plant' AND id = 'heron' THEN 0 WHEN category = 'plant' THEN 1 ELSE 2 END, mention_count DESC, id) AS k FROM term_stats) WHERE k = 1""")
def selection_repair(spark, sf_dir) -> DataFrame:
    """The selected term isn't among the filtered ones, so the first of those is taken."""
    t = load(spark, sf_dir, "term_stats", "id", "category", "mention_count")
    return O.selected(t, O.facet(F.col("category"), "plant"), "id", "heron", F.desc("mention_count"), F.col("id")).select("id")


@query("""SELECT id, array_to_string(list_filter(terms, lambda t: lower(t) <> lower(english)), ', ') AS others FROM term_stats""")
def other_terms(spark, sf_dir) -> DataFrame:
    """the terms other than the headword."""
    return load(spark, sf_dir, "term_stats", "id", "english", "terms").select("id", F.array_join(F.filter("terms", lambda t: F.lower(t) != F.lower("english")), ", ").alias("others"))


@query("""SELECT work_id, count(*) FILTER (WHERE length(text) > 180) AS long_rows, count(*) AS n_rows FROM (SELECT DISTINCT paragraph_id, work_id, text FROM paragraphs) GROUP BY work_id""")
def long_flags(spark, sf_dir) -> DataFrame:
    """texts over 180 characters."""
    p = load(spark, sf_dir, "paragraphs", "paragraph_id", "work_id", "text")
    return p.groupBy("work_id").agg(F.count_if(F.length("text") > 180).alias("long_rows"), F.count(F.lit(1)).alias("n_rows"))


@query("""
WITH t AS (SELECT UNNEST(chapters) AS c FROM term_stats), s AS (SELECT c.chapter AS chapter, sum(c.mention_count) AS v FROM t GROUP BY 1),
o AS (SELECT chapter, v, row_number() OVER (ORDER BY chapter) - 1 AS i, count(*) OVER () AS n, max(v) OVER () AS m FROM s)
SELECT chapter, round(40 + 560.0 * i / greatest(n - 1, 1), 4) AS x, round(20 + 200 - v / m * 200.0, 4) AS y, (i % 2 = 0 OR i = n - 1) AS labelled FROM o""")
def chart_points(spark, sf_dir) -> DataFrame:
    """The points of a line chart, and which of them carry labels."""
    s = load(spark, sf_dir, "term_stats").select(F.inline("chapters")).groupBy("chapter").agg(F.sum("mention_count").alias("v"))
    all_ = Window.partitionBy()
    o = s.select("chapter", "v", (F.row_number().over(Window.orderBy("chapter")) - 1).alias("i"), F.count(F.lit(1)).over(all_).alias("n"), F.max("v").over(all_).alias("m"))
    return o.select("chapter", F.round(40 + F.lit(560.0) * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)), 4).alias("x"), F.round(220 - F.col("v") / F.col("m") * 200.0, 4).alias("y"), ((F.col("i") % 2 == 0) | (F.col("i") == F.col("n") - 1)).alias("labelled"))


@query("""
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id""")
def first_wins(spark, sf_dir) -> DataFrame:
    """The first event of each user."""
    f = O.first_per_key(load(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return f.select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))


@query("""
SELECT 'open' AS scope, o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 2
UNION ALL SELECT 'done', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""")
def scope_union(spark, sf_dir) -> DataFrame:
    """Two lists under one schema, told apart by a tag."""
    o = load(spark, sf_dir, "orders", "o_orderstatus", F.col("o_orderpriority").alias("priority"))
    parts = O.tagged_union({"open": o.where("o_orderstatus = 'O'"), "done": o.where("o_orderstatus = 'F'")}, "scope")
    return O.counted(parts, "scope", "priority")


@query("""
SELECT count(*) AS shared FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'error')""")
def anchor_intersect(spark, sf_dir) -> DataFrame:
    """The keys that two lists share."""
    e = load(spark, sf_dir, "events", "user_id", "event_type")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id")).agg(F.count(F.lit(1)).alias("shared"))


@query("""
WITH r AS (SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 1e9), a AS (SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 40)
SELECT * FROM r UNION ALL SELECT * FROM a WHERE (SELECT count(*) FROM r) < 10""")
def conditional_concat(spark, sf_dir) -> DataFrame:
    """Too few rows of the first kind, so the second kind comes as well."""
    e = load(spark, sf_dir, "events", "event_id", "event_type", "value").where("event_type = 'purchase'")
    return O.with_fallback(e.where("value > 1e9").select("event_id"), e.where("value > 40").select("event_id"), 10)


_SUMMARY = """
WITH l AS (SELECT lang, length(text) AS n FROM (SELECT DISTINCT paragraph_id, lang, text FROM paragraphs)),
o AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM l)
SELECT lang, max(c) AS n, min(n) AS min, CAST(floor(median(n)) AS INTEGER) AS median, max(n) FILTER (WHERE i = least(c - 1, floor(c * 0.90::DOUBLE))) AS p90,
  max(n) FILTER (WHERE i = least(c - 1, floor(c * 0.95::DOUBLE))) AS p95, max(n) FILTER (WHERE i = least(c - 1, floor(c * 0.99::DOUBLE))) AS p99, max(n) AS max FROM o GROUP BY lang"""


@query(_SUMMARY)
def length_summary(spark, sf_dir) -> DataFrame:
    """Lengths of texts by language, with percentiles by place."""
    p = load(spark, sf_dir, "paragraphs", "paragraph_id", "lang", "text").select("lang", F.length("text").alias("length"))
    return O.length_summary(p, "lang", "length")


@query("""
SELECT event_type AS version, count(*) FILTER (WHERE value >= 50) AS aligned, count(*) FILTER (WHERE value < 50 AND value >= 10) AS review, count(*) FILTER (WHERE value < 10) AS unusable,
  round(avg(value), 6) AS mean_value, min(value) AS min_value, count(*) FILTER (WHERE value / 25 < 0.35 OR value / 25 > 2.2) AS outliers FROM events GROUP BY 1""")
def version_summary(spark, sf_dir) -> DataFrame:
    """States, mean, minimum and outliers by version."""
    e, v = load(spark, sf_dir, "events", "event_type", "value"), F.col("value")
    return e.groupBy(F.col("event_type").alias("version")).agg(
        F.count_if(v >= 50).alias("aligned"), F.count_if((v < 50) & (v >= 10)).alias("review"), F.count_if(v < 10).alias("unusable"),
        F.round(F.avg(v), 6).alias("mean_value"), F.min(v).alias("min_value"), F.count_if((v / 25 < 0.35) | (v / 25 > 2.2)).alias("outliers"))


@query("""SELECT usable, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS usable FROM events GROUP BY 1) GROUP BY 1""")
def usable_histogram(spark, sf_dir) -> DataFrame:
    """How many users have how many types."""
    e = load(spark, sf_dir, "events", "user_id", "event_type")
    return O.counted(e.groupBy("user_id").agg(F.countDistinct("event_type").alias("usable")), "usable", name="users")


@query("""
WITH w AS (SELECT UNNEST(list_filter([CASE WHEN l_discount > 0.08 THEN 'deep_discount' END, CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL)) AS warning FROM lineitem)
SELECT warning, count(*) AS n FROM w GROUP BY 1""")
def warning_counts(spark, sf_dir) -> DataFrame:
    """How often each flag is set."""
    li = load(spark, sf_dir, "lineitem", "l_discount", "l_quantity", "l_tax")
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "deep_discount"), F.when(F.col("l_quantity") > 45, "large"), F.when(F.col("l_tax") == 0, "untaxed")))
    return O.counted(li.select(F.explode(flags).alias("warning")), "warning")


@query("""
SELECT l_orderkey AS order_id, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ' ') AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def ordered_collect(spark, sf_dir) -> DataFrame:
    """A list in order, and a set, by key."""
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return li.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]), " ").alias("parts"),
        F.size(F.collect_set("l_returnflag")).cast("bigint").alias("flags"))


_ANSWERS = """
a AS (SELECT user_id AS session, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS question, ts, event_id, event_type AS chosen FROM events),
l AS (SELECT session, question, arg_max(chosen, (ts, event_id)) AS chosen FROM a GROUP BY 1, 2)"""


def _answers(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "props")
    q = (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("question")
    a = e.select(F.col("user_id").alias("session"), q, F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("chosen"))
    return V.last_answers(a).withColumn("appeared", F.array(*[F.lit(t) for t in _TYPES]))


@query(f"WITH {_ANSWERS} SELECT session, question, chosen FROM l")
def last_choices(spark, sf_dir) -> DataFrame:
    """A later choice replaces an earlier one."""
    return _answers(spark, sf_dir).select("session", "question", "chosen")


_VOTES = f"""{_ANSWERS}, c AS (SELECT question, version, count(*) FILTER (WHERE version = chosen) AS votes, count(*) AS appearances FROM l, (VALUES {', '.join(f"('{t}')" for t in _TYPES)}) t(version) GROUP BY 1, 2)"""


@query(f"WITH {_VOTES} SELECT * FROM c")
def vote_counts(spark, sf_dir) -> DataFrame:
    """Votes and appearances by question and version."""
    return V.counters(_answers(spark, sf_dir))


@query(f"""WITH {_VOTES}, s AS (SELECT version, sum(votes) AS v, sum(appearances) AS p FROM c GROUP BY 1)
SELECT t.version, CAST(coalesce(v, 0) AS BIGINT) AS votes, CAST(greatest(coalesce(v, 0), coalesce(p, 0)) AS BIGINT) AS appearances, CAST(coalesce(round(100.0 * v / nullif(greatest(v, p), 0)), 0) AS INTEGER) AS rate
FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('unseen')) t(version) LEFT JOIN s ON s.version = t.version""")
def preference_rates(spark, sf_dir) -> DataFrame:
    """A rate for every version, seen or not."""
    versions = spark.createDataFrame([(t,) for t in [*_TYPES, "unseen"]], "version string")
    return V.preference_rates(V.completed(V.counters(_answers(spark, sf_dir))), versions)


@query("""SELECT id FROM term_stats ORDER BY md5('s1' || id), id LIMIT 10""")
def sample_questions(spark, sf_dir) -> DataFrame:
    """Ten terms drawn by a seed."""
    return V.drawn(load(spark, sf_dir, "term_stats", "id"), "s1", 10, key="id").select("id")


@query("""SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY md5('s2' || id), id) AS k FROM term_stats) WHERE k <= 3""")
def sample_options(spark, sf_dir) -> DataFrame:
    """Three terms of each category drawn by a seed."""
    return V.drawn(load(spark, sf_dir, "term_stats", "category", "id"), "s2", 3, "category", key="id").select("category", "id")


@query("""
WITH c AS (SELECT o_custkey, list(o_totalprice) AS likes FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(round(list_max(likes), 2), 0) AS top_likes, coalesce(round(list_sum(list_sort(likes)), 2), 0) AS all_likes FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def comment_likes(spark, sf_dir) -> DataFrame:
    """The largest and the sum of a nested list, 0 if it is empty."""
    c = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_totalprice")).alias("likes"))
    total = F.aggregate("likes", F.lit(0.0), lambda s, x: s + x)
    return load(spark, sf_dir, "customer", "c_custkey").join(c, "c_custkey", "left").select(
        "c_custkey", F.coalesce(F.round(F.array_max("likes"), 2), F.lit(0.0)).alias("top_likes"), F.coalesce(F.round(total, 2), F.lit(0.0)).alias("all_likes"))


@query("""
SELECT doc_id, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS by_likes, row_number() OVER (ORDER BY work_id, kind, doc_id) AS by_place FROM documents""")
def passage_sort(spark, sf_dir) -> DataFrame:
    """The orders of passages, with null counted as 0.

    Places come from range-partitioned ranks, so no task sorts all rows.
    """
    d = load(spark, sf_dir, "documents", "doc_id", "n_chars", "work_id", "kind").withColumn("minus", -F.coalesce("n_chars", F.lit(0)))
    d = d.withColumn("_all", F.lit(1))
    from folioloom.operators.ranks import placed

    a = placed(d.select("_all", "doc_id", "minus"), ["_all"], ["minus", "doc_id"], "by_likes")
    b = placed(d.select("_all", "doc_id", "work_id", "kind"), ["_all"], ["work_id", "kind", "doc_id"], "by_place")
    return a.select("doc_id", "by_likes").join(b.select("doc_id", "by_place"), "doc_id")


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n_rows, count(*) FILTER (WHERE l_discount > 0.05) AS costly FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, sf_dir) -> DataFrame:
    """Counts by group, with totals."""
    li = load(spark, sf_dir, "lineitem", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_discount")
    return li.rollup("flag", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_discount") > 0.05).alias("costly"))


@query("""SELECT event_type, user_id, count(*) AS votes FROM events GROUP BY 1, 2""")
def vote_stream(spark, sf_dir) -> DataFrame:
    """The incremental fold of votes over a stream of files, read to its end."""
    from uuid import uuid4

    from folioloom.streaming import votes as S

    name = f"votes_{uuid4().hex}"
    S.run_once(S.vote_stream(S.file_stream(spark, sf_dir, "events"), "event_type", "user_id"), name, "complete")
    return spark.table(name)
