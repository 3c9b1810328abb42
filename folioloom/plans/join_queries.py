"""Queries over joins of ordered text, spans, alignment, matching and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import measures as M
from folioloom.functions import segment as S
from folioloom.functions import text as N
from folioloom.operators import align as A
from folioloom.operators import facets as O
from folioloom.operators import match as X
from folioloom.operators import rebalance as B
from folioloom.operators import relational as R
from folioloom.plans.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_S = "(SELECT DISTINCT sentence_id, chapter_id, lang, sent, text FROM sentences)"
_P = "(SELECT DISTINCT paragraph_id, work_id, version_id, chapter, lang, idx, text FROM paragraphs)"


@query("""
SELECT c_custkey AS source, max(o_orderkey) AS target FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def aligner_ids(spark, sf_dir) -> DataFrame:
    """An inner join in which each source keeps its last target."""
    c = load(spark, sf_dir, "customer", F.col("c_custkey").alias("id"), F.col("c_custkey").alias("source"))
    o = load(spark, sf_dir, "orders", F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("target"))
    return R.last_target(c, o, "id")


@query("""
WITH spine AS (SELECT version_id, textdoc_id AS pos, href FROM (SELECT DISTINCT textdoc_id, version_id, href FROM text_documents) WHERE href IS NOT NULL AND version_id IS NOT NULL),
toc AS (SELECT version_id, pos AS toc, href, 'label ' || pos AS label FROM spine WHERE pos % 3 = 0 UNION ALL SELECT version_id, pos + 1, href || '#missing', 'none' FROM spine WHERE pos % 7 = 0),
f AS (SELECT t.version_id, t.toc, t.label, s.pos AS first, lead(s.pos) OVER (PARTITION BY t.version_id ORDER BY t.toc) AS next FROM toc t JOIN spine s ON s.version_id = t.version_id AND s.href = t.href)
SELECT f.version_id, f.toc, f.label, f.first, f.next, count(*) AS files FROM f JOIN spine s ON s.version_id = f.version_id AND s.pos >= f.first AND (f.next IS NULL OR s.pos < f.next) GROUP BY ALL""")
def toc_ranges(spark, sf_dir) -> DataFrame:
    """The files from a contents entry to the next; entries that lead nowhere are passed over."""
    spine = load(spark, sf_dir, "text_documents", "textdoc_id", "version_id", "href").where("href is not null and version_id is not null").withColumnRenamed("textdoc_id", "pos")
    good = spine.where("pos % 3 = 0").select("version_id", F.col("pos").alias("toc"), "href", F.concat(F.lit("label "), "pos").alias("label"))
    bad = spine.where("pos % 7 = 0").select("version_id", (F.col("pos") + 1).alias("toc"), F.concat("href", F.lit("#missing")).alias("href"), F.lit("none").alias("label"))
    return R.ranges(good.unionByName(bad), spine, ["version_id"])


@query(f"""
WITH p AS (SELECT chapter_id, lang, sentence_id, row_number() OVER (PARTITION BY chapter_id, lang ORDER BY sent, sentence_id) AS place FROM {_S})
SELECT a.chapter_id, a.place, a.sentence_id AS zh_id, b.sentence_id AS en_id FROM p a JOIN p b ON a.chapter_id = b.chapter_id AND a.place = b.place WHERE a.lang = 'zh' AND b.lang = 'en'""")
def positional_zip(spark, sf_dir) -> DataFrame:
    """The n-th sentences of both sides."""
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent").withColumn("o", F.struct("sent", "sentence_id"))
    zh = s.where("lang = 'zh'").select("chapter_id", F.col("sentence_id").alias("zh_id"), F.col("o").alias("oz"))
    en = s.where("lang = 'en'").select("chapter_id", F.col("sentence_id").alias("en_id"), F.col("o").alias("oe"))
    return R.zipped(zh, en, ["chapter_id"], "oz", "oe").select("chapter_id", F.col("place").cast("bigint").alias("place"), "zh_id", "en_id")


@query("""
SELECT c_custkey, c_nationkey, o.o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def left_join_last_wins(spark, sf_dir) -> DataFrame:
    """Every customer, with the last order if there is one."""
    c = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    o = load(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return R.left_last(c, o, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "c_nationkey", F.col("o_orderkey").alias("last_order"))


@query("""
WITH a AS (SELECT DISTINCT work_id, chapter_order FROM chapter_models), v AS (SELECT id FROM versions WHERE include_in_quiz),
m AS (SELECT DISTINCT model_id, work_id, chapter_order, version_id, length(text) AS chars FROM chapter_models)
SELECT a.work_id, a.chapter_order, v.id AS version, m.model_id, m.chars FROM a CROSS JOIN v JOIN m ON m.work_id = a.work_id AND m.chapter_order = a.chapter_order AND m.version_id = v.id""")
def version_cross(spark, sf_dir) -> DataFrame:
    """Chapters by every version of the quiz, where the version has the chapter.

    The cross product with the small catalogue is folded into the join with the models.
    """
    m = load(spark, sf_dir, "chapter_models", "model_id", "work_id", "chapter_order", "version_id", F.length("text").alias("chars"))
    v = load(spark, sf_dir, "versions", F.col("id").alias("version_id"), "include_in_quiz").where("include_in_quiz").drop("include_in_quiz")
    a = m.select("work_id", "chapter_order").distinct()
    return a.join(m.join(F.broadcast(v), "version_id"), ["work_id", "chapter_order"]).select("work_id", "chapter_order", F.col("version_id").alias("version"), "model_id", "chars")


@query(f"""
WITH s AS (SELECT sentence_id, chapter_id, sent, text, coalesce(sum(length(text)) OVER (PARTITION BY chapter_id ORDER BY sent, sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {_S} WHERE lang = 'en'),
c AS (SELECT chapter_id, sum(length(text)) AS chars FROM s GROUP BY 1), t AS (SELECT sentence_id, chapter_id, start + length(text) / 2 AS mid FROM s),
a AS (SELECT sentence_id AS anchor_id, s.chapter_id, CASE WHEN sent % 2 = 0 THEN chars * 0.5 ELSE chars * 3.0 END AS target, 150.0 AS w FROM s JOIN c USING (chapter_id) WHERE sentence_id % 20 = 0),
d AS (SELECT anchor_id, t.sentence_id, abs(mid - target) AS dist, w, max(CASE WHEN abs(mid - target) <= w THEN 1 ELSE 0 END) OVER (PARTITION BY anchor_id) AS near, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(mid - target), t.sentence_id) AS k FROM a JOIN t USING (chapter_id))
SELECT anchor_id, sentence_id AS idx FROM d WHERE CASE WHEN near = 1 THEN dist <= w ELSE k <= 12 END""")
def band_join_knn(spark, sf_dir) -> DataFrame:
    """Sentences in a band around a position, or the twelve nearest; asked for every twentieth id."""
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text").where("lang = 'en'")
    run = Window.partitionBy("chapter_id").orderBy("sent", "sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.sum(F.length("text")).over(run), F.lit(0)).cast("double"))
    t = s.select("chapter_id", F.col("sentence_id").alias("idx"), "start", (F.col("start") + F.length("text")).alias("end"))
    c = s.groupBy("chapter_id").agg(F.sum(F.length("text")).alias("chars"))
    a = s.where("sentence_id % 20 = 0").join(c, "chapter_id").select(F.col("sentence_id").alias("anchor_id"), "chapter_id", F.when(F.col("sent") % 2 == 0, F.col("chars") * 0.5).otherwise(F.col("chars") * 3.0).alias("target"), F.lit(150.0).alias("window"))
    return X.band_candidates(a, t, ["chapter_id"])


@query("""
SELECT l_orderkey, l_linenumber, coalesce(s_nationkey, -1) AS nation, coalesce(chars, 1) AS chars FROM lineitem LEFT JOIN (SELECT s_suppkey, s_nationkey, length(s_name) AS chars FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey""")
def default_lookup(spark, sf_dir) -> DataFrame:
    """A lookup with defaults."""
    s = load(spark, sf_dir, "supplier", F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"), F.length("s_name").cast("bigint").alias("chars")).where("l_suppkey % 2 = 0")
    return R.lookup(load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey"), s, ["l_suppkey"], {"nation": -1, "chars": 1}).drop("l_suppkey")


@query("""
SELECT DISTINCT textdoc_id FROM text_documents WHERE version_id IN (SELECT id FROM versions WHERE include_in_quiz)""")
def usable_documents(spark, sf_dir) -> DataFrame:
    """A semi join."""
    v = load(spark, sf_dir, "versions", F.col("id").alias("version_id"), "include_in_quiz").where("include_in_quiz")
    return load(spark, sf_dir, "text_documents", "textdoc_id", "version_id").join(v, "version_id", "left_semi").select("textdoc_id")


@query("""
WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e FROM events WHERE event_type = 'view')
SELECT a.event_id AS a_id, b.event_id AS b_id, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def interval_overlap(spark, sf_dir) -> DataFrame:
    """Intervals of one user that overlap.

    Starts are put into buckets as wide as the longest interval, so each meets its own bucket
    and the two beside it instead of all of the user's intervals.
    """
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    wide = 7_200_000_000
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("a_id"), "user_id", F.col("s").alias("s1"), (F.col("s") + 3_600_000_000).alias("e1"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("b_id"), "user_id", F.col("s").alias("s2"), (F.col("s") + wide).alias("e2"))
    a = a.withColumn("k", F.explode(F.sequence(F.floor(F.col("s1") / wide) - 1, F.floor(F.col("e1") / wide))))
    b = b.withColumn("k", F.floor(F.col("s2") / wide))
    return a.join(b, ["user_id", "k"]).where("s1 < e2 and s2 < e1").select("a_id", "b_id", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("shared"))


def _best_span_sql(most: int, penalty: float) -> str:
    grams = "list_distinct(list_transform(range(1, greatest(length(quote) - 3, 1) + 1), lambda i: substring(quote, i, 4)))"
    return f"""
WITH s AS (SELECT chapter_id, sentence_id, row_number() OVER (PARTITION BY chapter_id ORDER BY sent, sentence_id) - 1 AS k, regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS t FROM {_S} WHERE lang = 'en'),
l AS (SELECT chapter_id, k, list(t) OVER (PARTITION BY chapter_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {most - 1} FOLLOWING) AS l FROM s),
p AS (SELECT chapter_id, k AS start, k + n AS stop, array_to_string(l[1:n], '') AS t FROM l, range(1, {most + 1}) r(n) WHERE n <= len(l)),
q AS (SELECT chapter_id, sentence_id AS quote_id, substring(t, 5) || substring(t, 1, 4) AS quote FROM s WHERE sentence_id % 20 = 0),
v AS (SELECT quote_id, start, stop, CASE WHEN contains(t, quote) THEN 1 WHEN contains(quote, t) THEN length(t) / length(quote)
  ELSE len(list_filter({grams}, lambda g: contains(t, g))) / len({grams}) END - (stop - start - 1) * {penalty} AS score FROM q JOIN p USING (chapter_id) WHERE quote <> '')
SELECT quote_id, CAST(start AS INTEGER) AS span_start, CAST(stop AS INTEGER) AS span_end, round(greatest(score, 0), 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, start, stop) = 1
UNION ALL SELECT quote_id, 0, 1, 0.0 FROM q WHERE quote = ''"""


def _best_span(spark, sf_dir, most: int, penalty: float) -> DataFrame:
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text").where("lang = 'en'")
    s = s.select("chapter_id", "sentence_id", F.struct("sent", "sentence_id").alias("o"), N.match_key(F.col("text")).alias("t"))
    # Whole sentences, their first letters at the end: no span holds them as they are.
    q = s.where("sentence_id % 20 = 0").select("chapter_id", F.col("sentence_id").alias("quote_id"), F.expr("concat(substring(t, 5), substring(t, 1, 4))").alias("quote"))
    found = X.best_span(q, X.spans(s, ["chapter_id"], "o", "t", most), ["chapter_id"], penalty)
    return found.select("quote_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("score", 6).alias("score"))


@query(_best_span_sql(3, 0.015))
def best_span(spark, sf_dir) -> DataFrame:
    """The 1 to 3 sentences that hold most of a quotation; asked for every twentieth id."""
    return _best_span(spark, sf_dir, 3, 0.015)


@query(_best_span_sql(4, 0.02))
def best_span_wide(spark, sf_dir) -> DataFrame:
    """The same over 1 to 4 sentences, with the other penalty."""
    return _best_span(spark, sf_dir, 4, 0.02)


@query(f"""
WITH s AS (SELECT chapter_id, sentence_id, row_number() OVER (PARTITION BY chapter_id ORDER BY sent, sentence_id) AS k, count(*) OVER (PARTITION BY chapter_id) AS n, text FROM {_S} WHERE lang = 'zh'),
o AS (SELECT chapter_id, k, text, (k - 1) / n AS a, k / n AS b, 0.31::DOUBLE AS wa, 0.44::DOUBLE AS wb FROM s), d AS (SELECT *, greatest(0, least(b, wb) - greatest(a, wa)) AS ov, abs((a + b) / 2 - (wa + wb) / 2) AS dist FROM o),
r AS (SELECT *, max(ov) OVER (PARTITION BY chapter_id) AS m, row_number() OVER (PARTITION BY chapter_id ORDER BY ov DESC, k) AS r1, row_number() OVER (PARTITION BY chapter_id ORDER BY dist, k) AS r2 FROM d)
SELECT chapter_id AS window_id, string_agg(text, chr(10) ORDER BY k) AS text FROM r WHERE CASE WHEN m > 0 THEN ov > 0 AND r1 <= 2 ELSE r2 = 1 END GROUP BY 1""")
def select_by_ratio(spark, sf_dir) -> DataFrame:
    """The two sentences that a window of positions covers most."""
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text").where("lang = 'zh'")
    w = Window.partitionBy("chapter_id")
    k, n = F.row_number().over(w.orderBy("sent", "sentence_id")), F.count(F.lit(1)).over(w)
    placed = s.select("chapter_id", k.alias("idx"), n.alias("n"), "text").select("chapter_id", "idx", "text", ((F.col("idx") - 1) / F.col("n")).alias("start_ratio"), (F.col("idx") / F.col("n")).alias("end_ratio"))
    windows = placed.select("chapter_id").distinct().select("chapter_id", F.col("chapter_id").alias("window_id"), F.lit(0.31).alias("w_start"), F.lit(0.44).alias("w_end"), F.lit(2).alias("most"))
    return X.select_by_ratio(placed, windows, ["chapter_id"]).select("window_id", "text")


# --- alignment ---------------------------------------------------------------------------


def _sides(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "chapters", "chapter_id", "zh", "en")
    empty = F.expr("cast(array() as array<struct<idx:int,source:string,text:string>>)")
    a, b = F.coalesce("zh", empty), F.coalesce("en", empty)
    order = lambda x: F.array_sort(F.transform(x, lambda p: F.struct(p["idx"].alias("idx"), p["text"].alias("text"))))
    return c.select("chapter_id", order(a).alias("a"), order(b).alias("b")).select(
        "chapter_id", F.col("a.idx").alias("ref_idx"), F.col("a.text").alias("ref"), F.col("b.idx").alias("target_idx"), F.col("b.text").alias("target"))


@query()
def align_dp(spark, sf_dir) -> DataFrame:
    """Paragraphs of both sides in pairs of groups, by dynamic programming."""
    p = A.align_pairs(_sides(spark, sf_dir), ["chapter_id"])
    return p.select("chapter_id", "pair", F.array_join("ref", " ").alias("ref"), F.array_join("target", " ").alias("target"), "cost")


@query()
def align_summary(spark, sf_dir) -> DataFrame:
    """Units and costly rows by chapter and in all."""
    from folioloom.sources.sinks import alignment_summary

    return alignment_summary(A.align_pairs(_sides(spark, sf_dir), ["chapter_id"]), "chapter_id")


@query()
def align_replicate(spark, sf_dir) -> DataFrame:
    """Each row gets its whole group of targets."""
    return A.align_groups(_sides(spark, sf_dir), ["chapter_id"], "zh", "en").select("chapter_id", "row", "ref", F.array_join("target", " ").alias("target"), "aligned")


@query()
def align_distribute(spark, sf_dir) -> DataFrame:
    """A group's sentences are shared out among its rows."""
    def split(text: str) -> list[str]:
        return S.closed_pieces(" ".join(text.split()), ".!?", "”’»\"')）]", frozenset(S.ABBREVIATIONS["western"].split()), False, False)

    return A.align_groups(_sides(spark, sf_dir), ["chapter_id"], "zh", "en", split=split).select("chapter_id", "row", "ref", F.array_join("target", " ").alias("target"), "aligned")


@query("""
WITH p AS (SELECT chapter_id, z.idx AS pair, z.text AS ref, CASE WHEN z.idx % 3 = 1 THEN 't' || z.idx END AS target FROM (SELECT chapter_id, UNNEST(zh) AS z FROM (SELECT DISTINCT chapter_id, zh FROM chapters))),
i AS (SELECT *, greatest(sum(CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY pair), 1) AS island FROM p)
SELECT chapter_id, min(pair) AS pair, string_agg(ref, '' ORDER BY pair) AS ref, coalesce(string_agg(target, ' ' ORDER BY pair), '') AS target FROM i GROUP BY chapter_id, island""")
def merge_empty(spark, sf_dir) -> DataFrame:
    """Rows without targets join the row before; leading ones the first that has some."""
    p = load(spark, sf_dir, "chapters", "chapter_id", "zh").select("chapter_id", F.inline("zh")).select(
        "chapter_id", F.col("idx").alias("pair"), F.array("text").alias("ref"),
        F.when(F.col("idx") % 3 == 1, F.array(F.concat(F.lit("t"), "idx"))).otherwise(F.expr("cast(array() as array<string>)")).alias("target"))
    return A.merge_empty(p, ["chapter_id"]).select("chapter_id", "pair", F.array_join("ref", "").alias("ref"), F.array_join("target", " ").alias("target"))


@query("""
SELECT chapter_id, place, side, text FROM (
  SELECT chapter_id, UNNEST(zh).text AS text, generate_subscripts(zh, 1) - 1 AS place, 0 AS side FROM (SELECT DISTINCT chapter_id, zh FROM chapters)
  UNION ALL SELECT chapter_id, UNNEST(en).text, generate_subscripts(en, 1) - 1, 1 FROM (SELECT DISTINCT chapter_id, en FROM chapters))""")
def interleaved(spark, sf_dir) -> DataFrame:
    """K5: both sides of a chapter, text by text."""
    empty = F.expr("cast(array() as array<string>)")
    c = load(spark, sf_dir, "chapters", "chapter_id", "zh", "en").select("chapter_id", F.coalesce("zh.text", empty).alias("zh"), F.coalesce("en.text", empty).alias("en"))
    return R.interleaved(c, ["chapter_id"], "zh", "en").withColumn("place", F.col("place").cast("bigint"))


@query("""
WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.label, a.vec_id AS source_id, b.vec_id AS target_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM n a JOIN n b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT label, source_id, target_id, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY c DESC, target_id) = 1""")
def cosine_mapping(spark, sf_dir) -> DataFrame:
    """The nearest vector of the other side, within a label."""
    e = load(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), "embedding", "label")
    return B.cosine_mapping(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "label").withColumn("cosine", F.round("cosine", 6))


@query()
def semantic_rebalance(spark, sf_dir) -> DataFrame:
    """Targets moved between neighbouring rows by an expected mapping.

    The mapping here gives each source paragraph the target paragraph at its relative place.
    """
    c = load(spark, sf_dir, "chapters", "chapter_id", "zh", "en").where("size(zh) > 0 and size(en) > 0")
    pairs = A.align_pairs(_sides(spark, sf_dir), ["chapter_id"]).where("ref_idx is not null and target_idx is not null")
    sizes = c.select("chapter_id", F.size("zh").alias("nz"), F.size("en").alias("ne"))
    expected = F.array_distinct(F.transform("ref_idx", lambda i: F.floor(i * F.col("ne") / F.col("nz")).cast("int")))
    ready = pairs.join(sizes, "chapter_id").select("chapter_id", "pair", "ref", "target_idx", "target", expected.alias("expected"))
    return B.rebalance(ready, "chapter_id").select("chapter_id", "pair", F.array_join("target", " ").alias("target"), "moves")


# --- matching and classes ----------------------------------------------------------------


@query()
def excerpt_match(spark, sf_dir) -> DataFrame:
    """The passage of a chapter that is most like a sentence of its other edition.

    Here the sentences are the chapter's own, asked for every twentieth id.
    """
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text").where("lang = 'zh'")
    w = Window.partitionBy("chapter_id").orderBy("sent", "sentence_id")
    s = s.withColumn("idx", F.row_number().over(w) - 1).withColumn("start", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.select("chapter_id", "sentence_id", "idx", "text", "start", (F.col("start") + F.length("text")).alias("end"))
    chars = s.groupBy("chapter_id").agg(F.max("end").alias("chars"))
    a = s.where("sentence_id % 20 = 0").join(chars, "chapter_id").select(F.col("sentence_id").alias("anchor_id"), "chapter_id", F.col("text").alias("anchor"), ((F.col("start") + F.col("end")) / 2).alias("target"), "chars")
    # Scoring is dear and the rows are few: over all cores, whatever the files were.
    a = a.repartition(spark.sparkContext.defaultParallelism, "anchor_id")
    m = X.match_excerpts(a, s.drop("sentence_id"), ["chapter_id"])
    return m.withColumns({c: F.round(c, 3) for c in ("confidence", "recall", "length_ratio", "position_delta")})


_METRICS = "SELECT l_orderkey AS question, l_linenumber AS version, l_discount * 6 AS confidence, l_tax * 12 AS recall, l_quantity / 20 AS ratio, abs(l_quantity - 25) / 60 AS delta, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'x' END AS text FROM lineitem"
_CLASSES = f"""WITH m AS ({_METRICS}), w AS (SELECT *, CASE WHEN text = '' THEN ['empty_match'] ELSE list_filter([CASE WHEN confidence < 0.28 THEN 'low_confidence' END, CASE WHEN recall < 0.24 THEN 'low_keyword_recall' END, CASE WHEN ratio < 0.36 OR ratio > 2.35 THEN 'length_ratio_outlier' END, CASE WHEN delta > 0.28 THEN 'position_delta_outlier' END], lambda x: x IS NOT NULL) END AS warnings FROM m),
c AS (SELECT *, CASE WHEN text = '' OR confidence < 0.18 OR recall < 0.16 THEN 'unusable' WHEN len(warnings) > 0 THEN 'needs_review' ELSE 'aligned' END AS status FROM w)"""


def _classes(spark, sf_dir) -> DataFrame:
    m = load(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("version"), (F.col("l_discount") * 6).alias("confidence"), (F.col("l_tax") * 12).alias("recall"),
             (F.col("l_quantity") / 20).alias("ratio"), (F.abs(F.col("l_quantity") - 25) / 60).alias("delta"), F.when(F.col("l_partkey") % 50 == 0, "").otherwise("x").alias("text"))
    w = m.withColumn("warnings", X.option_warnings(F.col("text"), F.col("confidence"), F.col("recall"), F.col("ratio"), F.col("delta")))
    return w.withColumn("status", X.option_status(F.col("text"), F.col("confidence"), F.col("recall"), F.col("warnings")))


@query(f"{_CLASSES} SELECT status, array_to_string(warnings, ',') AS warnings, count(*) AS n FROM c GROUP BY 1, 2")
def classify_options(spark, sf_dir) -> DataFrame:
    """Classes and warnings of matches."""
    return O.counted(_classes(spark, sf_dir).withColumn("warnings", F.array_join("warnings", ",")), "status", "warnings")


@query(f"""{_CLASSES}, q AS (SELECT question, count(*) FILTER (WHERE status = 'aligned') AS a, count(*) FILTER (WHERE text = '') AS e, count(*) FILTER (WHERE status <> 'aligned') AS o, min(confidence) FILTER (WHERE version <> 1) AS lo,
  coalesce(sum(len(warnings)) FILTER (WHERE version <> 1), 0) AS w FROM c GROUP BY 1)
SELECT question, CASE WHEN a < 3 OR e > 0 THEN 'disabled' WHEN o > 0 OR w > 0 THEN 'review' ELSE 'ready' END AS status, round(lo, 6) AS min_confidence, CAST(w AS BIGINT) AS warnings FROM q""")
def question_status(spark, sf_dir) -> DataFrame:
    """The state of a question from its options; the first version is the anchor."""
    q = X.question_status(_classes(spark, sf_dir), "question", F.col("version") == 1)
    return q.select("question", "status", F.round("min_confidence", 6).alias("min_confidence"), F.size("warnings").cast("bigint").alias("warnings"))


@query(f"""{_CLASSES} SELECT question, version, status, substring(text, 1, 160) AS text FROM c WHERE status <> 'aligned'""")
def issue_list(spark, sf_dir) -> DataFrame:
    """matches that aren't aligned."""
    return _classes(spark, sf_dir).where("status <> 'aligned'").select("question", "version", "status", F.substring("text", 1, 160).alias("text"))


@query("""
SELECT id, source_type, CASE WHEN source_type IN ('repo-data', 'epub', 'pdf') THEN source_type END AS reader, coalesce(normalization.traditional_to_simplified, false) AND script = 'Hant' AS conversion FROM versions""")
def source_dispatch(spark, sf_dir) -> DataFrame:
    """The reader of each version, and whether its script waits for conversion."""
    from folioloom.sources.files import by_source_type

    v = by_source_type(load(spark, sf_dir, "versions"))
    return v.select("id", "source_type", "reader", (F.coalesce("normalization.traditional_to_simplified", F.lit(False)) & (F.col("script") == "Hant")).alias("conversion"))


# --- sources -----------------------------------------------------------------------------

_BLOCKS = "(SELECT textdoc_id, b, k FROM (SELECT textdoc_id, UNNEST(blocks) AS b, generate_subscripts(blocks, 1) AS k FROM (SELECT DISTINCT textdoc_id, blocks FROM text_documents)))"
_WS = r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _pages(spark, sf_dir) -> DataFrame:
    p = lambda b: F.concat(F.lit("<p>"), N.escape_html(b), F.lit("<br/></p><ul><li>skip</li></ul>"))
    body = F.array_join(F.transform("blocks", p), "\n")
    html = F.concat(F.lit("<html><head><title>t</title></head><body><div>"), body, F.lit("</div></body></html>"))
    return load(spark, sf_dir, "text_documents", "textdoc_id", "blocks").select("textdoc_id", html.alias("html"))


_READ = f"SELECT textdoc_id, CAST(k AS INTEGER) AS idx, trim(regexp_replace(b, '{_WS}+', ' ', 'g'), ' ') AS text FROM {_BLOCKS}"


def _archives(spark, sf_dir) -> DataFrame:
    """(path, content): an e-book of each text document, its blocks in reverse reading order; of odd ones the directory is lost."""
    import io
    import zipfile
    from html import escape

    import pandas as pd

    def made(doc: int, blocks) -> bytes:
        out, names = io.BytesIO(), [f"b{k:04d}.xhtml" for k in range(1, len(blocks) + 1)]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
            items = "".join(f'<item id="{n}" href="{n}"/>' for n in names)
            z.writestr("OEBPS/p.opf", f'<package xmlns="u"><manifest>{items}</manifest><spine>{"".join(f"""<itemref idref="{n}"/>""" for n in reversed(names))}<itemref idref="lost"/></spine></package>')
            for n, b in zip(names, blocks):
                z.writestr(f"OEBPS/{n}", f"<html><body><p>{escape(b or '', False)}</p></body></html>", zipfile.ZIP_STORED if doc % 3 else zipfile.ZIP_DEFLATED)
        return out.getvalue()[: z.start_dir] if doc % 2 else out.getvalue()

    def run(rows):
        for b in rows:
            yield pd.DataFrame({"path": b["textdoc_id"].astype(str), "content": [made(i, x) for i, x in zip(b["textdoc_id"], b["blocks"])]})

    return load(spark, sf_dir, "text_documents", "textdoc_id", "blocks").where("blocks is not null").mapInPandas(run, "path string, content binary")


_PAGE = "'<html><body><p>' || replace(replace(replace(coalesce(b, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></html>'"


@query(f"SELECT textdoc_id, printf('OEBPS/b%04d.xhtml', k) AS entry, md5({_PAGE}) AS digest, CASE WHEN textdoc_id % 2 = 1 THEN 'zip_central_directory_unreadable' END AS warning FROM {_BLOCKS}")
def archive_members(spark, sf_dir) -> DataFrame:
    """The members of archives, whole and damaged."""
    from folioloom.sources.archives import members_of

    m = members_of(_archives(spark, sf_dir)).where("entry like '%.xhtml'")
    return m.select(F.col("path").cast("bigint").alias("textdoc_id"), "entry", F.md5("content").alias("digest"), "warning")


@query(f"SELECT textdoc_id, CAST(count(*) OVER (PARTITION BY textdoc_id) - k AS INTEGER) AS pos, printf('OEBPS/b%04d.xhtml', k) AS entry, md5({_PAGE}) AS digest FROM {_BLOCKS}")
def archive_spine(spark, sf_dir) -> DataFrame:
    """The documents of archives in reading order."""
    from folioloom.sources.archives import spine_of

    return spine_of(_archives(spark, sf_dir)).select(F.col("path").cast("bigint").alias("textdoc_id"), "pos", "entry", F.md5(F.col("html").cast("binary")).alias("digest"))


@query(_READ)
def html_blocks_book(spark, sf_dir) -> DataFrame:
    """Blocks of pages made from the tables' own blocks come back in order."""
    from folioloom.sources.blocks import read_blocks

    return read_blocks(_pages(spark, sf_dir), "textdoc_id", "html", "book")


@query(_READ)
def html_blocks_translation(spark, sf_dir) -> DataFrame:
    """S9."""
    from folioloom.sources.blocks import read_blocks

    return read_blocks(_pages(spark, sf_dir), "textdoc_id", "html", "translation")


@query(f"""
WITH t AS (SELECT textdoc_id, 2 * k AS o, trim(regexp_replace(regexp_replace(replace(b, chr(160), ' ') || chr(10), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n+', chr(10), 'g'), ' \x09\x0a\u2028\u2029\u3000\u2003\u2009\u200a\u202f\u205f\u1680\u0085') AS text FROM {_BLOCKS}
  UNION ALL SELECT textdoc_id, 2 * k + 1, 'skip' FROM {_BLOCKS})
SELECT textdoc_id, CAST(row_number() OVER (PARTITION BY textdoc_id ORDER BY o) AS INTEGER) AS idx, text FROM t WHERE text <> ''""")
def html_blocks_extract(spark, sf_dir) -> DataFrame:
    """Here list items are blocks too."""
    from folioloom.sources.blocks import read_blocks

    return read_blocks(_pages(spark, sf_dir), "textdoc_id", "html", "extract")


@query("""
SELECT version_id, textdoc_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY textdoc_id) AS INTEGER) AS place, length(array_to_string(blocks, chr(10))) AS chars FROM (SELECT DISTINCT textdoc_id, version_id, blocks FROM text_documents)""")
def document_records(spark, sf_dir) -> DataFrame:
    """Documents with their length and their place."""
    from folioloom.sources.files import document_records as records

    d = records(load(spark, sf_dir, "text_documents", "textdoc_id", "version_id", "blocks"), "version_id", "textdoc_id")
    return d.select("version_id", "textdoc_id", F.col("chapter_order").alias("place"), F.col("char_count").cast("bigint").alias("chars"))


@query("""
WITH d AS (SELECT DISTINCT textdoc_id, version_id, href, blocks FROM text_documents), c AS (SELECT version_id, textdoc_id, row_number() OVER (PARTITION BY version_id ORDER BY textdoc_id) AS n FROM d
  WHERE length(array_to_string(blocks, chr(10))) >= 300 AND NOT regexp_matches(lower(href), '(cover|nav|toc|copyright|titlepage)'))
SELECT version_id, textdoc_id FROM c WHERE n <= 20""")
def body_documents(spark, sf_dir) -> DataFrame:
    """the documents that make up the body; here none has chapter numbers."""
    from folioloom.sources.files import body_documents as body
    from folioloom.sources.files import char_count

    d = load(spark, sf_dir, "text_documents", "textdoc_id", "version_id", "href", "blocks").withColumn("char_count", char_count(F.col("blocks")))
    return body(d, "version_id", "textdoc_id", F.lit(None).cast("int"), least=300).select("version_id", "textdoc_id")


@query(f"SELECT work_id, chapter, version_id, greatest(1, CAST(sum(length(text)) AS BIGINT)) AS chars, greatest(1, count(*)) AS n_rows FROM {_P} GROUP BY 1, 2, 3")
def chapter_metrics(spark, sf_dir) -> DataFrame:
    """Characters and rows of each chapter."""
    from folioloom.sources.files import chapter_metrics as metrics

    p = load(spark, sf_dir, "paragraphs", "paragraph_id", "work_id", "chapter", "version_id", "text")
    return metrics(p, ["work_id", "chapter", "version_id"], "text").withColumnRenamed("rows", "n_rows")


@query(f"SELECT work_id, chapter, version_id, lang, string_agg(text, chr(10) ORDER BY idx, paragraph_id) AS blocks FROM {_P} GROUP BY 1, 2, 3, 4")
def grouped_chapters(spark, sf_dir) -> DataFrame:
    """The texts of a chapter in order."""
    p = load(spark, sf_dir, "paragraphs", "paragraph_id", "work_id", "chapter", "version_id", "lang", "idx", "text")
    b = F.sort_array(F.collect_list(F.struct("idx", "paragraph_id", "text")))
    return p.groupBy("work_id", "chapter", "version_id", "lang").agg(b.alias("b")).select("work_id", "chapter", "version_id", "lang", F.array_join("b.text", "\n").alias("blocks"))


@query(f"SELECT version_id, count(*) AS headings FROM {_BLOCKS} JOIN (SELECT DISTINCT textdoc_id, version_id FROM text_documents) USING (textdoc_id) WHERE k <= 10 AND regexp_matches(b, '（第\\d+[号號]）$') GROUP BY 1")
def heading_matches(spark, sf_dir) -> DataFrame:
    """Headings among the first ten blocks."""
    d = load(spark, sf_dir, "text_documents", "textdoc_id", "version_id", "blocks")
    return d.select("version_id", F.explode(F.slice("blocks", 1, 10)).alias("b")).where(F.col("b").rlike("（第\\d+[号號]）$")).groupBy("version_id").agg(F.count(F.lit(1)).alias("headings"))
