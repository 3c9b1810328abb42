"""Queries over text functions: normalisation, segments, measures, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import measures as M
from folioloom.functions import segment as S
from folioloom.functions import text as N
from folioloom.operators import relational as R
from folioloom.operators.ranks import bounded_rows
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


# RE2 has no Unicode classes for blanks: spelt out, as what the tables hold.
_WS = r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{85}]"
_P = "(SELECT DISTINCT paragraph_id, lang, text FROM paragraphs)"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def _paragraphs(spark, sf_dir, *langs: str) -> DataFrame:
    p = load(spark, sf_dir, "paragraphs", "paragraph_id", "lang", "text")
    return p.where(F.col("lang").isin(*langs)) if langs else p


@query(f"SELECT paragraph_id, {_squeezed('text')} AS clean FROM {_P}")
def clean_text(spark, sf_dir) -> DataFrame:
    """Blanks of all kinds squeezed (no text here has a character reference)."""
    return _paragraphs(spark, sf_dir).select("paragraph_id", N.from_markup(F.col("text"), ["[插图]"]).alias("clean"))


@query(f"""SELECT paragraph_id, trim(regexp_replace(regexp_replace(text, '{_WS}+([,.;:!?”’])', '\\1', 'g'), '([“‘]){_WS}+', '\\1', 'g'), ' 　 ' || chr(10)) AS tidy FROM {_P} WHERE lang = 'en'""")
def tidy_text(spark, sf_dir) -> DataFrame:
    """No blanks before marks or after opening quotes."""
    return _paragraphs(spark, sf_dir, "en").select("paragraph_id", N.tidy_punctuation(F.col("text")).alias("tidy"))


@query(f"""SELECT paragraph_id, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n+', chr(10), 'g') AS kept FROM {_P}""")
def kept_lines(spark, sf_dir) -> DataFrame:
    """Blanks squeezed within lines."""
    return _paragraphs(spark, sf_dir).select("paragraph_id", N.keep_lines(F.col("text")).alias("kept"))


@query(f"SELECT paragraph_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS key FROM {_P}")
def match_key(spark, sf_dir) -> DataFrame:
    """N6."""
    return _paragraphs(spark, sf_dir).select("paragraph_id", N.match_key(F.col("text")).alias("key"))


@query(f"SELECT paragraph_id, translate(regexp_replace(text, '[^\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g'), '的一是在不了有人和', '') AS key FROM {_P} WHERE lang = 'zh'")
def comparable_text(spark, sf_dir) -> DataFrame:
    """Without marks and without common characters."""
    return _paragraphs(spark, sf_dir, "zh").select("paragraph_id", N.comparable(F.col("text"), "的一是在不了有人和").alias("key"))


@query(f"""SELECT paragraph_id, translate(text, (SELECT string_agg(trad, '' ORDER BY trad) FROM script_map), (SELECT string_agg(simp, '' ORDER BY trad) FROM script_map)) AS simplified FROM {_P} WHERE lang = 'zh'""")
def simplified_text(spark, sf_dir) -> DataFrame:
    """One character for another, by a table."""
    pairs = {r.trad: r.simp for r in bounded_rows(load(spark, sf_dir, "script_map"), 200_000, "script_map")}  # one row for each character
    return _paragraphs(spark, sf_dir, "zh").select("paragraph_id", N.replace_characters(F.col("text"), pairs).alias("simplified"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_GUARDED = "text"
for _k, _w in enumerate(N.ZHU_WORDS):
    _GUARDED = f"replace({_GUARDED}, {_lit(_w)}, {_lit(f'<{_k}>')})"
_GUARDED = f"replace(replace({_GUARDED}, '妳', '你'), '著', '着')"
for _k, _w in enumerate(N.ZHU_WORDS):
    _GUARDED = f"replace({_GUARDED}, {_lit(f'<{_k}>')}, {_lit(_w)})"


@query(f"SELECT paragraph_id, {_GUARDED} AS regional FROM {_P} WHERE lang = 'zh'")
def regional_markers(spark, sf_dir) -> DataFrame:
    """The particle 著 outside of words that hold it."""
    return _paragraphs(spark, sf_dir, "zh").select("paragraph_id", N.regional(F.col("text")).alias("regional"))


@query()
def visible_text(spark, sf_dir) -> DataFrame:
    """The composed normalisation of quiz texts (lookarounds, so no SQL)."""
    x = N.visible(N.regional(N.visible(N.repair_pages(F.col("text")))))
    return _paragraphs(spark, sf_dir, "zh").select("paragraph_id", x.alias("visible"))


_NUM = "CASE r WHEN '一' THEN 1 WHEN '二' THEN 2 WHEN '三' THEN 3 WHEN '四' THEN 4 WHEN '五' THEN 5 WHEN '六' THEN 6 WHEN '七' THEN 7 WHEN '八' THEN 8 WHEN '九' THEN 9 WHEN '两' THEN 2 WHEN '零' THEN 0 WHEN '〇' THEN 0 WHEN '十' THEN 10 END"


@query(f"""
WITH l AS (SELECT paragraph_id, regexp_extract(split_part(text, chr(10), 1), '^第([零〇一二两三四五六七八九十百0-9]+)章$', 1) AS raw FROM {_P} WHERE lang IN ('zh', 'ja')),
p AS (SELECT *, split_part(raw, '十', 1) AS a, regexp_replace(raw, '^[^十]*十', '') AS b FROM l WHERE raw <> '')
SELECT paragraph_id, CAST(CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN TRY_CAST(raw AS INTEGER) WHEN length(raw) = 1 THEN {_NUM.replace('CASE r', 'CASE raw')}
  WHEN contains(raw, '十') THEN (CASE WHEN a = '' THEN 1 ELSE {_NUM.replace('CASE r', 'CASE a')} END) * 10 + (CASE WHEN b = '' THEN 0 ELSE {_NUM.replace('CASE r', 'CASE b')} END) END AS INTEGER) AS number FROM p""")
def chapter_headings(spark, sf_dir) -> DataFrame:
    """Chapter numbers in digits and numerals, from the first line."""
    x = N.chapter_number(F.substring_index("text", "\n", 1))
    return _paragraphs(spark, sf_dir, "zh", "ja").select("paragraph_id", x.alias("number")).where("number is not null")


@query(f"""
SELECT lang, count(*) FILTER (WHERE x) AS furniture, count(*) FILTER (WHERE length(line) >= 2 AND NOT regexp_matches(line, '(?i)^(cap[ií]tulo|chapter)\\s+\\d+$') AND NOT regexp_matches(line, '^(第\\s*)?\\d+\\s*章$')) AS prose FROM (
  SELECT lang, line, line = '' OR regexp_matches(line, '(?i)^chapter\\s+\\d+$') OR line IN ('Table of Contents', 'Contents') OR regexp_matches(line, '(?i)^the\\s+end\\.?$') OR regexp_matches(line, '^第\\s*\\d+\\s*章$')
    OR (length(line) <= 2 AND NOT regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z]')) AS x FROM (SELECT lang, UNNEST(string_split(text, chr(10))) AS line FROM {_P})) GROUP BY lang""")
def skip_filter(spark, sf_dir) -> DataFrame:
    """headings and the like, line by line."""
    lines = _paragraphs(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count_if(N.is_furniture(F.col("line"))).alias("furniture"), F.count_if(N.is_prose(F.col("line"))).alias("prose"))


@query("""
SELECT textdoc_id, k AS idx FROM (SELECT textdoc_id, k, max(CASE WHEN b = '***' THEN 1 ELSE 0 END) OVER (PARTITION BY textdoc_id ORDER BY k) AS s FROM (
  SELECT textdoc_id, UNNEST(blocks) AS b, generate_subscripts(blocks, 1) AS k FROM (SELECT DISTINCT textdoc_id, blocks FROM text_documents))) WHERE s = 0""")
def take_while(spark, sf_dir) -> DataFrame:
    """The blocks before the first separator."""
    b = load(spark, sf_dir, "text_documents", "textdoc_id", "blocks").select("textdoc_id", F.posexplode("blocks").alias("k", "b"))
    return R.until(b, ["textdoc_id"], "k", F.col("b") == "***").select("textdoc_id", (F.col("k") + 1).cast("bigint").alias("idx"))


@query("""
SELECT event_id, regexp_matches(CAST(event_id AS VARCHAR), '^(\\d{1,4}|20\\d{6}|[IVXLCDM]{1,8})$') AS noise FROM events""")
def page_noise(spark, sf_dir) -> DataFrame:
    """page numbers."""
    return load(spark, sf_dir, "events", "event_id").select("event_id", N.is_page_noise(F.col("event_id").cast("string")).alias("noise"))


@query("""
SELECT textdoc_id, coalesce(list_filter(blocks[1:5], lambda b: length(b) <= 80)[1], regexp_extract(href, '[^/]*$')) AS title FROM (SELECT DISTINCT textdoc_id, blocks, href FROM text_documents)""")
def inferred_titles(spark, sf_dir) -> DataFrame:
    """The first short block, or the file's name."""
    return load(spark, sf_dir, "text_documents", "textdoc_id", "blocks", "href").select("textdoc_id", N.title_of(F.col("blocks"), F.col("href")).alias("title"))


@query("""
SELECT doc_id, doc_id % 1000 AS r_start, doc_id % 1000 + coalesce(n_chars, 0) AS r_end, printf('ch%02d-%03d', CAST(doc_id % 20 AS INTEGER), CAST(doc_id % 400 AS INTEGER)) AS qid, format('{:,}', doc_id) AS label FROM documents""")
def ranges_and_labels(spark, sf_dir) -> DataFrame:
    """Ranges parsed, question ids and grouped digits made."""
    d = load(spark, sf_dir, "documents", "doc_id", "n_chars").withColumn("r", F.concat((F.col("doc_id") % 1000).cast("string"), F.lit("-"), (F.col("doc_id") % 1000 + F.coalesce("n_chars", F.lit(0))).cast("string")))
    r = N.parse_range(F.col("r"))
    return d.select("doc_id", r["start"].cast("bigint").alias("r_start"), r["end"].cast("bigint").alias("r_end"), N.question_id((F.col("doc_id") % 20).cast("int"), (F.col("doc_id") % 400).cast("int")).alias("qid"), F.format_number("doc_id", 0).alias("label"))


@query(f"""SELECT paragraph_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe,
  '「' || translate(trim(text), '“”', '『』') || '」' AS quoted FROM {_P} WHERE lang IN ('en', 'zh')""")
def escaped_text(spark, sf_dir) -> DataFrame:
    """Text for markup, and in corner brackets."""
    return _paragraphs(spark, sf_dir, "en", "zh").select("paragraph_id", N.escape_html(F.col("text"), True).alias("safe"), N.quote_style(F.col("text")).alias("quoted"))


@query("""SELECT id, 'https://example.org/search?q=' || url_encode(english || ' ' || zh) AS link FROM term_stats""")
def deep_links(spark, sf_dir) -> DataFrame:
    """Links with percent-encoded words."""
    t = load(spark, sf_dir, "term_stats", "id", "english", "zh")
    return t.select("id", F.concat(F.lit("https://example.org/search?q="), N.percent_encoded(F.concat_ws(" ", "english", "zh"))).alias("link"))


# --- segments ----------------------------------------------------------------------------


@query(f"""
SELECT paragraph_id, k - 1 AS sent, s AS sentence FROM (SELECT paragraph_id, UNNEST(p) AS s, generate_subscripts(p, 1) AS k FROM (
  SELECT paragraph_id, list_filter(list_transform(regexp_extract_all({_squeezed('text')}, '.+?[。！？；]+[”’」』）)]*|.+$'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM {_P} WHERE lang IN ('zh', 'ja')))""")
def sentences_east(spark, sf_dir) -> DataFrame:
    """T1."""
    return _paragraphs(spark, sf_dir, "zh", "ja").select("paragraph_id", F.posexplode(S.east_sentences(F.col("text"))).alias("sent", "sentence")).withColumn("sent", F.col("sent").cast("bigint"))


@query()
def sentences_west(spark, sf_dir) -> DataFrame:
    """Cut by lookarounds."""
    return _paragraphs(spark, sf_dir, "en", "es").select("paragraph_id", F.posexplode(S.west_sentences(F.col("text"))).alias("sent", "sentence"))


@query()
def sentences_guarded(spark, sf_dir) -> DataFrame:
    """Western sentences that abbreviations don't end."""
    return _paragraphs(spark, sf_dir, "es", "pt").select("paragraph_id", F.posexplode(S.western_sentences(F.col("text"))).alias("sent", "sentence"))


@query()
def sentences_weighted(spark, sf_dir) -> DataFrame:
    """T4, M2: sentences by language with the weights before and after them."""
    p = _paragraphs(spark, sf_dir, "en", "es", "zh", "ja")
    s = p.select("paragraph_id", "lang", F.posexplode(S.quote_sentences(F.col("text"), F.col("lang"))).alias("sent", "sentence"))
    w = F.coalesce(*[F.when(F.col("lang") == c, M.weight(F.col("sentence"), c, "quotes")) for c in ("en", "es", "zh", "ja")])
    run = Window.partitionBy("paragraph_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("w", w).withColumn("weight_start", F.coalesce(F.sum("w").over(run), F.lit(0.0))).select("paragraph_id", "sent", "sentence", "weight_start", (F.col("weight_start") + F.col("w")).alias("weight_end"))


@query(f"""
WITH p AS (SELECT paragraph_id, regexp_extract_all(text, '(?s)[^。！？!?；;]*[。！？!?；;]+[”’」』）】》]*|[^。！？!?；;]+$') AS x FROM {_P} WHERE lang = 'zh'),
e AS (SELECT paragraph_id, UNNEST(x) AS s, generate_subscripts(x, 1) AS k FROM p)
SELECT paragraph_id, CAST(sum(length(s)) OVER (PARTITION BY paragraph_id ORDER BY k) - length(s) AS INTEGER) AS span_start, CAST(sum(length(s)) OVER (PARTITION BY paragraph_id ORDER BY k) AS INTEGER) AS span_end
FROM e QUALIFY {_squeezed('s')} <> ''""")
def sentence_spans(spark, sf_dir) -> DataFrame:
    """T5: offsets of sentences, also ended by semicolons."""
    s = _paragraphs(spark, sf_dir, "zh").select("paragraph_id", F.explode(S.span_sentences(F.col("text"))).alias("s"))
    return s.select("paragraph_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(f"""SELECT lang, CAST(sum(len(list_distinct(list_transform(range(1, greatest(length(text) - 1, 1) + 1), lambda i: substring(text, i, 2))))) AS BIGINT) AS bigrams FROM {_P} WHERE text <> '' GROUP BY lang""")
def ngram_sets(spark, sf_dir) -> DataFrame:
    """Different bigrams of each text."""
    return _paragraphs(spark, sf_dir).where("text <> ''").groupBy("lang").agg(F.sum(F.size(M.ngrams(F.col("text"), 2))).alias("bigrams"))


@query()
def sentences_within(spark, sf_dir) -> DataFrame:
    """Sentences within the limits of their language."""
    p = _paragraphs(spark, sf_dir, "zh", "en")
    zh = p.where("lang = 'zh'").select("paragraph_id", F.explode(S.east_sentences(F.col("text"))).alias("s")).select("paragraph_id", F.explode(S.within(F.col("s"), "zh", 40, "，、：—")).alias("piece"))
    en = p.where("lang = 'en'").select("paragraph_id", F.explode(S.west_sentences(F.col("text"))).alias("s")).select("paragraph_id", F.explode(S.within(F.col("s"), "en", 60, ",—:")).alias("piece"))
    return zh.unionByName(en)


@query()
def balanced_chunks(spark, sf_dir) -> DataFrame:
    """Both sides of a chapter cut into about as many chunks."""
    c = load(spark, sf_dir, "chapters", "chapter_id", "zh", "en")
    sent = c.select(
        "chapter_id", F.size("zh").alias("n_zh"), F.size("en").alias("n_en"),
        F.flatten(F.transform("zh.text", lambda t: S.east_sentences(t))).alias("a"), F.flatten(F.transform("en.text", lambda t: S.west_sentences(t))).alias("b"))

    def length(x):
        return F.aggregate(x, F.lit(0), lambda s, t: s + F.length(t))

    sized = sent.withColumns({"la": length(F.col("a")), "lb": length(F.col("b"))})
    target = S.balanced_target([F.greatest(F.col("n_zh"), F.lit(0)), F.greatest(F.col("n_en"), F.lit(0))], [(F.col("lb"), 430), (F.col("la"), 155)])
    cut = sized.withColumn("target", target)
    return cut.select(
        "chapter_id", "target", F.size(S.packed(F.col("a"), S.soft_limit(F.col("la"), F.col("target"), 45))).alias("zh_chunks"),
        F.size(S.packed(F.col("b"), S.soft_limit(F.col("lb"), F.col("target"), 80), " ")).alias("en_chunks"))


@query("""
SELECT chapter_id, z.idx AS para_idx, s.k - 1 AS sent, s.t AS sentence FROM (SELECT chapter_id, UNNEST(zh) AS z FROM (SELECT DISTINCT chapter_id, zh FROM chapters)),
LATERAL (SELECT UNNEST(regexp_extract_all(z.text, '.+?[。！？；]+[”’」』）)]*|.+$')) AS t, generate_subscripts(regexp_extract_all(z.text, '.+?[。！？；]+[”’」』）)]*|.+$'), 1) AS k) s""")
def target_units(spark, sf_dir) -> DataFrame:
    """Paragraphs of a chapter as sentences, under the paragraph's index and their own."""
    p = load(spark, sf_dir, "chapters", "chapter_id", "zh").select("chapter_id", F.inline("zh"))
    return p.select("chapter_id", F.col("idx").alias("para_idx"), F.posexplode(S.east_sentences(F.col("text"))).alias("sent", "sentence")).withColumn("sent", F.col("sent").cast("bigint"))


# --- measures ----------------------------------------------------------------------------


def _count(pattern: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_WORDS = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[’''][A-Za-zÀ-ÖØ-öø-ÿ]+)?"
_W_EN = f"greatest(1.0, {_count(_WORDS)} * 5.25 + {_count('[.!?;:]')} * 0.35)"
_W_ZH = f"greatest(1.0, {_count('[一-鿿]')} * 1.85 + {_count('[A-Za-z]+')} * 1.5 + {_count('[。！？；：，、,.!?;:]')} * 0.25)"


@query(f"SELECT paragraph_id, CAST(round(100 * (CASE lang WHEN 'zh' THEN {_W_ZH} ELSE {_W_EN} END)) AS BIGINT) AS weight FROM {_P} WHERE lang IN ('zh', 'en')")
def text_weight(spark, sf_dir) -> DataFrame:
    """M1."""
    w = F.when(F.col("lang") == "zh", M.weight(F.col("text"), "zh")).otherwise(M.weight(F.col("text"), "en"))
    return _paragraphs(spark, sf_dir, "zh", "en").select("paragraph_id", F.round(w * 100).cast("bigint").alias("weight"))


@query(f"""
SELECT sentence_id, CAST(round(100 * coalesce(sum(w) OVER (PARTITION BY chapter_id ORDER BY sent, sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS weight_before
FROM (SELECT sentence_id, chapter_id, sent, {_W_EN} AS w FROM (SELECT DISTINCT sentence_id, chapter_id, lang, sent, text FROM sentences) WHERE lang = 'en')""")
def prefix_weights(spark, sf_dir) -> DataFrame:
    """The weight of all sentences before one."""
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text").where("lang = 'en'").withColumn("w", M.weight(F.col("text"), "en"))
    run = Window.partitionBy("chapter_id").orderBy("sent", "sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("sentence_id", F.round(100 * F.coalesce(F.sum("w").over(run), F.lit(0.0))).cast("bigint").alias("weight_before"))


_S = "(SELECT DISTINCT sentence_id, chapter_id, lang, sent, text FROM sentences)"
_NEXT = f"(SELECT sentence_id, text AS a, lead(text) OVER (PARTITION BY chapter_id, lang ORDER BY sent, sentence_id) AS b FROM {_S})"


def _neighbours(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "sentences", "sentence_id", "chapter_id", "lang", "sent", "text")
    w = Window.partitionBy("chapter_id", "lang").orderBy("sent", "sentence_id")
    return s.select("sentence_id", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")


def _grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 1}, 1) + 1), lambda i: substring({x}, i, {n})))"


@query(f"""
SELECT sentence_id, round(CASE WHEN len(list_intersect(ga, gb)) = 0 THEN 0 ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) END, 6) AS jaccard
FROM (SELECT sentence_id, {_grams('a', 2)} AS ga, {_grams('b', 2)} AS gb FROM {_NEXT} WHERE b IS NOT NULL)""")
def bigram_jaccard(spark, sf_dir) -> DataFrame:
    """M4 of neighbouring sentences."""
    n = _neighbours(spark, sf_dir)
    return n.select("sentence_id", F.round(M.jaccard(M.ngrams(F.col("a")), M.ngrams(F.col("b"))), 6).alias("jaccard"))


@query(f"""
SELECT sentence_id, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN contains(b, a) THEN 1 WHEN contains(a, b) THEN length(b) / length(a)
  ELSE len(list_filter({_grams('a', 4)}, lambda g: contains(b, g))) / len({_grams('a', 4)}) END, 6) AS score FROM {_NEXT} WHERE b IS NOT NULL""")
def containment(spark, sf_dir) -> DataFrame:
    """M3: how much of a sentence the next one holds."""
    return _neighbours(spark, sf_dir).select("sentence_id", F.round(M.containment(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""
SELECT sentence_id, round(greatest(0, 1 - abs(la - lb) / greatest(la, lb)), 6) AS similarity, CASE WHEN lb / la BETWEEN 0.45 AND 1.9 THEN 1.0::DOUBLE WHEN lb / la < 0.25 OR lb / la > 3 THEN 0.55 ELSE 0.78 END AS guard,
  round(greatest(0, least(0.99, (lb / la - 0.06) / 0.36)), 6) AS confidence FROM (SELECT sentence_id, length(a)::DOUBLE AS la, length(b)::DOUBLE AS lb FROM {_NEXT} WHERE b IS NOT NULL AND a <> '' AND b <> '')""")
def length_measures(spark, sf_dir) -> DataFrame:
    """M6, M12, M13, M20."""
    n = _neighbours(spark, sf_dir).where("a <> '' and b <> ''")
    la, lb = F.length("a"), F.length("b")
    return n.select("sentence_id", F.round(M.length_similarity(la, lb), 6).alias("similarity"), M.length_guard(la, lb).alias("guard"), F.round(M.confidence(M.safe_ratio(lb, la)), 6).alias("confidence"))


_COMMON = "的一是在了"
_KEY = "regexp_replace({x}, '[^\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g')"


def _chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_KEY.format(x=x)}, ''), lambda c: c <> ''))"


@query(f"""
WITH c AS (SELECT sentence_id, {_chars('a')} AS ca, {_chars('b')} AS cb FROM {_NEXT} WHERE b IS NOT NULL),
r AS (SELECT *, list_filter(ca, lambda c: NOT contains('{_COMMON}', c)) AS ra FROM c), k AS (SELECT *, CASE WHEN len(ra) >= 8 THEN ra ELSE ca END AS ask FROM r)
SELECT sentence_id, round(CASE WHEN len(ask) = 0 THEN 1 ELSE len(list_intersect(ask, cb)) / len(ask) END, 6) AS recall FROM k""")
def keyword_recall(spark, sf_dir) -> DataFrame:
    """M8."""
    return _neighbours(spark, sf_dir).select("sentence_id", F.round(M.keyword_recall(F.col("a"), F.col("b"), _COMMON), 6).alias("recall"))


@query()
def content_similarity(spark, sf_dir) -> DataFrame:
    """M5, M7: with the sequence ratio."""
    # Scoring is dear: over all cores, whatever the files were.
    n = _neighbours(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "sentence_id")
    k = M.with_keys(M.with_keys(n, "a", "a", _COMMON), "b", "b", _COMMON)
    return k.select("sentence_id", F.round(M.content_similarity("a", "b"), 6).alias("similarity"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS mid, l_discount * 500 AS target, l_tax * 200 + 1 AS w, CAST(l_quantity AS INTEGER) AS r FROM lineitem),
y AS (SELECT *, greatest(0, least(1, (r - 0.5) / 50.0)) AS br FROM x)
SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - abs(mid - target) / greatest(1, w * 2.2)), 6) AS position, round(CASE WHEN r = 0 THEN target / 50 WHEN abs(br - target / 50) > 0.18 THEN 0.72 * br + 0.28 * (target / 50) ELSE 0.45 * br + 0.55 * (target / 50) END, 6) AS anchor FROM y""")
def position_measures(spark, sf_dir) -> DataFrame:
    """M9, M15."""
    x = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("mid"), (F.col("l_discount") * 500).alias("target"), (F.col("l_tax") * 200 + 1).alias("w"))
    return x.select("l_orderkey", "l_linenumber", F.round(M.position_score(F.col("mid"), F.col("target"), F.col("w")), 6).alias("position"),
                    F.round(M.anchor_position(F.col("mid").cast("int"), F.lit(50.0), F.col("target") / 50), 6).alias("anchor"))


@query("""
WITH q AS (SELECT doc_id, regexp_matches(text, '^[“"''‘]') OR regexp_matches(text, '[”"''’]$') AS a, regexp_matches(title, '^[“"''‘]') OR regexp_matches(title, '[”"''’]$') AS b FROM documents WHERE text IS NOT NULL AND title IS NOT NULL)
SELECT doc_id, CASE WHEN a <> b THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM q""")
def quote_penalties(spark, sf_dir) -> DataFrame:
    """M17."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "title").where("text is not null and title is not null")
    return d.select("doc_id", M.quote_penalty(F.col("text"), F.col("title")).alias("penalty"))


_FLAGS = """list_filter([CASE WHEN greatest(en, es) > 260 AND greatest(en, es) / greatest(1, least(en, es)) > 2.5 THEN 'western_length_mismatch' END,
  CASE WHEN greatest(en, es, ja) > 320 AND greatest(en, es, ja) / greatest(1, mid) > 2.8 THEN 'single_language_outlier' END, CASE WHEN en > 900 AND es > 900 THEN 'long_western_source_sentence' END,
  CASE WHEN (en > 900) <> (es > 900) THEN 'single_western_long_sentence' END, CASE WHEN ja > 350 AND ja / greatest(1, mid) > 2.8 THEN 'japanese_length_outlier' END], lambda x: x IS NOT NULL)"""


@query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 20 AS INTEGER) AS en, CAST(l_discount * 10000 AS INTEGER) AS es, CAST(l_tax * 5000 AS INTEGER) AS ja FROM lineitem),
m AS (SELECT *, list_sort([en, es, ja])[2] AS mid FROM l) SELECT l_orderkey, l_linenumber, array_to_string({_FLAGS}, ',') AS flags FROM m""")
def length_flags(spark, sf_dir) -> DataFrame:
    """What is odd about three lengths."""
    x = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", (F.col("l_quantity") * 20).cast("int").alias("en"), F.round(F.col("l_discount") * 10000).cast("int").alias("es"), F.round(F.col("l_tax") * 5000).cast("int").alias("ja"))
    return x.select("l_orderkey", "l_linenumber", F.array_join(M.length_flags(F.col("en"), F.col("es"), F.col("ja")), ",").alias("flags"))
