"""Cleaning, text scoring, matching, rules and deduplication over whole documents.

The lexicon, keyword, rule and name lists are this project's own fixtures: frequent
tokens of the test corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fix, fxs, query
from catalog.views import ARTICLES, DIM, NEWS, articles, news, table, ticker_dim
from tapewire.functions import text as tx
from tapewire.functions.numeric import sanitize, to_number
from tapewire.functions.scores import label_sentiment
from tapewire.operators import dedupe as dd
from tapewire.operators import matching as mt
from tapewire.operators import rules as rl
from tapewire.operators.aggregates import keyword_category_stats
from tapewire.operators.scale import checkpointed

S = "sentiment_compound"


def pad_sql(expr):
    return rf"(' ' || trim(regexp_replace(lower(coalesce({expr}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


FULL = "concat_ws(' ', title, description)"


def any_sql(text, terms):
    return "(" + " OR ".join(f"contains({text}, '{mt.fold_term(t)}')" for t in terms) + ")"


def count_sql(text, terms):
    return "(" + " + ".join(f"CAST(contains({text}, '{mt.fold_term(t)}') AS INTEGER)" for t in terms) + ")"


def values_sql(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ")"


# ---- cleaning --------------------------------------------------------------------------------


@query(
    "normalize_url",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '[?#].*$', ''), '/+$', '') AS url FROM pages""",
)
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("url"))


@query("market_symbol", "SELECT p_partkey, replace(upper(trim(p_brand || '.' || CAST(p_size AS VARCHAR) || ' ')), '.', '-') AS symbol FROM part")
def market_symbol(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit("."), F.col("p_size").cast("string"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", tx.market_symbol(raw).alias("symbol"))


@query(
    "valid_symbol",
    r"SELECT p_partkey, regexp_full_match(upper(trim(split_part(p_name, ' ', 1) || '.' || CAST(p_size AS VARCHAR))), '[A-Z0-9.\-]{1,10}') AS ok FROM part",
)
def valid_symbol(spark, sf):
    raw = F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("."), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", tx.valid_symbol(raw).alias("ok"))


@query(
    "clean_text",
    f"""WITH {ARTICLES}, x AS (SELECT article_id, trim(CASE WHEN article_id % 5 = 0 THEN '  ' ELSE ' ' || title || ' ' END, ' ') AS t, lower(ticker) AS k FROM articles)
SELECT article_id, CASE WHEN t = '' OR lower(t) = 'nan' THEN NULL ELSE t END AS title, upper(k) AS ticker FROM x""",
)
def clean_text(spark, sf):
    raw = articles(spark, sf).select(
        "article_id",
        F.when(F.col("article_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "title", F.lit(" "))).alias("title"),
        F.lower("ticker").alias("ticker"),
    )
    return tx.clean_text(raw)


@query("drop_short_titles", f"WITH {ARTICLES} SELECT article_id FROM articles WHERE length(title) > 5")
def drop_short_titles(spark, sf):
    return tx.drop_short_titles(articles(spark, sf)).select("article_id")


@query(
    "parse_time",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
 WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN CAST(CAST(ts AS DATE) - 1 AS TIMESTAMP) END AS published_at FROM events""",
)
def parse_time(spark, sf):
    out = _feed_times(spark, sf)
    return out.select("event_id", tx.parse_time([F.col("published")], F.col("ts")).cast("timestamp_ntz").alias("published_at"))


def _feed_times(spark, sf):
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 1, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 3, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .when(k == 4, F.lit("Yesterday"))
        .otherwise("soon")
    )
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.alias("published"))


@query(
    "event_time",
    """WITH p AS (SELECT event_id, ts, CASE event_id % 6 WHEN 2 THEN TIMESTAMP '1999-12-31 23:59:59' WHEN 5 THEN NULL ELSE ts - INTERVAL 1 DAY END AS pub FROM events)
SELECT event_id, CASE WHEN pub >= TIMESTAMP '2000-01-01' THEN pub ELSE ts END AS event_time FROM p""",
)
def event_time(spark, sf):
    k = F.col("event_id") % 6
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pub = F.when(k == 2, F.lit("1999-12-31 23:59:59").cast("timestamp")).when(k != 5, F.col("ts") - F.expr("INTERVAL 1 DAY"))
    return e.select("event_id", tx.event_time(pub, F.col("ts")).cast("timestamp_ntz").alias("event_time"))


@query("stamp_day", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS scraped_at FROM events")
def stamp_day(spark, sf):
    name = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".raw.json"))
    e = table(spark, sf, "events").select("event_id", tx.day_from_name(name).alias("day"))
    return e.select("event_id", tx.stamp_day(F.col("day")).cast("timestamp_ntz").alias("scraped_at"))


@query("to_number", f"SELECT p_partkey, {fxs('TRY_CAST(p_name AS DOUBLE)')} AS from_name, {fxs('p_retailprice')} AS from_price FROM part")
def to_number_q(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("from_name"), F.col("p_retailprice").cast("string").alias("from_price"))
    return fix(to_number(p, ["from_name", "from_price"]), "from_name", "from_price")


@query(
    "sanitize",
    f"SELECT event_id, {fxs('CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN -1.0 ELSE value END')} AS value FROM events",
)
def sanitize_q(spark, sf):
    k = F.col("event_id") % 4
    e = table(spark, sf, "events").select(
        "event_id", F.when(k == 0, F.lit(0.0)).when(k == 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("value")
    )
    e = e.withColumn("value", F.when(k == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    a = sanitize(e.where(k == 0), {"value": 0.0})
    return fix(a.unionByName(sanitize(e.where(k != 0), {"value": -1.0})), "value")


@query("normalize_sector", "SELECT DISTINCT CASE WHEN trim(n_name) = '' OR n_name LIKE '%1%' THEN 'Unknown' ELSE n_name END AS sector FROM nation")
def normalize_sector(spark, sf):
    raw = F.when(F.col("n_name").contains("1"), F.lit(" N/A ")).otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select(tx.normalize_sector(raw).alias("sector")).distinct()


@query("sanitize_text", r"SELECT doc_id, trim(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), ' ') AS text FROM documents")
def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.sanitize_text(F.col("text")).alias("text"))


@query("title_prefix", f"WITH {ARTICLES} SELECT article_id, substring(title, 1, 100) AS title FROM articles")
def title_prefix(spark, sf):
    return articles(spark, sf).select("article_id", tx.title_prefix(F.col("title")).alias("title"))


# ---- scoring ---------------------------------------------------------------------------------

# Fixture lexicon: frequent tokens of the corpus with invented weights.
LEXICON = [
    ("thon", 1.5), ("than", -1.2), ("thre", 2.0), ("ther", -0.8), ("thnt", 1.1), ("thing", -2.3), ("erin", 0.7), ("worthless", -3.0),
    ("thou", 1.9), ("eron", -1.6), ("inoran", 2.4), ("ononst", -2.0), ("ement", 1.3), ("les", -0.4), ("und", 0.6), ("por", -0.9),
]
MODIFIERS = [("of", -0.74), ("and", 1.3), ("la", -0.74), ("the", 1.1)]
TERMS = {
    "high": ["worthless", "thon th", "Ther"],
    "macro": ["thing", "OF THE"],
    "medium": ["inoran", "erin", "les"],
}
FIN = ["market", "the", "thou", "er", "nd"]
STOP = ["ononst", "por favor", "thatin"]
SOURCES = ["SRC1", "src7"]


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, weight double")


def modifiers(spark):
    return spark.createDataFrame(MODIFIERS, "prev string, factor double")


def scored_articles(spark, sf):
    return mt.score_sentiment(articles(spark, sf), lexicon(spark), modifiers(spark))


LEX = f"lex(token, weight) AS {values_sql(LEXICON)}, modi(prev, factor) AS {values_sql(MODIFIERS)}"
SCORED_A = f"""{LEX}, tok AS (SELECT article_id, string_split(trim({pad_sql(FULL)}), ' ') AS t FROM articles),
 pos AS (SELECT article_id, t, unnest(generate_series(1, len(t))) AS i FROM tok),
 pr AS (SELECT article_id, len(t) AS n, t[i] AS token, CASE WHEN i > 1 THEN t[i - 1] END AS prev FROM pos),
 hit AS (SELECT article_id, n, CAST(weight AS DOUBLE) * coalesce(CAST(factor AS DOUBLE), 1) AS w FROM pr JOIN lex USING (token) LEFT JOIN modi ON pr.prev = modi.prev),
 agg AS (SELECT article_id, sum(w) AS s, sum(greatest(w, 0)) AS p, sum(greatest(-w, 0)) AS m, max(n) - count(*) AS z FROM hit GROUP BY 1),
 scored_a AS (SELECT a.*, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS sentiment_compound, coalesce(p / (p + m + z), 0) AS sentiment_positive,
  coalesce(m / (p + m + z), 0) AS sentiment_negative, coalesce(z / (p + m + z), 1) AS sentiment_neutral FROM articles a LEFT JOIN agg USING (article_id))"""
SENT = ("sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_neutral")


@query("score_sentiment", f"WITH {ARTICLES}, {SCORED_A} SELECT article_id, {', '.join(f'{fxs(c)} AS {c}' for c in SENT)} FROM scored_a")
def score_sentiment(spark, sf):
    return fix(scored_articles(spark, sf).select("article_id", *SENT), *SENT)


LABEL = """CASE WHEN {c} >= 0.5 THEN 'Very Positive' WHEN {c} >= 0.05 THEN 'Positive' WHEN {c} <= -0.5 THEN 'Very Negative' WHEN {c} <= -0.05 THEN 'Negative' ELSE 'Neutral' END"""


@query("sentiment_label", f"WITH {NEWS} SELECT article_id, {LABEL.format(c=S)} AS sentiment_label FROM news_events")
def sentiment_label(spark, sf):
    return news(spark, sf).select("article_id", label_sentiment(F.col(S)).alias("sentiment_label"))


def class_sql(text):
    return "CASE " + " ".join(f"WHEN {any_sql(text, t)} THEN '{n}'" for n, t in TERMS.items()) + " ELSE 'low' END"


PADDED_A = f"pa AS (SELECT *, {pad_sql(FULL)} AS txt FROM articles)"
ALL_TERMS = [t for ts in TERMS.values() for t in ts]


@query("impact_level", f"WITH {ARTICLES}, {PADDED_A} SELECT article_id, {class_sql('txt')} AS impact_level FROM pa")
def impact_level(spark, sf):
    a = articles(spark, sf).select("article_id", mt.padded(mt.full_text()).alias("txt"))
    return a.select("article_id", mt.keyword_class(F.col("txt"), TERMS).alias("impact_level"))


REL_SQL = f"""least(1, 0.5 * CAST(article_id % 3 <> 0 AS INTEGER) + 0.3 * CAST(contains(source, 'src1') OR contains(source, 'src7') AS INTEGER)
 + least(0.2, 0.1 * {count_sql('txt', FIN)}) + least(0.2, 0.1 * {count_sql('txt', ALL_TERMS)}))"""


def flagged(spark, sf):
    """Articles with every third one without a ticker, scored for relevance and impact."""
    a = articles(spark, sf).withColumn("ticker", F.when(F.col("article_id") % 3 != 0, F.col("ticker")))
    return mt.relevance_flags(a, TERMS, FIN, STOP, SOURCES)


FLAGGED = f"""{PADDED_A}, fl0 AS (SELECT article_id, CASE WHEN article_id % 3 <> 0 THEN ticker END AS ticker, {REL_SQL} AS relevance_score, {any_sql('txt', STOP)} AS is_irrelevant, {class_sql('txt')} AS impact_level FROM pa),
 fl AS (SELECT *, CAST(relevance_score AS DOUBLE) >= 0.25 AND NOT is_irrelevant AS is_relevant, impact_level IN ('high', 'macro') AS is_impactful FROM fl0)"""


@query("relevance_score", f"WITH {ARTICLES}, {FLAGGED} SELECT article_id, {fxs('relevance_score')} AS relevance_score FROM fl")
def relevance_score(spark, sf):
    return fix(flagged(spark, sf).select("article_id", "relevance_score"), "relevance_score")


@query("is_irrelevant", f"WITH {ARTICLES}, {PADDED_A} SELECT article_id, {any_sql('txt', STOP)} AS is_irrelevant FROM pa")
def is_irrelevant(spark, sf):
    return articles(spark, sf).select("article_id", mt.any_term(mt.padded(mt.full_text()), STOP).alias("is_irrelevant"))


@query("relevance_flags", f"WITH {ARTICLES}, {FLAGGED} SELECT article_id, is_relevant, is_impactful, is_irrelevant FROM fl")
def relevance_flags(spark, sf):
    return flagged(spark, sf).select("article_id", "is_relevant", "is_impactful", "is_irrelevant")


@query(
    "keep_relevant",
    f"WITH {ARTICLES}, {FLAGGED} SELECT impact_level, count(*) AS n FROM fl WHERE (is_relevant OR is_impactful OR ticker IS NOT NULL OR CAST(relevance_score AS DOUBLE) >= 0.25) AND NOT is_irrelevant GROUP BY 1",
)
def keep_relevant(spark, sf):
    return mt.keep_relevant(flagged(spark, sf)).groupBy("impact_level").agg(F.count("*").alias("n"))


@query("is_reputable", "SELECT doc_id, contains(lower(source), 'src1') OR contains(lower(source), 'src7') AS is_reputable FROM documents")
def is_reputable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mt.is_reputable(F.col("source"), SOURCES).alias("is_reputable"))


CATS = {"alpha": ["the", "thon"], "beta": ["of the", "les"], "gamma": ["worthless"]}


@query(
    "keyword_flags",
    f"WITH {ARTICLES}, p AS (SELECT article_id, {pad_sql('title')} AS t FROM articles) SELECT article_id, "
    + ", ".join(f"CAST({any_sql('t', ts)} AS INTEGER) AS kw_{n}" for n, ts in CATS.items())
    + " FROM p",
)
def keyword_flags(spark, sf):
    return mt.keyword_flags(articles(spark, sf), "title", CATS).select("article_id", *[f"kw_{n}" for n in CATS])


@query(
    "keyword_category_stats",
    f"WITH {ARTICLES}, {SCORED_A}, p AS (SELECT sentiment_compound AS s, {class_sql(pad_sql(FULL))} AS impact_level, {pad_sql('title')} AS t FROM scored_a) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS category, count(*) AS matches, {fxs('avg(s)')} AS avg_sentiment, {fxs('''avg(CASE WHEN impact_level = 'high' THEN 100 ELSE 0 END)''')} AS high_impact_pct FROM p WHERE {any_sql('t', ts)} HAVING count(*) > 0"
        for n, ts in CATS.items()
    ),
)
def keyword_category(spark, sf):
    a = scored_articles(spark, sf).withColumn("impact_level", mt.keyword_class(mt.padded(mt.full_text()), TERMS))
    return fix(keyword_category_stats(a, CATS), "avg_sentiment", "high_impact_pct")


@query(
    "term_hits",
    f"WITH {ARTICLES}, {PADDED_A}, v(term) AS {values_sql([(mt.fold_term(t).strip(),) for t in ALL_TERMS + FIN])} SELECT article_id, term FROM pa JOIN v ON contains(txt, ' ' || term || ' ')",
)
def term_hits(spark, sf):
    terms = spark.createDataFrame([(mt.fold_term(t).strip(),) for t in ALL_TERMS + FIN], "term string")
    a = articles(spark, sf).select("article_id", mt.full_text().alias("txt"))
    return mt.term_hits(a, "txt", terms, "article_id", 2)


def letters_sql(letters):
    return "(" + " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in letters) + ")"


@query(
    "score_with_model",
    f"""WITH {ARTICLES}, x AS (SELECT article_id, {FULL} AS t FROM articles),
 s AS (SELECT article_id, {letters_sql('aeiou')} / greatest(length(t), 1) AS p, {letters_sql('nrst')} / greatest(length(t), 1) AS m FROM x)
SELECT article_id, {fxs('p')} AS sentiment_positive, {fxs('m')} AS sentiment_negative, {fxs('1 - p - m')} AS sentiment_neutral, {fxs('p - m')} AS sentiment_compound FROM s""",
)
def score_with_model(spark, sf):
    # a stand-in scorer: shares of vowels and consonants of each whole text
    def scorer(texts):
        out = []
        for t in texts:
            n = max(len(t), 1)
            pos = sum(t.count(v) for v in "aeiou") / n
            neg = sum(t.count(v) for v in "nrst") / n
            out.append((pos, neg, 1 - pos - neg))
        return out

    cols = ("sentiment_positive", "sentiment_negative", "sentiment_neutral", S)
    return fix(mt.score_with_model(articles(spark, sf), scorer), *cols)


@query(
    "score_with_fallback",
    f"""WITH {ARTICLES}, {SCORED_A}, x AS (SELECT *, {FULL} AS t FROM scored_a),
 s AS (SELECT *, length(t) % 3 = 0 AS broken, {letters_sql('aeiou')} / greatest(length(t), 1) AS p, {letters_sql('nrst')} / greatest(length(t), 1) AS m FROM x)
SELECT article_id, {fxs('CASE WHEN broken THEN sentiment_positive ELSE p END')} AS sentiment_positive, {fxs('CASE WHEN broken THEN sentiment_negative ELSE m END')} AS sentiment_negative,
 {fxs('CASE WHEN broken THEN sentiment_neutral ELSE 1 - p - m END')} AS sentiment_neutral, {fxs('CASE WHEN broken THEN sentiment_compound ELSE p - m END')} AS sentiment_compound,
 CASE WHEN broken THEN 'lexicon' ELSE 'model' END AS scored_by FROM s""",
)
def score_with_fallback(spark, sf):
    """The stand-in scorer fails on any batch that holds a text whose length is a multiple of three."""

    def load():
        def scorer(texts):
            if any(len(t) % 3 == 0 for t in texts):
                raise RuntimeError("the model does not answer")
            shares = [(sum(map(t.count, "aeiou")) / max(len(t), 1), sum(map(t.count, "nrst")) / max(len(t), 1)) for t in texts]
            return [(p, n, 1 - p - n) for p, n in shares]

        return scorer

    out = mt.score_with_fallback(articles(spark, sf), load, lexicon(spark), modifiers(spark))
    cols = ("sentiment_positive", "sentiment_negative", "sentiment_neutral", S)
    return fix(out.select("article_id", *cols, "scored_by"), *cols)


# ---- symbols and names -------------------------------------------------------------------------

UNIVERSE = ["THE", "OF", "TH", "ER", "AN", "ERIN", "THON", "THAN", "LES", "UND", "POR", "ING", "NT", "RE", "DE"]
UNI = f"uni(ticker) AS {values_sql([(u,) for u in UNIVERSE])}"


def universe(spark):
    return spark.createDataFrame([(u,) for u in UNIVERSE], "ticker string")


# runs of letters and digits joined by single dots or dashes; a two-part run ending in
# one letter is a share class, any other run counts part by part


def symbols_sql(c):
    run = rf"regexp_extract_all(upper({c}), '[\p{{L}}\p{{N}}]+(?:[.\-][\p{{L}}\p{{N}}]+)*')"
    parts = rf"flatten(list_transform({run}, lambda r: CASE WHEN regexp_full_match(r, '[A-Z]{{1,5}}[.\-][A-Z]') THEN [replace(r, '.', '-')] ELSE string_split(replace(r, '.', '-'), '-') END))"
    return rf"list_filter({parts}, lambda p: regexp_full_match(p, '[A-Z]{{1,5}}(-[A-Z])?'))"


@query(
    "extract_tickers",
    f"WITH {ARTICLES}, {UNI}, s AS (SELECT article_id, unnest(list_distinct({symbols_sql(FULL)})) AS ticker FROM articles) SELECT article_id, ticker FROM s JOIN uni USING (ticker)",
)
def extract_tickers(spark, sf):
    return mt.extract_tickers(articles(spark, sf), universe(spark), mt.full_text()).select("article_id", "ticker")


@query(
    "assign_ticker",
    f"""WITH {ARTICLES}, {UNI}, s AS (SELECT article_id, 0 AS part, unnest({symbols_sql('title')}) AS ticker FROM articles UNION ALL SELECT article_id, 1, unnest({symbols_sql('description')}) FROM articles),
 r AS (SELECT article_id, ticker, row_number() OVER (PARTITION BY article_id ORDER BY part, length(ticker) DESC, ticker) AS rn FROM s JOIN uni USING (ticker) WHERE length(ticker) > 1)
SELECT article_id, ticker FROM r WHERE rn = 1""",
)
def assign_ticker(spark, sf):
    return mt.assign_ticker(articles(spark, sf), universe(spark))


@query(
    "mentions",
    f"""WITH {ARTICLES}, u AS (SELECT * FROM (VALUES ('THE'), ('OF'), ('S3'), ('S4')) v(ticker)), s AS (SELECT article_id, ticker FROM articles UNION SELECT article_id, unnest({symbols_sql('title')}) FROM articles)
SELECT article_id, ticker FROM s JOIN u USING (ticker)""",
)
def mentions(spark, sf):
    u = spark.createDataFrame([("THE",), ("OF",), ("S3",), ("S4",)], "ticker string")
    return mt.mentions(articles(spark, sf), u)


@query(
    "mentions_substring",
    f"""WITH {ARTICLES}, u AS (SELECT * FROM (VALUES ('THE'), ('ON'), ('ERIN'), ('S3'), ('S4')) v(ticker))
SELECT DISTINCT article_id, u.ticker FROM articles a JOIN u ON a.ticker = u.ticker OR contains(upper(title), u.ticker)""",
)
def mentions_substring(spark, sf):
    u = spark.createDataFrame([("THE",), ("ON",), ("ERIN",), ("S3",), ("S4",)], "ticker string")
    return mt.mentions(articles(spark, sf), u, substring=4)


@query(
    "related_news",
    f"WITH {ARTICLES}, {PADDED_A} SELECT article_id, date FROM pa WHERE ticker = 'THON' OR contains(txt, ' thon ') ORDER BY date DESC, article_id LIMIT 5",
)
def related_news(spark, sf):
    return mt.related_news(articles(spark, sf), "THON").select("article_id", "date")


ENT = {"country": ["thon", "of the", "la"], "commodity": ["worthless", "inoran", "erin"]}


@query(
    "extract_entities",
    f"WITH {ARTICLES}, {PADDED_A} "
    + " UNION ALL ".join(
        f"SELECT article_id, '{k}' AS kind, '{n}' AS name FROM pa WHERE {any_sql('txt', [n])}" for k, ns in ENT.items() for n in ns
    ),
)
def extract_entities(spark, sf):
    return mt.extract_entities(articles(spark, sf), ENT)


@query(
    "resolve_company",
    rf"""WITH {DIM}, a AS (SELECT ticker, trim({pad_sql('company_name')}) AS n FROM ticker_dim), t AS (SELECT DISTINCT term, trim({pad_sql('term')}) AS q FROM (
  SELECT c_name AS term FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT s_name || ' Holdings' FROM supplier) x),
 c AS (SELECT term, ticker, n, CASE WHEN q = n THEN 0 ELSE 1 END AS rank FROM t JOIN a ON contains(' ' || q || ' ', ' ' || n || ' ') OR contains(' ' || n || ' ', ' ' || q || ' ')),
 b AS (SELECT term, ticker, row_number() OVER (PARTITION BY term ORDER BY rank, n, ticker) AS rn FROM c)
SELECT t.term, coalesce(b.ticker, upper(trim(t.term))) AS ticker FROM t LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON t.term = b.term""",
)
def resolve_company(spark, sf):
    s = table(spark, sf, "supplier")
    terms = (
        table(spark, sf, "customer").select(F.col("c_name").alias("term"))
        .union(s.select("s_name"))
        .union(s.select(F.concat("s_name", F.lit(" Holdings"))))
        .distinct()
    )
    aliases = ticker_dim(spark, sf).select(F.col("company_name").alias("name"), "ticker")
    return mt.resolve_company(terms, aliases)


# ---- rules --------------------------------------------------------------------------------------

RULES = [
    rl.Rule(r"\bthon\b.*\bthe\b", "AFRICA", "positive", "thon before the", True),
    rl.Rule(r"\bworthless\b", "ASIA", "negative", "worthless"),
    rl.Rule(r"\b(thing|inoran)\b", "EUROPE", "positive", "thing or inoran"),
    rl.Rule(r"\berin\b", "AMERICA", "negative", "erin", True),
]
COMPOUND = [
    rl.CompoundRule((("the", "la"), ("thon", "les"), ("of", "de")), "ASIA", "positive", "three kinds"),
    rl.CompoundRule((("worthless",), ("erin", "thing")), "EUROPE", "negative", "two kinds"),
]


def rule_test(r):
    return f"regexp_matches({FULL}, '(?i){r.pattern}')"


HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT article_id, ticker, {i} AS rule_id, '{r.sector}' AS sector, '{r.direction}' AS direction, '{r.reason}' AS reason, {r.specific} AS specific FROM articles WHERE {rule_test(r)}"
    for i, r in enumerate(RULES)
) + ")"
SECTORS = f"{DIM}, smap AS (SELECT sector, ticker FROM ticker_dim)"


def sector_map(spark, sf):
    return ticker_dim(spark, sf).select("sector", "ticker")


def rated(spark, sf):
    a = scored_articles(spark, sf)
    return a.withColumn("impact_level", mt.keyword_class(mt.padded(mt.full_text()), TERMS))


RATED = f"{SCORED_A}, rated AS (SELECT *, {class_sql(pad_sql(FULL))} AS impact_level FROM scored_a)"


@query("match_rules", f"WITH {ARTICLES}, {HITS} SELECT article_id, rule_id, sector, direction AS rule_direction, reason, specific FROM hits")
def match_rules(spark, sf):
    return rl.match_rules(articles(spark, sf), RULES).drop("n_hits")


@query("sector_fanout", f"WITH {ARTICLES}, {SECTORS}, {HITS} SELECT article_id, rule_id, smap.ticker FROM hits JOIN smap USING (sector)")
def sector_fanout(spark, sf):
    return rl.sector_fanout(rl.match_rules(articles(spark, sf), RULES), sector_map(spark, sf)).select("article_id", "rule_id", "ticker")


LEAN = f"CASE WHEN {S} > 0.05 THEN 'positive' WHEN {S} < -0.05 THEN 'negative' ELSE 'neutral' END"


@query(
    "direct_impact",
    f"WITH {ARTICLES}, {SCORED_A} SELECT article_id, ticker, {LEAN} AS direction, {fxs(f'least(0.85, 0.7 + 0.115 * abs({S}))')} AS confidence FROM scored_a",
)
def direct_impact(spark, sf):
    return fix(rl.direct_impact(scored_articles(spark, sf)).select("article_id", "ticker", "direction", "confidence"), "confidence")


MACRO_TERMS = ["the", "les", "und"]
MAJOR = ["ASIA", "EUROPE"]


@query(
    "macro_broadcast",
    f"""WITH {ARTICLES}, {SECTORS}, {RATED} SELECT article_id, m.ticker, {LEAN} AS direction, 0.6 AS confidence FROM rated r, smap m
WHERE impact_level = 'macro' AND {any_sql(pad_sql(FULL), MACRO_TERMS)} AND m.sector IN ('ASIA', 'EUROPE')""".replace("0.6 AS", "CAST(0.6 AS DOUBLE) AS"),
)
def macro_broadcast(spark, sf):
    out = rl.macro_broadcast(rated(spark, sf), sector_map(spark, sf), MACRO_TERMS, MAJOR)
    return out.select("article_id", "ticker", "direction", "confidence")


CONF_SQL = f"""greatest(0.30, least(0.85, 0.45 + CASE impact_level WHEN 'high' THEN 0.15 WHEN 'macro' THEN 0.125 WHEN 'medium' THEN 0.08 ELSE 0 END
 + CASE WHEN specific THEN 0.075 ELSE 0 END + CASE WHEN n >= 3 THEN 0.065 WHEN n >= 2 THEN 0.035 ELSE 0 END + CASE WHEN sector = 'ASIA' THEN 0.04 ELSE 0 END
 + CASE WHEN abs({S}) > 0.7 THEN 0.08 WHEN abs({S}) > 0.5 THEN 0.05 WHEN abs({S}) > 0.3 THEN 0.025 ELSE 0 END))"""
IMPACT = f"""{HITS}, ri AS (SELECT h.article_id, m.ticker, h.direction, h.reason, h.rule_id, CAST({CONF_SQL} AS DOUBLE) AS confidence FROM (
  SELECT h0.*, impact_level, {S}, count(*) OVER (PARTITION BY h0.article_id) AS n FROM hits h0 JOIN rated USING (article_id)) h JOIN smap m USING (sector)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, ticker, direction ORDER BY confidence DESC, rule_id) AS rn FROM (
  SELECT article_id, ticker, direction, reason, rule_id, floor(confidence * 1e6 + 0.5001) / 1e6 AS confidence FROM ri) q) x WHERE rn = 1)"""


def sector_rows(spark, sf):
    return fix(rl.sector_impact(rated(spark, sf), RULES, ["ASIA"]), "confidence")


@query("impact_confidence", f"WITH {ARTICLES}, {SECTORS}, {RATED}, {IMPACT} SELECT article_id, ticker, direction, rule_id, {fxs('confidence')} AS confidence FROM ri")
def impact_confidence(spark, sf):
    out = rl.rule_impact(rated(spark, sf), RULES, sector_map(spark, sf), ["ASIA"])
    return fix(out.drop("reason"), "confidence")


@query("best_impact", f"WITH {ARTICLES}, {SECTORS}, {RATED}, {IMPACT} SELECT article_id, ticker, direction, reason, confidence, rule_id FROM best")
def best_impact(spark, sf):
    return rl.best_by_ticker(sector_rows(spark, sf), sector_map(spark, sf))


@query(
    "impact_summary",
    f"""WITH {ARTICLES}, {SECTORS}, {RATED}, {IMPACT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY article_id, direction ORDER BY confidence DESC, ticker) AS INTEGER) AS rank FROM best)
SELECT article_id, direction, ticker, confidence, rank FROM r WHERE rank <= 10""",
)
def impact_summary(spark, sf):
    return rl.impact_summary(sector_rows(spark, sf), sector_map(spark, sf))


@query("sectors_hit", f"WITH {ARTICLES}, {HITS} SELECT DISTINCT article_id, sector FROM hits")
def sectors_hit(spark, sf):
    return rl.sectors_hit(rl.match_rules(articles(spark, sf), RULES))


@query(
    "article_confidence",
    f"""WITH {ARTICLES}, {RATED}, {HITS}, c AS (SELECT article_id, count(*) AS n FROM hits GROUP BY 1)
SELECT article_id, {fxs(f'''greatest(0.30, least(0.85, 0.45 + CASE impact_level WHEN 'high' THEN 0.2 WHEN 'macro' THEN 0.16 WHEN 'medium' THEN 0.09 ELSE 0 END
 + CASE WHEN n >= 3 THEN 0.125 WHEN n >= 2 THEN 0.09 WHEN n >= 1 THEN 0.04 ELSE 0 END + 0.16 + CASE WHEN abs({S}) > 0.5 THEN 0.09 WHEN abs({S}) > 0.3 THEN 0.04 ELSE 0 END))''')} AS confidence
FROM rated LEFT JOIN c USING (article_id)""",
)
def article_confidence(spark, sf):
    n = rl.match_rules(articles(spark, sf), RULES).groupBy("article_id").agg(F.count("*").alias("n"))
    a = rated(spark, sf).select("article_id", "ticker", "impact_level", S).join(n, "article_id", "left")
    conf = rl.article_confidence(F.col("impact_level"), F.coalesce(F.col("n"), F.lit(0)), F.col("ticker").isNotNull(), F.col(S))
    return fix(a.select("article_id", conf.alias("confidence")), "confidence")


@query(
    "compound_rules",
    f"WITH {ARTICLES}, {PADDED_A} "
    + " UNION ALL ".join(
        f"SELECT article_id, {i} AS rule_id, '{r.sector}' AS sector, '{r.direction}' AS rule_direction FROM pa WHERE {' AND '.join(any_sql('txt', g) for g in r.all_of)}"
        for i, r in enumerate(COMPOUND)
    ),
)
def compound_rules(spark, sf):
    return rl.compound_rules(articles(spark, sf), COMPOUND).select("article_id", "rule_id", "sector", "rule_direction")


# ---- duplicates ----------------------------------------------------------------------------------



def feed(spark, sf):
    return articles(spark, sf).withColumn("url", F.concat(F.lit("https://example.com/"), "lang", F.lit("/?id="), F.col("article_id")))


@query(
    "dedupe_exact",
    f"""WITH {ARTICLES}, k AS (SELECT article_id, lower(trim(title, ' ')) AS t, row_number() OVER (PARTITION BY lang, lower(trim(title, ' ')) ORDER BY article_id) AS rn FROM articles)
SELECT article_id FROM k WHERE rn = 1 OR t = ''""",
)
def dedupe_exact(spark, sf):
    return dd.dedupe_exact(feed(spark, sf)).select("article_id")


@query(
    "dedupe_title_cap",
    f"""WITH {ARTICLES}, k AS (SELECT article_id, lower(trim(title, ' ')) AS t, row_number() OVER (PARTITION BY lower(trim(title, ' ')) ORDER BY article_id) AS rn FROM articles)
SELECT article_id FROM k WHERE rn = 1 OR t = ''""",
)
def dedupe_title_cap(spark, sf):
    return dd.dedupe_titles(articles(spark, sf)).select("article_id")


# first-come-first-kept over the similar pairs, one node at a time
FUZZY = f"""WITH RECURSIVE {ARTICLES}, t AS (SELECT article_id, trim({pad_sql('title')}) AS f FROM articles WHERE length(title) >= 10),
 reps AS (SELECT min(article_id) AS id, f FROM t WHERE f <> '' GROUP BY f), s AS (SELECT id, list_distinct(string_split(f, ' ')) AS w FROM reps),
 e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND len(a.w) * 0.74 <= len(b.w) + 1 AND len(b.w) * 0.74 <= len(a.w) + 1
  WHERE 2.0 * len(list_intersect(a.w, b.w)) >= 0.85 * (len(a.w) + len(b.w)) - 1e-9),
 nodes AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT a AS n FROM e UNION SELECT b FROM e) x),
 pre AS (SELECT i, n, coalesce((SELECT list(a) FROM e WHERE b = n), []) AS earlier FROM nodes),
 g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT p.i, CASE WHEN list_has_any(p.earlier, g.kept) THEN g.kept ELSE list_append(g.kept, p.n) END FROM g JOIN pre p ON p.i = g.i + 1),
 last AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1)
SELECT id AS article_id FROM reps WHERE id NOT IN (SELECT n FROM nodes) OR list_contains((SELECT kept FROM last), id)
UNION ALL SELECT article_id FROM articles WHERE NOT coalesce(length(title) >= 10 AND trim({pad_sql('title')}) <> '', FALSE)"""


@query("dedupe_fuzzy", FUZZY)
def dedupe_fuzzy(spark, sf):
    return dd.dedupe_fuzzy(articles(spark, sf)).select("article_id")


# the same with edits of characters; every character becomes one byte first, since levenshtein counts bytes here
SIMILAR = f"""WITH RECURSIVE {ARTICLES}, t AS (SELECT article_id, lower(trim(coalesce(title, ''), ' ')) AS t FROM articles),
 long AS (SELECT t, min(article_id) AS id FROM t WHERE length(t) >= 10 GROUP BY t),
 chars AS (SELECT list(DISTINCT c) AS cs FROM (SELECT unnest(string_split(t, '')) AS c FROM long) x),
 reps AS (SELECT id, length(t) AS n, array_to_string(list_transform(string_split(t, ''), lambda c: chr(CAST(list_position(cs, c) AS INTEGER))), '') AS f FROM long, chars),
 e AS (SELECT a.id AS a, b.id AS b FROM reps a JOIN reps b ON a.id < b.id AND abs(a.n - b.n) <= floor(greatest(a.n, b.n) * 0.15 + 1e-9)
  WHERE levenshtein(a.f, b.f) <= floor(greatest(a.n, b.n) * 0.15 + 1e-9)),
 nodes AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT a AS n FROM e UNION SELECT b FROM e) x),
 pre AS (SELECT i, n, coalesce((SELECT list(a) FROM e WHERE b = n), []) AS earlier FROM nodes),
 g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT p.i, CASE WHEN list_has_any(p.earlier, g.kept) THEN g.kept ELSE list_append(g.kept, p.n) END FROM g JOIN pre p ON p.i = g.i + 1),
 last AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1)
SELECT id AS article_id FROM reps WHERE id NOT IN (SELECT n FROM nodes) OR list_contains((SELECT kept FROM last), id)
UNION ALL SELECT article_id FROM t WHERE length(t) < 10"""


@query("dedupe_similar", SIMILAR)
def dedupe_similar(spark, sf):
    return dd.dedupe_similar(articles(spark, sf)).select("article_id")


# ---- whole articles: flags of the title next to scores of the text --------------------------------

WHOLE_A = f"""{SCORED_A}, {PADDED_A}, whole AS (SELECT s.*, {REL_SQL.replace('article_id', 's.article_id').replace('source', 's.source')} AS relevance_score, {class_sql('txt')} AS impact_level,
 CAST(s.date AS TIMESTAMP) AS event_time, {pad_sql('s.title')} AS t FROM scored_a s JOIN pa ON s.article_id = pa.article_id)"""


def whole_articles(spark, sf):
    """Articles, every third without a ticker, with sentiment, impact and relevance of the whole text.

    Stored without the text behind the title: what is made of these reads them several times, which would score the texts as often.
    """
    rows = mt.score_sentiment(articles(spark, sf), lexicon(spark), modifiers(spark)).withColumn("_t", F.col("ticker"))
    rows = rows.withColumn("ticker", F.when(F.col("article_id") % 3 != 0, F.col("ticker")))
    rows = mt.relevance_flags(rows, TERMS, FIN, STOP, SOURCES).withColumn("ticker", F.col("_t")).drop("_t")
    return checkpointed(rows.withColumn("event_time", F.col("date").cast("timestamp")).drop("description"))


@query(
    "article_features_keywords",
    f"WITH {ARTICLES}, {WHOLE_A} SELECT article_id, "
    + ", ".join(f"CAST({any_sql('t', ts)} AS INTEGER) AS has_{n}" for n, ts in CATS.items())
    + f", {fxs(f'{S} * abs({S})')} AS sentiment_momentum, {fxs(f'avg({S}) OVER g')} AS daily_avg_sentiment, {fxs('avg(CAST(relevance_score AS DOUBLE)) OVER g')} AS daily_avg_relevance,"
    + " count(*) FILTER (impact_level = 'high') OVER g AS daily_high_impact FROM whole WINDOW g AS (PARTITION BY ticker, date)",
)
def article_features_keywords(spark, sf):
    from tapewire.operators.features import article_features

    cols = ("sentiment_momentum", "daily_avg_sentiment", "daily_avg_relevance")
    out = article_features(whole_articles(spark, sf), categories=CATS)
    return fix(out, *cols).select("article_id", *[f"has_{n}" for n in CATS], *cols, "daily_high_impact")


@query(
    "pattern_report_keywords",
    f"WITH {ARTICLES}, {WHOLE_A} "
    + " UNION ALL ".join(
        f"SELECT 'keyword' AS pattern, '{n}' AS key, '{m}' AS metric, {fxs(e)} AS value FROM whole WHERE {any_sql('t', ts)} HAVING count(*) > 0"
        for n, ts in CATS.items()
        for m, e in {"n": "count(*)", "avg_sentiment": f"avg({S})", "high_impact_pct": "avg(CASE WHEN impact_level = 'high' THEN 100 ELSE 0 END)"}.items()
    )
    + f""" UNION ALL SELECT 'verdict', CASE WHEN p > 0.6 THEN 'bullish' WHEN q > 0.6 THEN 'bearish' ELSE 'mixed' END, m, v FROM (
 SELECT p, q, unnest(['positive_share', 'negative_share']) AS m, unnest([{fxs('p')}, {fxs('q')}]) AS v FROM (
  SELECT avg(CASE WHEN {S} > 0.05 THEN 1 ELSE 0 END) AS p, avg(CASE WHEN {S} < -0.05 THEN 1 ELSE 0 END) AS q FROM whole) x) y""",
)
def pattern_report_keywords(spark, sf):
    from tapewire.operators.aggregates import pattern_report

    out = pattern_report(whole_articles(spark, sf), CATS).where("pattern in ('keyword', 'verdict')")
    return fix(out, "value")
