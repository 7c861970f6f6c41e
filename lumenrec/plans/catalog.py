"""The registry: every operator as a query over the driver's tables, and the same in SQL where SQL can express it.

Searches take every row whose id is divisible by 100 as a query and look through all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chatlog, clean, dialogue, features, fuzzy, similarity, stats
from ..sources.files import read_csv, run_sql, table, with_row_id, work_path, write_csv
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The two vocabularies that part names are made of; they play the genres.
GENRES = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
SENTINEL = "ECONOMY"
PRIORITIES = {"1-URGENT": 0, "2-HIGH": 7, "3-MEDIUM": 13, "4-NOT SPECIFIED": 18, "5-LOW": 18}
CUT = "2024-01-02"
TEXTS = {"signup": "/start", "view": "/help", "click": "a title", "error": "/cancel"}
MENU_TEXTS = {"signup": "/helpme", "view": "Rate anime", "click": "some words", "error": "Done", "purchase": "/help"}
ROUTES = [("^signup$", "start"), ("^(view|error)$", "help"), ("^purchase$", "callback"), ("^[a-z]+$", "title")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with its sentinel as NULL."""
    return clean.sentinel_to_null(_parts(spark, sf_dir), SENTINEL)


def _genres() -> Column:
    return S.split_list(F.col("p_name"), " ")


# --- projections, filters, missing values ------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def scan_project(spark, sf_dir):
    return clean.drop_columns(_parts(spark, sf_dir), "p_type", "p_retailprice")


@query("SELECT p_partkey, nullif(p_name, 'ECONOMY') AS p_name, nullif(p_brand, 'ECONOMY') AS p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_size, p_retailprice FROM part")
def null_sentinel(spark, sf_dir):
    return _marked(spark, sf_dir)


@query("SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'Unknown') AS p_type FROM part")
def fill_null(spark, sf_dir):
    return clean.fill_null(_marked(spark, sf_dir), "p_type", S.UNKNOWN).select("p_partkey", "p_type")


@query("SELECT * FROM part WHERE p_type <> 'ECONOMY'")
def drop_null(spark, sf_dir):
    return clean.drop_null(_marked(spark, sf_dir))


@query("SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), p_name) AS title FROM part")
def coalesce_name(spark, sf_dir):
    return clean.prefer(_marked(spark, sf_dir), "p_type", "p_name", "title").select("p_partkey", "title")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'red widget' ORDER BY p_partkey LIMIT 1")
def lookup_item(spark, sf_dir):
    return clean.lookup(_parts(spark, sf_dir), "p_name", "red widget", "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("""
SELECT 'value_text' AS column_name, count(*) FILTER (value IS NOT NULL AND try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NULL) AS n_bad FROM events
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NOT NULL AND try_cast(event_type AS DOUBLE) IS NULL) FROM events
UNION ALL SELECT 'props', count(*) FILTER (props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL) FROM events""")
def infer_numeric(spark, sf_dir):
    return clean.uncastable(table(spark, sf_dir, "events").select(F.col("value").cast("string").alias("value_text"), "event_type", "props"))


@query("SELECT p_partkey, p_type FROM part WHERE p_size > 40 AND p_type IN ('SMALL', 'LARGE')")
def filter_project(spark, sf_dir):
    return _parts(spark, sf_dir).filter("p_size > 40 and p_type in ('SMALL', 'LARGE')").select("p_partkey", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def drop_family(spark, sf_dir):
    """A generated family of columns beside those that stay."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return clean.drop_family(rows.withColumns({f"score-{i}": F.col("l_quantity") * i for i in range(1, 11)}), "score-", 1, 10)


@query("SELECT p_partkey, " + ", ".join(f"CAST(list_contains(string_split(p_name, ' '), '{g}') AS INTEGER) AS {g}" for g in GENRES[3:9]) + " FROM part")
def label_slice(spark, sf_dir):
    marked = features.onehot(_parts(spark, sf_dir).select("p_partkey", "p_name"), _genres(), GENRES)
    return marked.select("p_partkey", *clean.label_slice(marked, GENRES[3], GENRES[8]))


@query("SELECT 'numeric' AS kind, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_partkey', 'l_suppkey', 'l_linenumber']) AS column_name UNION ALL SELECT 'categorical', unnest(['l_returnflag', 'l_linestatus'])")
def column_classes(spark, sf_dir):
    numeric, rest = clean.column_classes(table(spark, sf_dir, "lineitem"), "l_orderkey", {"l_shipdate"})
    return spark.createDataFrame([("numeric", c) for c in numeric] + [("categorical", c) for c in rest], "kind string, column_name string")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf_dir):
    path = work_path(spark, "csv")
    rows = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


# --- joins --------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return clean.join_inner(orders, table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    return clean.join_left(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query(f"""
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events
WHERE ts >= TIMESTAMP '{CUT}' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '{CUT}') GROUP BY user_id""")
def anti_insert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    seen = events.filter(F.col("ts") < cut).select("user_id").distinct()
    return chatlog.unseen(events.filter(F.col("ts") >= cut), seen, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- scalar functions ----------------------------------------------------------


def _aired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "orders"), S.without_commas(F.date_format("o_orderdate", "MMM d, yyyy"))


@query("SELECT o_orderkey, replace(strftime(o_orderdate, '%b %-d, %Y'), ',', '') AS aired FROM orders")
def parse_aired(spark, sf_dir):
    orders, aired = _aired(spark, sf_dir)
    return orders.select("o_orderkey", aired.alias("aired"))


@query("""
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring'
WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM orders""")
def map_season(spark, sf_dir):
    orders, aired = _aired(spark, sf_dir)
    return orders.select("o_orderkey", S.season(aired).alias("season"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def extract_year(spark, sf_dir):
    orders, aired = _aired(spark, sf_dir)
    return orders.select("o_orderkey", S.year(aired).alias("year"))


@query("SELECT o_orderkey, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 7 WHEN '3' THEN 13 ELSE 18 END AS INTEGER) AS age FROM orders")
def map_rating(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.mapped_or_error(F.col("o_orderpriority"), PRIORITIES, "priority").alias("age"))


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN p_size * 60 WHEN 1 THEN 3600 + p_size * 60 ELSE p_size END AS INTEGER) AS duration_s FROM part")
def parse_duration(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" min. per ep."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("1 hr. "), size, F.lit(" min."))).otherwise(F.concat(size, F.lit(" sec.")))
    return _parts(spark, sf_dir).select("p_partkey", S.duration_seconds(text).alias("duration_s"))


@query(r"""
SELECT doc_id, regexp_replace(lower('text ' || replace(replace(replace(replace(text, '\', ''), chr(10), 'n'), chr(13), 'r'), chr(9), 't') || ' lang ' || lang || ' source ' || source || ' n_chars ' || CAST(n_chars AS VARCHAR)),
'[^\p{L}\p{N}_\s]', '', 'g') AS full_text FROM documents""")
def doc_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.doc_text(docs, ["text", "lang", "source", "n_chars"]).alias("full_text"))


@query(r"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[len(t)] AS last_token
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents)""")
def tokenize(spark, sf_dir):
    t = S.tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


# --- vocabulary, indicators, vectors -------------------------------------------


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS genre FROM part")
def genre_vocab(spark, sf_dir):
    return features.vocabulary(_parts(spark, sf_dir), _genres())


@query("SELECT p_partkey, " + ", ".join(f"CAST(list_contains(string_split(p_name, ' '), '{g}') AS INTEGER) AS {g}" for g in GENRES) + " FROM part")
def onehot(spark, sf_dir):
    return features.onehot(_parts(spark, sf_dir).select("p_partkey", "p_name"), _genres(), GENRES).drop("p_name")


@query("SELECT genre, count(*) AS cnt FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS genre FROM part) GROUP BY genre")
def genre_counts(spark, sf_dir):
    return features.genre_counts(_parts(spark, sf_dir), _genres())


@query("SELECT genre, count(*) AS cnt FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS genre FROM part) GROUP BY genre ORDER BY cnt DESC, genre DESC LIMIT 5")
def genre_top5(spark, sf_dir):
    return features.top_genres(genre_counts(spark, sf_dir))


@query("SELECT DISTINCT p_type FROM part WHERE p_type <> 'ECONOMY'")
def distinct_values(spark, sf_dir):
    return _marked(spark, sf_dir).select("p_type").filter("p_type is not null").distinct()


@query(r"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
v AS (SELECT token, vec FROM (SELECT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM e) AS vec_id
  FROM (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS token FROM conversations) WHERE token <> '') JOIN e USING (vec_id)),
c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS hits, """ + ", ".join(f"sum(vec[{i + 1}] * n) AS v{i}" for i in range(64)) + r""" FROM c JOIN v USING (token) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(hits, 0) AS BIGINT) AS hits, """ + ", ".join(f"round(coalesce(v{i}, 0), 4) + 0.0 AS v{i}" for i in range(64)) + " FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id")
def embed_sum(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = vectors.count()
    words = table(spark, sf_dir, "conversations").select(F.explode(S.tokens(F.col("text"))).alias("token")).distinct()
    number = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long") % n
    vocabulary = words.withColumn("vec_id", number).join(vectors, "vec_id").select("token", "vec")
    sums = features.embed_sum(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, 64)
    return sums.select("doc_id", "hits", *((F.round(F.get("vec", F.lit(i)), 4) + 0.0).alias(f"v{i}") for i in range(64)))


# --- similarity ------------------------------------------------------------------


def _queries_of(items: DataFrame) -> DataFrame:
    return items.filter("vec_id % 100 = 0")


_PAIRS = "SELECT q.vec_id AS q, i.vec_id AS m, {} AS sim FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0"
_COSINE = _PAIRS.format("round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 0), 12)")
_EUCLID = _PAIRS.format("round(-list_distance(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 12)")
_RANKED = "SELECT q, m, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM ({})"
_TOP = "SELECT q, m, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM ({}) WHERE rank BETWEEN 2 AND 100"


@query(f"SELECT q, m, round(sim, 6) + 0.0 AS sim FROM ({_COSINE})")
def cosine_matrix(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return similarity.similarity_rows(items, _queries_of(items)).withColumn("sim", F.round("sim", 6) + 0.0)


@query(_TOP.format(_RANKED.format(_COSINE)))
def cosine_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return rounded(similarity.neighbours(items, _queries_of(items)), 6, "sim")


@query(_TOP.format(_RANKED.format(_EUCLID)))
def euclid_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return rounded(similarity.neighbours(items, _queries_of(items), metric="euclidean"), 6, "sim")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _parts(spark, sf_dir).select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("year"))
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster").join(part, "vec_id", "left")


@query(f"""
SELECT q, CAST(pos AS INTEGER) AS pos, vec_id, title, score, year FROM (
  SELECT r.q, i.vec_id, p_name AS title, p_retailprice AS score, p_size AS year,
    row_number() OVER (PARTITION BY r.q ORDER BY p_retailprice DESC NULLS LAST, p_size DESC NULLS LAST, r.rank) AS pos
  FROM ({_RANKED.format(_COSINE)}) r JOIN embeddings i ON r.m = i.vec_id JOIN embeddings o ON r.q = o.vec_id AND i.label = o.label
  LEFT JOIN part ON p_partkey = i.vec_id WHERE r.rank BETWEEN 2 AND 100) WHERE pos <= 5""")
def recommend_top5(spark, sf_dir):
    catalogue = _catalogue(spark, sf_dir)
    return similarity.recommend(catalogue, _queries_of(catalogue))


@query(f"""
SELECT q, pos, vec_id, CAST(pos AS VARCHAR) || '. ' || title || chr(10) || 'Score: ' || coalesce(CAST(score AS VARCHAR), '?') || chr(10) || 'Year: ' || coalesce(CAST(year AS VARCHAR), '?') || chr(10)
|| 'Type: ' || p_type || chr(10) || 'Episodes: ' || CAST(p_size AS VARCHAR) || chr(10) || 'Description:' || chr(10) || p_brand || chr(10) AS line
FROM ({_SQL["recommend_top5"]}) JOIN part ON p_partkey = vec_id""")
def reply_rows(spark, sf_dir):
    catalogue = _with_details(spark, sf_dir)
    told = similarity.recommend(catalogue, _queries_of(catalogue), extra=("type", "episodes", "synopsis")).filter("title is not null")
    return similarity.replies(told).select("q", "pos", "vec_id", "line")


def _with_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with type, episodes (with a fraction, which a reply cuts off) and text."""
    details = _parts(spark, sf_dir).select(F.col("p_partkey").alias("vec_id"), F.col("p_type").alias("type"), (F.col("p_size") + 0.7).alias("episodes"), F.col("p_brand").alias("synopsis"))
    return _catalogue(spark, sf_dir).join(details, "vec_id", "left")


@query()
def kmeans_assign(spark, sf_dir):
    items = features.onehot(_parts(spark, sf_dir).select("p_partkey", "p_name"), _genres(), GENRES)
    marked = items.select("p_partkey", F.array(*(F.col(g).cast("double") for g in GENRES)).alias("marks"))
    return similarity.clusters(marked, "marks").select("p_partkey", "cluster")


@query("""
SELECT p_partkey, vec_id, label, CAST(row_id AS BIGINT) AS row_id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part)
JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings) USING (row_id)""")
def positional_join(spark, sf_dir):
    left = with_row_id(_parts(spark, sf_dir).select("p_partkey"), "p_partkey")
    right = with_row_id(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return left.join(right, "row_id")


@query()
def fuzzy_match(spark, sf_dir):
    """Requests are names with their first two letters swapped."""
    name = F.col("p_name")
    requests = _parts(spark, sf_dir).filter("p_partkey % 100 = 0").select(F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3))).alias("request"))
    return fuzzy.close_titles(requests, _parts(spark, sf_dir).select(name.alias("title")))


@query()
def impute_normal(spark, sf_dir):
    return clean.impute_normal(_parts(spark, sf_dir).withColumn("score", F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice"))), "score").select("p_partkey", "score")


# --- statistics --------------------------------------------------------------------


@query("SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem")
def global_mean_std(spark, sf_dir):
    return rounded(stats.mean_std(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4, "mean", "std")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS low,
round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS high FROM lineitem""" for c in _NUMBERS))
def describe(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "lineitem"), _NUMBERS), 4, "mean", "std", "q25", "q50", "q75")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(nullif(CAST({c} AS VARCHAR), 'ECONOMY')) AS n FROM part" for c in _PART))
def info(spark, sf_dir):
    return stats.info(_marked(spark, sf_dir).select(*_PART))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN CAST({c} AS VARCHAR) = 'ECONOMY' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM part" for c in _PART))
def null_fraction(spark, sf_dir):
    return rounded(stats.null_fraction(_marked(spark, sf_dir).select(*_PART)), 6, "fraction")


@query("SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns FROM lineitem")
def shape(spark, sf_dir):
    return stats.shape(table(spark, sf_dir, "lineitem"))


@query("""
SELECT p_partkey, p_name, 'head' AS part FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5)
UNION ALL SELECT p_partkey, p_name, 'tail' FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 5)""")
def head_tail(spark, sf_dir):
    return stats.head_tail(_parts(spark, sf_dir).select("p_partkey", "p_name"), "p_partkey")


@query("SELECT p_type, count(*) AS cnt FROM part GROUP BY p_type")
def count_by(spark, sf_dir):
    return stats.count_by(_parts(spark, sf_dir), "p_type")


@query("""
SELECT p_type, n, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - 1.96 * std / sqrt(n), 4) AS low, round(mean + 1.96 * std / sqrt(n), 4) AS high
FROM (SELECT p_type, count(p_retailprice) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std FROM part GROUP BY p_type)""")
def avg_by_category(spark, sf_dir):
    return rounded(stats.mean_by(_parts(spark, sf_dir), "p_type", "p_retailprice"), 4, "mean", "std", "low", "high")


@query("""
WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem)
SELECT q1, q2, q3, min(l_quantity) FILTER (l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(l_quantity) FILTER (l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
count(*) FILTER (l_quantity NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem, q GROUP BY ALL""")
def boxplot_stats(spark, sf_dir):
    return stats.boxplot(table(spark, sf_dir, "lineitem"), "l_quantity")


def _bin(c: str) -> str:
    return f"CAST(least(floor(({c} - (SELECT min({c}) FROM part)) / CAST((SELECT max({c}) - min({c}) FROM part) AS DOUBLE) * 10), 9) AS INTEGER) AS b_{c}"


@query(f"SELECT b_p_retailprice, count(*) AS cnt FROM (SELECT {_bin('p_retailprice')} FROM part) GROUP BY ALL")
def histogram(spark, sf_dir):
    return stats.histogram(_parts(spark, sf_dir), ["p_retailprice"])


@query(f"SELECT b_p_size, b_p_retailprice, count(*) AS cnt FROM (SELECT {_bin('p_size')}, {_bin('p_retailprice')} FROM part) GROUP BY ALL")
def pair_points(spark, sf_dir):
    return stats.histogram(_parts(spark, sf_dir), ["p_size", "p_retailprice"])


_GRID = """
WITH o AS (SELECT count(*) AS n, min(p_retailprice) - 3 * stddev_samp(p_retailprice) * pow(count(*), -0.2) AS low,
max(p_retailprice) + 3 * stddev_samp(p_retailprice) * pow(count(*), -0.2) AS high FROM part),
g AS (SELECT n, low + (high - low) * i / 199 AS x FROM o, range(200) t(i))"""


@query(_GRID + """, w AS (SELECT stddev_samp(p_retailprice) * pow(count(*), -0.2) AS h FROM part)
SELECT round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - p_retailprice) / h, 2))) / (h * sqrt(2 * pi()) * n), 8) AS y FROM part, g, w GROUP BY x, h, n""")
def kde(spark, sf_dir):
    return rounded(rounded(stats.density(_parts(spark, sf_dir), "p_retailprice"), 4, "x"), 8, "y")


@query(_GRID + """, w AS (SELECT p_type, stddev_samp(p_retailprice) * pow(count(*), -0.2) AS h FROM part GROUP BY p_type)
SELECT p_type, round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - p_retailprice) / h, 2))) / (h * sqrt(2 * pi()) * n), 8) AS y FROM part JOIN w USING (p_type), g GROUP BY p_type, x, h, n""")
def kde_by_category(spark, sf_dir):
    return rounded(rounded(stats.density(_parts(spark, sf_dir), "p_retailprice", by="p_type"), 4, "x"), 8, "y")


# --- events, dialogues, streams -----------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'help' WHEN 'error' THEN 'help' WHEN 'purchase' THEN 'callback' ELSE 'title' END AS route FROM events")
def route_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dialogue.route(F.col("event_type"), ROUTES, "none").alias("route"))


@query("SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'feedback' ELSE 'request' END AS target FROM events WHERE event_type IN ('purchase', 'click')")
def split_by_type(spark, sf_dir):
    found = chatlog.split_by_type(table(spark, sf_dir, "events"), "event_type", {"purchase": "feedback", "click": "request"})
    parts = [df.select("event_id", "user_id", F.lit(t).alias("target")) for t, df in found.items()]
    return parts[0].unionByName(parts[1])


def _machine_sql(start: str, step: str) -> str:
    """A dialogue as a recursion along each user's events."""
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, user_id, k, '{start}' AS state_before, {step.format(s=f"'{start}'", e='e')} AS state_after FROM e WHERE k = 1
UNION ALL SELECT e.event_id, e.user_id, e.k, f.state_after, {step.format(s='f.state_after', e='e')} FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, user_id, state_before, state_after FROM f"""


_DIALOGUE_SQL = _machine_sql("Start", """CASE
WHEN {e}.t = 'purchase' THEN CASE WHEN {s} <> 'ReceiveUserChoice' THEN {s} WHEN {e}.v < 10 THEN 'ReceiveAnimeName' WHEN {e}.v < 40 THEN 'ReceiveUserFeedback' WHEN {e}.v < 80 THEN 'Start' ELSE {s} END
WHEN {e}.t = 'error' THEN 'Start' WHEN {s} = 'Start' THEN CASE WHEN {e}.t = 'signup' THEN 'ReceiveAnimeName' ELSE 'Start' END
WHEN {s} = 'ReceiveAnimeName' THEN 'ReceiveUserChoice' WHEN {s} = 'ReceiveUserFeedback' THEN 'Start' ELSE {s} END""")


@query(_DIALOGUE_SQL)
def fsm_dialogue(spark, sf_dir):
    events = streams.dialogue_events(table(spark, sf_dir, "events"), TEXTS)
    return dialogue.fold(events, dialogue.recommendation_dialogue, dialogue.START).drop("action")


@query(_machine_sql("NONE", """CASE
WHEN {s} IN ('NONE', 'END') THEN CASE WHEN {e}.t = 'signup' THEN 'CHOOSING' ELSE {s} END WHEN {e}.t = 'error' THEN 'END'
WHEN {e}.t IN ('signup', 'purchase') THEN {s} WHEN {s} = 'CHOOSING' THEN CASE WHEN {e}.t = 'view' THEN 'TYPING_REPLY' ELSE {s} END ELSE 'CHOOSING' END"""))
def fsm_feedback(spark, sf_dir):
    events = streams.dialogue_events(table(spark, sf_dir, "events"), MENU_TEXTS).withColumn("button", F.lit(None).cast("string"))
    return dialogue.fold(events, dialogue.feedback_dialogue, dialogue.NONE).drop("action")


@query("SELECT p_type, count(*) AS cnt, max(p_size) AS largest FROM part GROUP BY p_type")
def sql_passthrough(spark, sf_dir):
    _parts(spark, sf_dir).createOrReplaceTempView("part")
    return run_sql(spark, "SELECT p_type, count(*) AS cnt, max(p_size) AS largest FROM part GROUP BY p_type")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_append(spark, sf_dir):
    path = work_path(spark, "append")
    stream = streams.event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    streams.stream_append(stream, path)
    return spark.read.parquet(path)


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_dedup(spark, sf_dir):
    path = work_path(spark, "users")
    streams.stream_register(streams.event_stream(spark, sf_dir).select("user_id", "event_id", "ts"), path, "user_id", ["ts", "event_id"])
    return spark.read.parquet(path).select("user_id", "event_id")


@query("SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'feedback' ELSE 'request' END AS target FROM events WHERE event_type IN ('purchase', 'click')")
def stream_split(spark, sf_dir):
    folder = work_path(spark, "split")
    streams.stream_split(streams.event_stream(spark, sf_dir), "event_type", {"purchase": "feedback", "click": "request"}, folder)
    parts = [spark.read.parquet(f"{folder}/{t}").select("event_id", "user_id", F.lit(t).alias("target")) for t in ("feedback", "request")]
    return parts[0].unionByName(parts[1])


@query()
def stream_candidates(spark, sf_dir):
    """Every hundredth event asks for a title, the name of a part with its first two letters swapped."""
    path, name = work_path(spark, "candidates"), F.col("p_name")
    asked = F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3)))
    names = _parts(spark, sf_dir).select(F.col("p_partkey").alias("user_id"), asked.alias("request"))
    requests = streams.event_stream(spark, sf_dir).filter("event_id % 100 = 0").join(names, "user_id")
    streams.stream_candidates(requests, _parts(spark, sf_dir).select(name.alias("title")), path)
    return spark.read.parquet(path).drop("batch_id")


@query(f"""
WITH c AS (SELECT min(p_partkey) AS q, p_name FROM part JOIN embeddings ON vec_id = p_partkey GROUP BY p_name),
a AS (SELECT event_id, user_id, c.q FROM events JOIN part ON p_partkey = user_id JOIN c USING (p_name) WHERE event_id % 100 = 0),
p AS (SELECT q.vec_id AS q, i.vec_id AS m, round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 0), 12) AS sim FROM embeddings q, embeddings i WHERE q.vec_id IN (SELECT q FROM a)),
r AS (SELECT q, m, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM p)
SELECT event_id, user_id, CAST(pos AS INTEGER) AS pos, vec_id FROM a JOIN (
  SELECT r.q, i.vec_id, row_number() OVER (PARTITION BY r.q ORDER BY p_retailprice DESC NULLS LAST, p_size DESC NULLS LAST, r.rank) AS pos
  FROM r JOIN embeddings i ON r.m = i.vec_id JOIN embeddings o ON r.q = o.vec_id AND i.label = o.label LEFT JOIN part ON p_partkey = i.vec_id WHERE r.rank BETWEEN 2 AND 100) USING (q) WHERE pos <= 5""")
def stream_recommend(spark, sf_dir):
    """Every hundredth event chooses the name of a part."""
    path = work_path(spark, "replies")
    names = _parts(spark, sf_dir).select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("title"))
    choices = streams.event_stream(spark, sf_dir).filter("event_id % 100 = 0").join(names, "user_id").select("event_id", "user_id", "title")
    streams.stream_recommendations(choices, _with_details(spark, sf_dir), path)
    return spark.read.parquet(path).select("event_id", "user_id", "pos", "vec_id")


@query(_DIALOGUE_SQL)
def stream_fsm(spark, sf_dir):
    path = work_path(spark, "dialogue")
    events = streams.dialogue_events(streams.event_stream(spark, sf_dir), TEXTS)
    streams.stream_dialogue(events, dialogue.recommendation_dialogue, dialogue.START, path)
    return spark.read.parquet(path).drop("action")
