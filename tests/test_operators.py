"""Edge rows of single operators."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.functions import scalars as S
from lumenrec.operators import chatlog, clean, dialogue, features, fuzzy, similarity, stats
from lumenrec.sources import files
from lumenrec.streaming import streams


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_duration(spark):
    texts = ["24 min. per ep.", "1 hr. 55 min.", "30 sec.", "2 hr.", "foo", "1 hr. 1 hr.", "min. 3", None]
    assert column(spark, texts, S.duration_seconds) == [1440, 6900, 30, 7200, 0, 7200, 0, None]


def test_year_and_season(spark):
    texts = ["Apr 3 1998 to Apr 24 1999", "2005 to ?", "foo", "Dec 1 1 12345", "Mar", "", None]
    assert column(spark, texts, S.year) == [1998, 2005, None, None, None, None, None]
    assert column(spark, texts, S.season) == ["spring", "Unknown", "Unknown", "winter", "spring", "Unknown", "Unknown"]


def test_rating(spark):
    assert column(spark, ["G - All Ages", "R+ - Mild Nudity", None], S.rating_age) == [0, 18, None]
    with pytest.raises(Exception, match="unknown rating: X"):
        column(spark, ["X"], S.rating_age)


def test_row_as_text(spark):
    df = spark.createDataFrame([('a\nb "q" café_x', 8.78), (None, None)], "name string, score double")
    got = [r[0] for r in df.select(S.doc_text(df, ["name", "score"])).collect()]
    assert got == ["name anb q café_x score 878", "name nan score nan"]


def test_numbers_as_python_prints_them(spark):
    values = [8.78, 26.0, 1998.0, 9999999.0, 1e7, 12345678.0, 1e16, 0.0001, -0.5, 123456789.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(S.render("x", df.schema["x"].dataType)).collect()] == [repr(v) for v in values]


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,name,score\n1,"a ""q""\nb",8.5\n2,NaN,Unknown\n')
    rows = files.read_csv(spark, str(path), "id long, name string, score double").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "q"\nb', 8.5), (2, None, None)]
    files.write_csv(spark.createDataFrame(rows, "id long, name string, score double"), str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out"), "id long, name string, score double").collect())) == [tuple(r) for r in rows]


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text('na 1 2\nnan 1 2\nnull 3 4\n"q 5 6\na 1 1\na 2 2\n')
    got = {r.token: r.vec for r in files.read_word_vectors(spark, str(path), 2).collect()}
    assert got == {"na": [1, 2], '"q': [5, 6], "a": [2, 2]}


def test_row_id_and_tables(spark):
    got = files.with_row_id(spark.createDataFrame([("c",), ("a",), ("b",)], "k string"), "k").orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("b", 1), ("c", 2)]
    files.create_log_tables(spark, replace=True)
    files.create_log_tables(spark)
    spark.sql("INSERT INTO request VALUES (5000000000, 'hi')")
    assert files.run_sql(spark, "SELECT msg FROM request WHERE tg_id = :id", id=5000000000).first()[0] == "hi"
    assert files.too_long(spark.createDataFrame([("abc",), ("a",)], "t string"), {"t": 2}).count() == 1


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "x", None), ("2.5", "Unknown", None)], "a string, b string, c string")
    got = clean.infer_numeric(clean.sentinel_to_null(df))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["double", "string", "double"]
    assert clean.label_slice(df, "a", "b") == ["a", "b"] and clean.label_slice(df, "b", "a") == []
    assert clean.column_classes(got, "a", set()) == (["c"], ["b"])
    with pytest.raises(ValueError, match="not unique"):
        clean.join_left(df, df.union(df), "a")


def test_cleaning_odd_input(spark):
    numbers = spark.createDataFrame([(1, None), (None, 2)], "k int, n int")
    assert clean.infer_numeric(numbers).schema == numbers.schema and clean.uncastable(numbers).count() == 0
    right = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, r int")
    assert sorted(map(tuple, clean.join_left(numbers, right, "k").collect()), key=str) == [(1, None, 3), (None, 2, None)]
    empty = spark.createDataFrame([(None, 1.0)], "k double, x double")
    assert clean.impute_normal(empty, "k").first().k is None
    assert stats.describe(empty, ["k"]).first().n == 0 and stats.boxplot(empty, "x").first().outliers == 0


def test_row_ids_over_many_ranges(spark):
    rows = [(f"k{i:04}" if i % 50 else None, i) for i in range(1, 1001)]
    got = files.with_row_id(spark.createDataFrame(rows, "k string, i int").repartition(7), "k").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1000))
    assert [r.k for r in got] == [None] * 20 + sorted(k for k, _ in rows if k)
    assert files.with_row_id(spark.createDataFrame([], "k string"), "k").count() == 0


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, msg string")
    for _ in range(2):
        files.write_jdbc(rows, url, "messages", "app", "app")
    assert sorted(map(tuple, files.read_jdbc(spark, url, "messages", "app", "app").collect()), key=str) == [(1, "a")] * 2 + [(2, None)] * 2


def test_vector_sums_by_workers_and_by_join(spark):
    docs = spark.createDataFrame([(1, "a b a zz"), (2, None), (3, ""), (4, "zz"), (5, "b " * 3000)], "k long, t string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "token string, vec array<double>")
    want = [(1, 3, [2.5, 3.0]), (2, 0, [0.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 0, [0.0, 0.0]), (5, 3000, [1500.0, -3000.0])]
    for held in (4, 3):
        assert sorted(map(tuple, features.embed_sum(docs, "k", "t", vectors, 2, held).collect())) == want
    assert features.embed_sum(docs, "k", "t", vectors.limit(0), 2).filter("hits = 0").count() == 5


def test_kmeans_on_indicators(spark):
    groups = [[1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 0, 0]]
    rows = [(i, [float(x) for x in groups[i % 3]]) for i in range(30)]
    got = {r.i: r.cluster for r in similarity.clusters(spark.createDataFrame(rows, "i int, marks array<double>"), "marks", k=3).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(30)) and set(got.values()) <= {0, 1, 2}


def test_kmeans_query(spark, sf_dir):
    from lumenrec.plans import catalog

    names = {r.p_partkey: frozenset(r.p_name.split()) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = {r.p_partkey: r.cluster for r in catalog.kmeans_assign(spark, sf_dir).collect()}
    by_name = {}
    for k, words in names.items():
        by_name.setdefault(words, set()).add(got[k])
    assert got.keys() == names.keys() and all(len(x) == 1 for x in by_name.values()) and 1 < len(set(got.values())) <= 20


def test_rows_without_vectors_are_compared_with_nothing(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert {(r.q, r.m) for r in similarity.similarity_rows(items, items).collect()} == {(a, b) for a in (1, 3) for b in (1, 3)}


def test_registration_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "users")
    events = spark.createDataFrame([(1, 5, "late"), (1, 3, "early"), (2, 4, "x")], "id long, ts long, name string")
    for _ in range(2):
        chatlog.insert_unseen(events, path, "id", ["ts"])
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "name").collect())) == [(1, "early"), (2, "x")]


def test_similarity_ties_and_zeros(spark):
    rows = [(i, [1.0, 0.0] if i in (0, 7) else [0.0, 0.0] if i == 3 else [0.5, float(i)], 0) for i in range(8)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = similarity.neighbours(items, items.filter("vec_id = 7"), last=8).orderBy("rank").collect()
    assert got[0].m == 7 and all(r.m != 0 for r in got) and {r.sim for r in got if r.m == 3} == {0.0}
    own = similarity.neighbours(items, items.filter("vec_id = 7"), last=8, exclude_self=True)
    assert own.filter("m = 7").count() == 0 and own.count() == 7
    assert similarity.similarities(np.zeros((1, 2)), np.ones((3, 2)), "cosine").tolist() == [[0, 0, 0]]
    one = [r[0] for r in items.orderBy("vec_id").select(similarity.cosine_to(F.col("embedding"), [1.0, 0.0])).collect()]
    assert one[0] == 1.0 and one[3] == 0.0


def test_recommendations(spark, sf_dir):
    items = spark.createDataFrame([(i, [1.0, i / 10], i % 2, f"t{i}", s, y) for i, s, y in ((0, 1.0, None), (2, 2.0, 5), (4, 2.0, None), (6, 2.0, 5), (8, 3.0, 1), (1, 9.0, 9))], "vec_id long, embedding array<double>, cluster int, title string, score double, year int")
    got = similarity.recommend_by_title(items, "t0")
    assert [r.vec_id for r in got.orderBy("pos").collect()] == [8, 2, 6, 4]
    shown = similarity.recommend_by_title(items, "t0").withColumns({"type": F.lit("TV"), "episodes": F.lit(26.9), "synopsis": F.lit(None).cast("string")})
    assert similarity.replies(shown).filter("pos = 1").first().line == "1. t8\nScore: 3.0\nYear: 1\nType: TV\nEpisodes: 26\nDescription:\n?\n"
    with pytest.raises(KeyError):
        similarity.recommend_by_title(items, "nothing")


def test_cluster_filter_stays_above_the_rank(spark, sf_dir):
    from lumenrec.plans import catalog

    plan = catalog.recommend_top5(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    rank = next(i for i, x in enumerate(plan.splitlines()) if "Window" in x and "sim" in x)
    assert not any("Filter" in x and "cluster" in x and " = " in x for x in plan.splitlines()[rank + 1 :])


@pytest.mark.parametrize(("request_", "names"), [("abc", "abd abe abc xyz abz".split()), ("naruto", ["Naruto", "NARUTO", "naruto: shippuuden"]), ("ab", ["ab", "ab", "ab", "ab"]), ("red ring", ["red ring", "ring red", "rd rng", "blue"])])
def test_fuzzy_as_the_standard_library(spark, request_, names):
    got = fuzzy.close_titles(spark.createDataFrame([(request_,)], "request string"), spark.createDataFrame([(n,) for n in names], "title string"))
    assert [r.title for r in got.orderBy("rank").collect()] == difflib.get_close_matches(request_, names)


def test_fuzzy_query_asks_for_every_hundredth_name(spark, sf_dir):
    from lumenrec.plans import catalog

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()
    names = [r.p_name for r in parts if r.p_name is not None]
    asked = {r.p_name[1:2] + r.p_name[:1] + r.p_name[2:] for r in parts if r.p_partkey % 100 == 0 and r.p_name is not None}
    got = {}
    for r in catalog.fuzzy_match(spark, sf_dir).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.title)
    assert asked and got == {a: found for a in asked if (found := difflib.get_close_matches(a, names))}


def test_dialogues():
    run = lambda machine, state, events: [state := machine(state, *e)[0] for e in events]
    text, press = (lambda t: (t, None)), (lambda b: (None, b))
    assert run(dialogue.recommendation_dialogue, "Start", [text("/help"), text("/start"), text("/help"), press("Feedback"), text("/start"), press("x")]) == ["Start", "ReceiveAnimeName", "ReceiveUserChoice", "ReceiveUserFeedback", "Start", "Start"]
    assert run(dialogue.feedback_dialogue, "NONE", [text("/helpme"), text("Rate anime"), text("Done")]) == ["CHOOSING", "TYPING_REPLY", "END"]
    assert dialogue.feedback_dialogue("TYPING_REPLY", "Done", None)[1] == "done"
    assert dialogue.feedback_dialogue("CHOOSING", "Rate anime", None) == ("TYPING_REPLY", "ask_rating") and dialogue.feedback_dialogue("CHOOSING", "Evaluate the recommendation", None) == ("TYPING_REPLY", "ask_evaluation")
    assert dialogue.feedback_dialogue("CHOOSING", "rate anime", None) == ("CHOOSING", "search")
    assert dialogue.feedback_dialogue("TYPING_REPLY", "fine", None) == ("CHOOSING", "store")


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), "a" if x < 3 else None) for x in (1, 2, 3, 4, 100)], "x double, c string")
    box = stats.boxplot(df, "x").first()
    assert (box.q1, box.q2, box.q3, box.whisker_high, box.outliers) == (2.0, 3.0, 4.0, 4.0, 1)
    assert {r.column_name: r.fraction for r in stats.null_fraction(df).collect()} == {"x": 0.0, "c": 0.6}
    curve = stats.density(df, "x", points=400).orderBy("x").collect()
    assert abs(np.trapezoid([r.y for r in curve], [r.x for r in curve]) - 1) < 0.01
    assert stats.density(df.limit(0), "x").count() == 0
    assert clean.impute_normal(df.withColumn("x", F.when(F.col("x") < 50, F.col("x"))), "x").filter("x is null").count() == 0


def test_quartiles_are_exact_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=5_001), rng.integers(0, 9, 5_001).astype(float), rng.exponential(size=5_001)
    c[rng.random(5_001) < 0.4] = np.nan
    df = spark.createDataFrame([(x, y, None if np.isnan(z) else z, None) for x, y, z in zip(a.tolist(), b.tolist(), c.tolist())], "a double, b double, c double, empty double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.column_name: r for r in stats.describe(df, df.columns).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, x in (("a", a), ("b", b), ("c", c)):
        want = np.nanquantile(x, [0.25, 0.5, 0.75])
        assert [got[name].q25, got[name].q50, got[name].q75] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-12) and got[name].n == np.isfinite(x).sum()
    assert tuple(got["empty"])[1:] == (0, *[None] * 7)
    # one, two and three values, repeated ones
    for values in ([7.0], [1.0, 2.0], [1.0, 1.0, 4.0], [5.0] * 9):
        some = stats.describe(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first()
        assert [some.q25, some.q50, some.q75] == np.quantile(values, [0.25, 0.5, 0.75]).tolist()
    assert stats.boxplot(df.limit(0), "a").count() == 0 and stats.boxplot(df, "empty").first().q2 is None
    rough = stats.describe(df, ["a", "empty"], exact=False).orderBy("column_name").collect()
    assert abs(rough[0].q50 - np.median(a)) < 0.05 and rough[1].q50 is None


def test_stream_state_is_the_batch_fold(spark, sf_dir):
    from lumenrec.plans import catalog

    batch, stream = catalog.fsm_dialogue(spark, sf_dir), catalog.stream_fsm(spark, sf_dir)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.select(*batch.columns).collect()))
    assert files.work_path(spark, "x") != files.work_path(spark, "x")


EVENTS = "event_id long, user_id long, ts long, text string, button string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_streams_go_on_after_a_restart(spark, tmp_path):
    first = [(1, 7, 1, "/start", None), (2, 8, 2, "/help", None), (3, 7, 3, "a title", None)]
    later = [(4, 7, 4, None, "Feedback"), (5, 8, 5, "/start", None), (6, 9, 6, None, None)]
    for rows in (first, later):
        put(spark, tmp_path, rows)
        stream = streams.event_stream(spark, str(tmp_path), files=1)
        streams.stream_append(stream, f"{tmp_path}/all")
        streams.stream_split(stream, "text", {"/start": "begun", "/help": "helped"}, f"{tmp_path}/split")
        streams.stream_register(stream, f"{tmp_path}/users", "user_id", ["ts"])
        streams.stream_dialogue(stream.select("event_id", "user_id", "ts", "text", "button"), dialogue.recommendation_dialogue, dialogue.START, f"{tmp_path}/steps", f"{tmp_path}/named")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(r.event_id for r in read("all").collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.event_id for r in read("split/begun").collect()) == [1, 5] and [r.event_id for r in read("split/helped").collect()] == [2]
    assert sorted((r.user_id, r.event_id) for r in read("users").collect()) == [(7, 1), (8, 2), (9, 6)]
    steps = {r.event_id: (r.state_before, r.state_after) for r in read("steps").collect()}
    assert steps[4] == ("ReceiveUserChoice", "ReceiveUserFeedback") and steps[5] == ("Start", "ReceiveAnimeName") and len(steps) == 6


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, kind string")
    for _ in range(2):
        streams._put(rows, f"{tmp_path}/t", 0)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_requests_and_choices_get_replies(spark, tmp_path):
    put(spark, tmp_path, [(1, 7, 1, "red rnig", None), (2, 8, 2, "zzzzzz", None), (3, 9, 3, None, "red ring")])
    events = streams.event_stream(spark, str(tmp_path))
    titles = spark.createDataFrame([("red ring",), ("red rings",), ("blue",), (None,)], "title string")
    streams.stream_candidates(events.filter("text is not null").withColumnRenamed("text", "request"), titles, f"{tmp_path}/candidates")
    got = {(r.event_id, r["rank"], r.title, r.reply) for r in spark.read.parquet(f"{tmp_path}/candidates").collect()}
    assert got == {(1, 1, "red ring", streams.CONFIRM), (1, 2, "red rings", streams.CONFIRM), (2, None, None, streams.UNKNOWN_TITLE)}
    items = spark.createDataFrame([(i, [1.0, i / 10], 0, t, 5.0, 2001.0, "TV", 12.0, "text") for i, t in enumerate(["red ring", "blue", "red ring"])], "vec_id long, embedding array<double>, cluster int, title string, score double, year double, type string, episodes double, synopsis string")
    streams.stream_recommendations(events.filter("button is not null").withColumnRenamed("button", "title"), items, f"{tmp_path}/replies")
    replies = spark.read.parquet(f"{tmp_path}/replies").orderBy("pos").collect()
    assert [(r.event_id, r.user_id, r.pos, r.vec_id) for r in replies] == [(3, 9, 1, 1), (3, 9, 2, 2)]
    assert replies[0].line == "1. blue\nScore: 5.0\nYear: 2001\nType: TV\nEpisodes: 12\nDescription:\ntext\n"
    streams.stop_all(spark)
    assert not spark.streams.active
