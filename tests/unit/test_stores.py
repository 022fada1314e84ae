"""Stored vectors, repeatable writes, streams in several triggers, compatibility forms."""

import datetime
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from dossierflow.functions import text, unicode
from dossierflow.plans import catalogue, stores
from dossierflow.sources import sinks, vector_store
from dossierflow.streaming import rolling


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_second_run_embeds_nothing(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    frame = lambda *texts: spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, vector int")
    first = frame("alpha", " Alpha ", None, "", "  ", "beta", "beta")
    vector_store.add_missing(first, path, "a", "m", embed, 2)
    assert rows(vector_store.call_stats(spark, path).select("run", "texts", "tokens", "ok")) == [("a", 2, 2, True)]
    vector_store.add_missing(first, path, "b", "m", embed, 2)
    vector_store.add_missing(first.unionByName(frame("gamma")), path, "c", "m", embed, 2)
    assert rows(vector_store.call_stats(spark, path).select("run", "texts")) == [("a", 2), ("c", 1)]
    found = vector_store.with_vectors(first.drop("vector"), path, "c", "m").select("id", "run", F.col("vector")[0])
    assert rows(found) == [(0, "a", 5.0), (1, "a", 5.0), (2, None, None), (3, None, None), (4, None, None), (5, "a", 4.0), (6, "a", 4.0)]
    # another model has keys of its own
    vector_store.add_missing(first, path, "d", "other", embed, 2)
    assert ("d", 2) in rows(vector_store.call_stats(spark, path).select("run", "texts"))


def test_vectors_of_another_length_are_used_once_and_not_held(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    frame = spark.createDataFrame([("long",), ("lost",), ("fine",)], "text string")
    odd = lambda texts: [{"long": [1.0, 2.0, 3.0], "lost": None}.get(t, [1.0, 2.0]) for t in texts]
    vector_store.add_missing(frame, path, "a", "m", odd, 2)
    size = F.size("vector").alias("n")
    assert rows(vector_store.with_vectors(frame, path, "a", "m").select("text", F.when(F.col("vector").isNotNull(), size))) == [("fine", 2), ("long", 3), ("lost", None)]
    vector_store.add_missing(frame, path, "b", "m", lambda texts: [[0.0, 0.0] for _ in texts], 2)
    assert rows(vector_store.with_vectors(frame, path, "b", "m").select("text", "run")) == [("fine", "a"), ("long", "b"), ("lost", "b")]
    # a repeated run does its own work again, whole
    vector_store.add_missing(frame, path, "b", "m", lambda texts: [[0.0, 0.0] for _ in texts], 2)
    assert rows(vector_store.call_stats(spark, path).select("run", "texts", "ok")) == [("a", 3, False), ("b", 2, True)]


def test_calls_are_bounded(spark, tmp_path):
    texts = spark.range(250).select(F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1)

    def embed(some):
        assert len(some) <= 96
        return [[1.0] for _ in some]

    vector_store.add_missing(texts, f"{tmp_path}/v", "a", "m", embed, 1)
    assert vector_store.call_stats(spark, f"{tmp_path}/v").first()["texts"] == 250


def test_nothing_to_embed(spark, tmp_path):
    none = spark.createDataFrame([], "text string")
    vector_store.add_missing(none, f"{tmp_path}/v", "a", "m", lambda t: [], 1)
    assert vector_store.with_vectors(none, f"{tmp_path}/v", "a", "m").collect() == []
    assert sinks.batches(spark, f"{tmp_path}/nowhere", none.schema).collect() == []


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    batch = lambda *r: spark.createDataFrame(r, "k long, v string")
    for number, part in ((0, batch((1, "a"), (2, "b"))), (1, batch((2, "c"), (3, None))), (0, batch((1, "a"), (2, "b"))), (1, batch((2, "c"), (3, None)))):
        sinks.append_once(part, number, path)
    log = sinks.batches(spark, path, batch((1, "a")).schema)
    assert log.count() == 4
    assert rows(sinks.current(log, ["k"])) == [(1, "a"), (2, "c"), (3, None)]
    assert rows(sinks.current(log, ["k"], update=False)) == [(1, "a"), (2, "b"), (3, None)]


def test_streams_count_late_files(spark, tmp_path):
    """Several triggers, the oldest days last; a restart reads only what is new."""
    draw = random.Random(3)
    start = datetime.datetime(2024, 3, 1)
    events = [(i, start + datetime.timedelta(hours=draw.randrange(24 * 45)), None if draw.random() < 0.1 else draw.randrange(40), draw.choice("ab")) for i in range(600)]
    events.sort(key=lambda e: e[1], reverse=True)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    folder = f"{tmp_path}/events.parquet"
    write = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
    fold = lambda r: rolling.daily_sketches(r, "user_id", "ts")
    for at in (0, 200):
        write(events[at : at + 200])
        sinks.fold_stream(stores._event_stream(spark, str(tmp_path), files=1), fold, f"{tmp_path}/sketches", f"{tmp_path}/state")
    write(events[400:])
    write([(-1, None, 5, "a")])
    sinks.fold_stream(stores._event_stream(spark, str(tmp_path), files=1), fold, f"{tmp_path}/sketches", f"{tmp_path}/state")
    sketches = sinks.batches(spark, f"{tmp_path}/sketches", spark.createDataFrame([], "day date, sketch binary").schema)
    assert sketches.select("batch").distinct().count() >= 3
    want, days = [], sorted({e[1].date() for e in events if e[2] is not None})
    for n in range((days[-1] - days[0]).days + 1):
        day = days[0] + datetime.timedelta(days=n)
        want.append((day, *(len({e[2] for e in events if e[2] is not None and 0 <= (day - e[1].date()).days < w}) for w in (1, 7, 30))))
    assert sorted(map(tuple, rolling.rolling_exact(spark.createDataFrame(events, schema), "user_id", "ts", stores.WINDOWS).collect())) == want
    assert sorted(map(tuple, rolling.rolling_estimates(sketches, stores.WINDOWS).collect())) == want  # few users, so sketches are exact
    counted = catalogue.QUERIES["stream_daily_counts"](spark, str(tmp_path))
    assert rows(counted) == rows(spark.read.parquet(folder).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")))


ODD = ["ｊａｖａｓｃｒｉｐｔ", "ﬁnance oﬃce", "①②③ ½", "Å Å Å", "plain ascii", "", None, "été", "ｶﾞ ﷺ", "x²  y", "안녕"]


def test_compatibility_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, t string")
    want = [(i, t, None if t is None else unicodedata.normalize("NFKC", t)) for i, t in enumerate(ODD)]
    for found in (unicode.with_nfkc(df, "t", "out"), unicode.by_table(df, "t", "out")):
        assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == want
    assert sorted(map(tuple, unicode.with_nfkc(df, "t").collect()), key=lambda r: r[0]) == [(i, n) for i, _, n in want]


@pytest.mark.parametrize("left, right", [("Ｔｙｐｅｓｃｒｉｐｔ", "typescript"), ("ﬁntech", "Fintech"), ("Ｃ＋＋", "cpp"), ("Node．js", "nodejs")])
def test_wide_letters_and_ligatures_meet(spark, left, right):
    df = unicode.by_table(spark.createDataFrame([(left,), (right,)], "name string"), "name", "form")
    assert len({r[0] for r in df.select(text.normal_skill(F.col("form"))).collect()}) == 1


def test_compatibility_forms_of_documents(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def plain(t):
        n = unicodedata.normalize("NFKC", t)
        return n != t, sha(re.sub("[ \t]+", " ", n).strip().lower())

    found = {r["doc_id"]: (r["changed"], r["hashed"]) for r in catalogue.QUERIES["compatibility_forms"](spark, str(tmp_path)).collect()}
    assert found == {i: (None, None) if t is None else plain(t) for i, t in enumerate(ODD)}
