"""Summaries and small forms, with nulls, nothing and ties."""

import datetime

from pyspark.sql import functions as F

from dossierflow.functions import dates, numeric, privacy, requests, text
from dossierflow.operators import administration, summaries

CALL = "k long, purpose string, tokens long, ms double, ok boolean, calls long"


def test_usage(spark):
    rows = [(1, "embed", 10, 100.0, True, 0), (1, "embed", None, None, True, 0), (1, "write", 7, 51.0, True, 0), (1, None, 99, 9.0, False, 0), (2, "embed", 5, 1.0, None, 0), (None, "write", 3, None, True, 0)]
    df = spark.createDataFrame(rows, CALL)
    use = lambda key, d=df: d.transform(lambda x: summaries.usage(x, key, "purpose", "tokens", "ms", F.col("ok"))).collect()
    got = {r.k: r for r in use(["k"])}
    assert (got[1].calls, got[1].failed, got[1].error_rate, got[1].all_ok, got[1].total_tokens, got[1].total_ms, got[1].avg_ms) == (4, 1, 0.25, False, 17, 151.0, 76.0)
    assert got[1].by_purpose == {"embed": 10, "unknown": 0, "write": 7}
    assert (got[2].error_rate, got[2].total_tokens, got[2].avg_ms) == (1.0, 0, None) and (got[None].all_ok, got[None].total_tokens) == (True, 3)
    assert use([])[0].calls == 6
    none = use([], df.limit(0))
    assert len(none) == 1 and (none[0].calls, none[0].error_rate, none[0].avg_ms, none[0].by_purpose) == (0, None, None, {})
    assert use(["k"], df.limit(0)) == []


def test_checks_and_matches(spark):
    checks = [[("a", True), ("b", False), ("c", None)], [("a", True)], [], None]
    df = spark.createDataFrame([(c,) for c in checks], "c array<struct<requirement string, verified boolean>>")
    assert [r.s for r in df.select(summaries.checks_summary(F.col("c")).alias("s")).collect()] == [summaries.UNMET % (2, "b; c")] + [summaries.ALL_MET] * 3
    match = "k long, item string, category string, credit double"
    need, other = spark.createDataFrame([(1, "x", "EXACT", 1.0), (1, "y", "PARTIAL", 0.25), (1, "z", "PARTIAL", 0.65)], match), spark.createDataFrame([(1, "x", "MISSING_PREF", 0.0), (2, None, "MENTIONED_WITHOUT_EVIDENCE", 0.0)], match)
    every = summaries.matches_of(required=need, preferred=other)
    assert sorted((r.source, r.list) for r in every.collect()) == [("preferred", 1)] * 2 + [("required", 0)] * 3
    assert {r.k: r.counts for r in summaries.category_counts(every, "k").collect()} == {1: {"EXACT": 1, "MISSING_PREF": 1, "PARTIAL": 2}, 2: {"MENTIONED_WITHOUT_EVIDENCE": 1}}
    asked = spark.createDataFrame([(1, "visa", False, "keyword"), (2, "degree", True, "education"), (3, "years", None, "experience_months")], "k long, requirement string, verified boolean, method string")
    got = sorted(map(tuple, summaries.gaps_and_unmet(every, asked, "k").collect()), key=str)
    assert got == sorted([(1, "y", "PARTIAL", "required", "high", "match"), (1, "x", "MISSING_PREF", "preferred", "medium", "match"), (2, None, "MENTIONED_WITHOUT_EVIDENCE", "preferred", "medium", "match"), (1, "visa", "MISSING_REQ", "required", "high", "keyword"), (3, "years", "MISSING_REQ", "required", "high", "experience_months")], key=str)
    assert summaries.gaps_and_unmet(every.limit(0), asked.limit(0), "k").count() == 0


def test_forms(spark):
    L = F.lit
    one = lambda *c: tuple(spark.range(1).select(*[x.alias(f"c{n}") for n, x in enumerate(c)]).first())
    assert one(text.normal_ocr(L(" an exam-\r\nple  \n\n\n\nof   this\tx-\nY ")), text.normal_ocr(L("")), text.normal_ocr(L(None).cast("string"))) == ("an example\n\nof  this\tx-\nY", "", None)
    assert one(text.slug(L(3), L("Apache Spark/SQL")), text.title_label(L("resume_uploaded")), text.with_extension(L("A.PDF"), "pdf"), text.with_extension(L("a.b.docx"), "pdf"), text.with_extension(L("a"), "pdf")) == ("3-apache-spark-sql", "Resume Uploaded", "A.PDF", "a.b.pdf", "a.pdf")
    inside = one(text.fenced(L(f"a</{text.FENCE}>b")))[0]
    assert inside == f"<{text.FENCE}>\na[[/{text.FENCE}]]b\n</{text.FENCE}>"
    log = one(privacy.redacted_for_log(F.create_map(L("My_Token"), L("x"), L("a"), L("y" * 301), L("b"), L("z" * 300))))[0]
    assert log == {"My_Token": "[redacted]", "a": "y" * 300 + "…", "b": "z" * 300}
    assert one(dates.years(L(18)), dates.years(L(7)), dates.month_label(L(2020 * 12 + 2)), dates.duration(L(999)), dates.duration(L(3250)), dates.duration(L(119999))) == (1.5, 0.6, "Mar 2020", "999ms", "3.3s", "1m")
    assert one(*[numeric.confidence(L(x)) for x in (0.82, 0.8199, 0.6, 0.1, float("nan"))]) == ("high", "medium", "low", "none", "none")
    assert one(numeric.skill_blend(L(80.0), L(40.0), L(0)), numeric.skill_blend(L(80.0), L(40.0), L(2)), numeric.bucket(L(79.9)), *numeric.page_estimate(L(3001), L(9)), numeric.shown_similarity(L(0.81251))) == (80.0, 68.0, 70, 2, 2, "0.813")
    assert one(dates.is_current(L(None).cast("string")), dates.is_current(L("To Date")), dates.is_current(L("2020"))) == (True, True, False)


def test_platform_report(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    users, docs = frame([(True,), (False,), (None,)], "suspended boolean"), frame([(True,), (None,)], "deleted boolean")
    analyses = frame([("a", 10.0, 100), ("a", 20.0, 300), ("b", None, None), (None, 40.0, 1000)], "profile string, score double, ms long")
    when = datetime.datetime
    events = frame([(1, "up", when(2024, 3, 1, 9), None, None), (None, "up", when(2024, 3, 1, 8), None, None), (2, "say", when(2024, 2, 27), 5, 8.0), (3, "fail", when(2024, 1, 2), 9, 1.0), (3, "say", when(2024, 1, 2), None, 5.0)], "user_id long, kind string, ts timestamp, tokens long, ms double")
    run = lambda *t: administration.platform_report(*t, ["score"], {"uploads": "up"}, ["fail"], "say", "fail").collect()
    rows = run(users, docs, analyses, events)
    got = {(r.section, r.name): r.value for r in rows}
    assert len(got) == len(rows)
    total = {n: v for (s, n), v in got.items() if s == "totals"}
    assert total == {"users": 3, "suspended": 1, "documents": 1, "analyses": 4, "avg_score": 17.5, "avg_ms": 350, "active_1": 1, "active_7": 2, "active_30": 2}
    days = {n: v for (s, n), v in got.items() if s == "daily"}
    assert len(days) == 30 and days["2024-03-01 uploads"] == 2 and sum(days.values()) == 2
    assert {n: v for (s, n), v in got.items() if s == "by_profile"} == {"a n": 2, "a score": 15.0, "a ms": 200, "b n": 1, "b score": None, "b ms": None, "none n": 1, "none score": 40.0, "none ms": 1000}
    assert {n: v for (s, n), v in got.items() if s in ("failures", "calls")} == {"fail 2024-01-02 count": 1, "calls": 3, "tokens": 5, "avg_ms": 7, "error_rate": 0.3333}
    none = {(r.section, r.name): r.value for r in run(users.limit(0), docs.limit(0), analyses.limit(0), events.limit(0))}
    assert none["totals", "users"] == none["totals", "analyses"] == none["totals", "active_7"] == none["calls", "calls"] == 0 and none["totals", "avg_score"] is None and not any(s == "daily" for s, _ in none)
    states = frame([(2, 0), (0, 0), (0, 1), (1, 0)], "down int, skipped int").select(administration.health(F.col("down"), F.col("skipped")).alias("h")).collect()
    assert [r.h for r in states] == ["unhealthy", "healthy", "degraded", "degraded"]


def test_audit_parameters(spark):
    uuid, time = "0123abcd-0123-0123-0123-0123456789aB", "2024-02-29T10:00:00.5Z"
    cases = [
        ({}, (1, 25, None, None, None, None), []), (None, (1, 25, None, None, None, None), []),
        ({"page": " 7 ", "page_size": "1e2", "action": " x ", "admin_user_id": uuid, "from": time, "to": time, "other": "y"}, (7, 100, "x", uuid, time, time), []),
        ({"page": "", "page_size": "101", "action": "a" * 129, "admin_user_id": "x", "from": "2024-02-29", "to": "2024-13-01T00:00:00Z"}, (None,) * 6, ["page", "page_size", "action", "admin_user_id", "from", "to"]),
        ({"page": "1.5", "page_size": "NaN"}, (None, None, None, None, None, None), ["page", "page_size"]), ({"page": "1000.0", "page_size": "10d"}, (1000, None, None, None, None, None), ["page_size"]), ({"page": "1001", "page_size": None}, (None, 25, None, None, None, None), ["page"]),
    ]
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, m map<string, string>")
    got = [r.p for r in df.select("n", requests.audit_parameters(F.col("m")).alias("p")).orderBy("n").collect()]
    assert [(tuple(p)[:6], p.wrong) for p in got] == [c[1:] for c in cases]
    states = spark.createDataFrame([("suspended",), ("Suspended",), (None,)], "s string").select(requests.account_status(F.col("s")).alias("s")).collect()
    assert [r.s for r in states] == ["suspended", "active", "active"]
