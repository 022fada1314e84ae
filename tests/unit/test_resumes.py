"""Nested documents: canonical JSON, flattening, validation against the source, refusal of advice, closures."""

import itertools
import json

from pyspark.sql import functions as F

from dossierflow.operators import resumes


def test_canonical_json(spark):
    value = {"b": [1, {"z": None, "a": "é\"x"}], "a": {"d": {"y": 1, "x": [True]}, "c": "t"}}

    def spellings(v):
        if isinstance(v, dict):
            inner = [spellings(x) for x in v.values()]
            for own in itertools.product(*inner):
                for order in itertools.permutations(zip(v, own, strict=True)):
                    yield "{ " + ", ".join(f"{json.dumps(k)} :{x}" for k, x in order) + "}"
        elif isinstance(v, list):
            yield from ("[" + " ,".join(x) + "]" for x in itertools.product(*map(spellings, v)))
        else:
            yield json.dumps(v)

    texts = list(spellings(value))
    rows = spark.createDataFrame([(t,) for t in texts] + [("no json",), (None,)], "t string")
    got = [r[0] for r in rows.select(resumes.canonical_json(F.col("t"))).collect()]
    assert len(texts) >= 16 and set(got[:-2]) == {json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)} and got[-2:] == [None, None]
    assert rows.limit(len(texts)).select(resumes.content_hash(F.col("t"))).distinct().count() == 1
    assert spark.range(1).select(resumes.cache_key(F.lit("a"), F.lit(None).cast("int"), F.lit(True))).first()[0] == "a::::true"


SCHEMA = """k int, body string, summary string, contact struct<email string, phone string>, education array<struct<institution string, degree string, honors array<string>>>,
    experience array<struct<title string, company string, bullet_points array<string>, technologies_used array<string>>>, projects array<struct<title string, bullet_points array<string>>>, skills struct<technical array<string>, languages array<string>>,
    certifications array<struct<name string, issuer string>>, achievements array<string>"""
ROWS = [
    (1, "Jane@Ex.org studied at Mas-\nsachusetts Tech, MSc Physics, worked for John Smith Ltd; AWS Pro", "Sum", ("jane@ex.org", "1"), [("Massachusetts Tech", "MSc  physics", ["h1", ""]), ("Yale", "BA", []), ("Massachusetts Tech", "PhD", None)], [("dev", "J. Smith", ["b1", " "], ["Go", "SQL"]), (None, "Acme", None, [])], [("P", ["p1"])], (["Go"], ["French"]), [("AWS Pro", "Amazon"), ("Fake", None)], ["won"]),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "text", "", ("", None), [], [], [], ([], None), [], []),
]


def test_validation(spark):
    got = {r["k"]: r for r in resumes.validated(spark.createDataFrame(ROWS, SCHEMA), "body").collect()}
    one = got[1]
    assert one["contact"]["email"] == "jane@ex.org" and one["contact"]["phone"] == "1"
    assert [(e["institution"], e["degree"]) for e in one["education"]] == [("Massachusetts Tech", "MSc  physics"), ("Massachusetts Tech", None)]
    assert [e["company"] for e in one["experience"]] == ["J. Smith", ""]  # John Smith by his initial and [c["name"] for c in one["certifications"]] == ["AWS Pro"]
    assert [(w["field"], w["value"]) for w in one["warnings"]] == [("education.institution", "Yale"), ("education.degree", "PhD"), ("experience.company", "Acme"), ("certifications.name", "Fake")]
    assert all(w["reason"] == resumes.REASONS[w["field"]] for w in one["warnings"]) and not one["validated"]
    for k in (2, 3):
        assert got[k]["validated"] and got[k]["warnings"] == [] and got[k]["education"] == []
    assert got[2]["contact"] is None


def test_names_with_another_first_name(spark):
    cases = [("Jane Smithson", "by j. smithson", False), ("Jane Smithson", "by john smithson", True), ("Jane Doe", "john doe", False), ("Jane Smithson", "ann smithson", False), ("x", "", True), ("", "a", False), (None, "a", False), ("front end", "the front-end", True), ("ab cd", "ab-cd", False), ("big data set", "big-dataset", True), ("ox vieau", "a éon vieau", True), ("ox vieau", "a bon vieau", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, s string, want boolean")
    got = rows.select("i", resumes.stands_in(F.col("v"), F.col("s")).alias("got"), "want").collect()
    assert [(r["i"], r["got"]) for r in got] == [(r["i"], r["want"]) for r in got]


def test_flattening(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["k"]: r["t"] for r in docs.select("k", resumes.flattened(docs).alias("t")).collect()}
    assert got[1].split("\n") == [
        "SUMMARY", "Sum", "jane@ex.org | 1", "EXPERIENCE", "PROJECTS", "EDUCATION", "MSc  physics, Massachusetts Tech", "h1", "BA, Yale", "PhD, Massachusetts Tech", "dev, J. Smith", "b1", "Technologies: Go, SQL", "Acme", "P", "p1",
        "SKILLS", "CERTIFICATIONS", "ACHIEVEMENTS", "Skills: Go, French", "AWS Pro, Amazon", "Fake", "won",
    ]
    assert got[2] == "" and got[3] == ""


def test_notices_are_merged_over_flagged_ones(spark):
    rows = spark.createDataFrame([(1, True, ["b", "a"], "resume"), (1, False, ["c"], "other"), (1, True, ["a"], "posting"), (2, False, [], "resume")], "k int, flagged boolean, matches array<string>, document string")
    got = {r["k"]: (r["flagged"], r["matches"], r["documents"]) for r in resumes.merged_notices(rows, "k").collect()}
    assert got == {1: (True, ["a", "b"], ["posting", "resume"]), 2: (False, [], [])}


def test_each_refusal_has_its_reason(spark):
    good, posting, resume = "Consider describing a project in which the tool was used daily.", "We look for Apache Kafka experience in teams", "I built streams with Apache Flink and Redis at scale"
    cases = [(good, "Apache Kafka experience", [], None)]
    for text, name in (
        ("Add Kafka to your skills list, then go on and on.", "add_skill_instruction"), ("Include 'Kafka' in your resume, then go on and on.", "include_skill_instruction"), ("Mention that you know it well, then go on and on.", "claim_skill_instruction"),
        ("Raise your match score by doing this, then go on and on.", "score_gaming"), ("That is worth 5 points to them, then go on and on.", "points_or_percentage"), ("Pad the text with keywords, then go on and on.", "keyword_stuffing"),
        ("Do not lie about it, but then go on and on and on.", "fabrication"), ("There is no guarantee of an interview, go on and on.", "guarantee"),
    ):
        cases.append((text, "Apache Kafka experience", [], f"forbidden_pattern:{name}"))
    cases += [
        (good, "Rust required", [], "requirement_excerpt_not_grounded"), (good + ' "a passage of nobody"', "Apache Kafka experience", [], "quoted_text_not_grounded"), (good + ' "streams with Apache Flink"', "Apache Kafka experience", ["Redis", "known one", "x"], None),
        (good, "Apache Kafka experience", ["Redis", "Cobol"], "unverified_related_asset"), ("Too short.", "Apache Kafka experience", [], "action_too_short"), (None, "Apache Kafka experience", None, "action_too_short"), (good, None, [], "requirement_excerpt_not_grounded"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, action string, excerpt string, assets array<string>, want string")
    reason = resumes.rejection(F.lit("Not found."), F.col("action"), F.col("assets"), F.col("excerpt"), F.lit(posting), F.lit(resume), F.lit(""), F.array(F.lit("Known One")))
    got = rows.select("i", reason.alias("got"), "want").orderBy("i").collect()
    assert [(r["i"], r["got"]) for r in got] == [(r["i"], r["want"]) for r in got]


def test_closure_of_links_with_a_circle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("a", "c"), ("x", "y"), ("d", "e")], "parent string, node string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in resumes.descendants(links, roots, 3).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    keys = [spark.createDataFrame([("b", "k1"), ("b", "k2"), ("x", "k9"), ("e", None), ("e", "")], "node string, key string"), spark.createDataFrame([("d", "k1"), ("e", "k3")], "node string, key string")]
    got = resumes.deletion_keys(resumes.descendants(links, roots, 3), keys, 1).collect()
    assert sorted(r["key"] for r in got) == ["k1", "k2", "k3"] and len({r["chunk"] for r in got}) == 3
