"""Terms by token index against patterns, staged matches on stated cases, evidence in order, and rules for requirements."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from dossierflow.functions.text import contains_term
from dossierflow.operators import evidence, matching, quality, requirements

TEXTS = [
    None, "", "C++ and C#, .NET; node.js!", "asp.net", "Front-End / front end", "front  -  end", "a.b", "CI/CD pipelines", "ci / cd", "state of the art", "state-of-the-art.", "R&D", "go", "Go-lang (golang)", "x_y z",
    "Élan vital é", "word word word", "word", "(word)", "words", "c", "c++", "xc++ y", "c+++", "日本 語", "node. js", "node.jsx", "big data, big  data-sets", "end\nfront\nend",
]
TERMS = ["C++", "c#", ".NET", "node.js", "front end", "front-end", "CI/CD", "state of the art", "R&D", "go", "x_y", "élan", "word", "word word", "c", "  big data ", "日本", "++", "", "end front", "a.b", "net;"]


def test_token_index_equals_patterns(spark):
    lines = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = {(r["k"], r["term"].strip()) for r in lines.crossJoin(terms).where(contains_term(F.col("text"), F.col("term"))).collect()}
    got = [(r["k"], r["term"]) for r in evidence.term_hits(lines, ["k"], "text", evidence.term_index(terms, "term")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, t) for k, t in want if re.search(r"\w", t)} and len(got) > 20
    assert evidence.term_hits(lines, ["k"], "text", evidence.term_index(terms.limit(0), "term")).collect() == []


ENTITIES = [(1, "JavaScript", ["js", "ecmascript"], []), (2, "React", ["react.js"], ["JavaScript"]), (3, "Vue", ["vue.js"], ["JavaScript"]), (4, "PostgreSQL", ["postgres"], ["SQL"]), (5, "JS twin", ["js"], [])]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "pos int, canonical string, aliases array<string>, parents array<string>")


def match(spark, entities, item, source="required", listed=(), tools=(), bullets=(), text="", similar=()):
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    held = "k int, pos int, item string"
    out = evidence.match_texts(
        table([(1, item, source)], "k int, item string, source string"), table([(1, i, x) for i, x in enumerate(listed)], held), table([(1, i, x) for i, x in enumerate(tools)], held),
        table([(1, i, x) for i, x in enumerate(bullets)], "k int, pos int, text string"), table([(1, " ".join([text, *bullets]))], "k int, text string"), entities, table([(1, item, *s) for s in similar], "k int, item string, similarity double, of_bullet boolean"), "k",
    ).collect()
    assert len(out) == 1
    return out[0]["category"], out[0]["credit"], out[0]["related"], out[0]["evidence"]


def test_stages(spark, entities):
    assert match(spark, entities, "React", bullets=["Built UIs with React.js"]) == ("EXACT", 1.0, None, 1)
    assert match(spark, entities, "react", listed=["React"]) == ("MENTIONED_WITHOUT_EVIDENCE", 0.6, None, 0)
    assert match(spark, entities, "react", tools=["React"]) == ("EXACT", 1.0, None, 0)
    assert match(spark, entities, "Vue", listed=["React"]) == ("MENTIONED_WITHOUT_EVIDENCE", 0.51, "React", 0)
    assert match(spark, entities, "Vue", listed=["React"], bullets=["shipped react.js apps"]) == ("STRONG_RELATED", 0.85, "React", 1)
    assert match(spark, entities, "Vue", tools=["js"]) == ("STRONG_RELATED", 0.85, "js", 0)
    assert match(spark, entities, "postgres") == ("MENTIONED_WITHOUT_EVIDENCE", 0.51, None, 0)  # another name of an entity
    assert match(spark, entities, "Rust", similar=[(0.9, False)]) == ("PARTIAL", 1.0, None, 0)
    assert match(spark, entities, "Rust", similar=[(0.75, False)]) == ("PARTIAL", 0.65, None, 0)
    assert match(spark, entities, "Rust", similar=[(0.65, False)]) == ("PARTIAL", 0.0, None, 0)
    assert match(spark, entities, "Rust", similar=[(0.65, True)]) == ("PARTIAL", 0.25, None, 0)
    assert match(spark, entities, "Rust", similar=[(0.1, True)]) == ("MISSING_REQ", 0.0, None, 0)
    assert match(spark, entities, "Rust", source="preferred") == ("MISSING_PREF", 0.0, None, 0)
    assert match(spark, entities, "Rust", source="tool") == ("MISSING_REQ", 0.0, None, 0)


def test_not_relevant_and_assets(spark, entities):
    held = spark.createDataFrame([(1, 0, "React"), (1, 1, "postgres"), (1, 2, "Cobol"), (1, 3, "ecmascript"), (1, 4, " vue.js ")], "k int, pos int, item string")
    asked = spark.createDataFrame([(1, "Vue"), (1, "cobol 85")], "k int, item string")
    assert {r["item"] for r in evidence.not_relevant(held.select("k", "item"), asked, entities, "k").collect()} == {"postgres"}
    texts = spark.createDataFrame([(1, "I know JavaScript well")], "k int, text string")
    got = evidence.related_assets(asked, held, texts, entities, "k").orderBy("rank").collect()
    assert [(r["item"], r["rank"], r["asset"]) for r in got] == [("Vue", 1, "JavaScript"), ("Vue", 2, "React"), ("Vue", 3, "ecmascript"), ("Vue", 4, "vue.js")]


SCHEMA = "k int, experience array<struct<company string, title string, bullet_points array<string>, technologies_used array<string>>>, projects array<struct<title string, description string, bullet_points array<string>, technologies_used array<string>>>, summary string, achievements array<string>, certifications array<struct<name string, issuer string>>"


def test_evidence_comes_in_order_and_is_limited(spark, entities):
    rows = [
        (1, [("A", "dev", ["Nothing", "Used  REACT.js daily"], ["react"]), ("B", None, None, ["React"])], [("P", "a react project", ["x"], [])], "react in summary", ["react award"], [("React cert", "Org"), ("React two", None)]),
        (2, None, None, None, None, [("React two", "")]), (3, [], [("P", "react", None, ["React"])], "react", ["react"], []),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    asked = docs.select("k", F.lit("React").alias("item"))
    said = evidence.provenance(docs, "k")
    of = lambda k, most: [(r["origin"], r["title"], r["snippet"]) for r in evidence.skill_evidence(said, asked, entities, "k", most).where(F.col("k") == k).orderBy("rank").collect()]
    assert of(1, 2) == [("experience", "dev", "Used REACT.js daily"), ("experience", "dev", "react — listed under dev at A")]
    assert [o for o, _, _ in of(1, 20)] == ["experience"] * 3 + ["project", "summary", "achievement", "certification", "certification"]
    assert of(1, 20)[-2:] == [("certification", None, "React cert — Org"), ("certification", None, "React two")]
    assert of(2, 2) == [("certification", None, "React two")]
    assert of(3, 2) == [("project", "P", "react"), ("project", "P", "React — listed under the project P")]


def test_unmet_summary(spark):
    rows = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", False), (2, 0, "d", True)], "k int, pos int, r string, ok boolean")
    got = {r["k"]: (r["unmet"], r["summary"]) for r in evidence.summary_of_unmet(rows, "k", "pos", "r", "ok").collect()}
    assert got == {1: (2, "2 non-negotiable requirement(s) could not be verified: a; c."), 2: (0, "All stated non-negotiable requirements were found in your document.")}


def test_gap_priorities(spark):
    cases = [("MISSING_REQ", "required", "high"), ("MENTIONED_WITHOUT_EVIDENCE", "required", "high"), ("MISSING_PREF", "preferred", "medium"), ("MENTIONED_WITHOUT_EVIDENCE", "preferred", "medium"), ("MISSING_REQ", "tool", "high"), ("EXACT", "required", None)]
    rows = spark.createDataFrame([(i, c, s, 0.0) for i, (c, s, _) in enumerate(cases)], "i int, category string, source string, credit double")
    got = {r["i"]: r["priority"] for r in matching.gaps(rows).collect()}
    assert [got.get(i) for i in range(len(cases))] == [p for _, _, p in cases]


def test_stated_requirements_equal_requirements_by_row(spark):
    asked = ["US citizen", "secret clearance", "3+ years of work", "PMP required", "Any licence", "certified", "Master's degree", "PhD", "Knows Apache Spark and Kafka streaming", "of it", ""]
    bodies = [("US citizenship; PMP; Scrum guide", 40, ["MSc physics", "Doctorate"], ["Scrum guide"]), ("nothing", None, None, None), ("secret: Apache Kafka, streaming. master", 12, ["BA"], [None, "kafka"]), ("apache spark", 500, [], [])]
    docs = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "i int, body string, months int, degrees array<string>, certs array<string>")
    listed = requirements.verdicts(docs, asked, "body", "months", "degrees", "certs")
    by_row = requirements.checked(docs.crossJoin(spark.createDataFrame([(a,) for a in asked], "requirement string")), "requirement", "body", "months", "degrees", "certs")
    read = lambda df: sorted(map(tuple, df.select("i", "requirement", "method", "verified", "matched").collect()), key=repr)
    assert read(listed) == read(by_row) and len(read(listed)) == len(asked) * len(bodies)
    got = {(r["i"], r["requirement"]): (r["verified"], r["matched"]) for r in listed.collect()}
    assert got[0, "Any licence"] == (True, "Scrum guide") and got[2, "certified"] == (True, "kafka") and got[0, "PMP required"] == (True, "pmp")
    assert got[0, "Master's degree"] == (True, "MSc physics") and got[2, "Master's degree"] == (True, "master") and got[1, "PhD"] == (False, None)


def test_beginners_projects_count(spark):
    sims = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    score = lambda beginners, projects=None: quality.experience_score(F.lit(12), F.lit(1.0), sims(0.3, 0.3), projects, F.lit(beginners))
    got = spark.range(1).select(score(True, sims(0.9, 0.9)), score(False, sims(0.9, 0.9)), score(True)).first()
    assert tuple(got) == (100.0, 35.0, 35.0)


def test_terms_of_every_length_meet(spark):
    words = ["a1", "b2", "c3", "d4", "e5"]
    terms = [" ".join(words[i:j]) for i, j in itertools.combinations(range(6), 2)]
    lines = spark.createDataFrame([(1, "a1 b2-c3  d4\te5")], "k int, text string")
    got = {r["term"]: r["at"] for r in evidence.term_hits(lines, ["k"], "text", evidence.term_index(spark.createDataFrame([(t,) for t in terms], "t string"), "t")).collect()}
    assert got == {" ".join(words[i:j]): i for i, j in itertools.combinations(range(6), 2)}


def test_hits_alone_are_shuffled(spark, capsys):
    lines = spark.createDataFrame([(1, "alpha beta alpha\nbeta-gamma"), (2, None), (3, "gamma")], "k int, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the size of the index is not known
    try:
        hits = evidence.term_hits(lines, ["k"], "text", evidence.term_index(spark.createDataFrame([("alpha",), ("Beta gamma",)], "t string"), "t"))
        assert sorted(map(tuple, hits.collect())) == [(1, "Beta gamma", 3), (1, "alpha", 0)]
        hits.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_what_is_known_of_a_document_is_shuffled_once(spark, entities, capsys):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    held, texts = "k int, pos int, item string", "k int, text string"
    required = table([(1, "React", "tool"), (1, "React", "required"), (1, "re-act", "required"), (1, "Rust", "preferred"), (2, "Rust", "required"), (None, "React", "required"), (2, None, "required")], "k int, item string, source string")
    bullets = table([(1, 0, "react, React.js and a react"), (1, 1, "Rust"), (1, 2, "reactjs; re-act"), (None, 0, "React")], "k int, pos int, text string")
    similar = table([(2, "Rust", 0.7, False), (2, "Rust", 0.65, True), (2, None, 0.9, True), (None, "React", 0.9, True)], "k int, item string, similarity double, of_bullet boolean")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sizes are not known
    try:
        out = evidence.match_texts(required, table([(1, 0, "Rust"), (None, 0, "React")], held), table([], held), bullets, table([(1, "react rust"), (None, "React")], texts), entities, similar, "k")
        capsys.readouterr()
        out.explain()
        got = {(r["k"], r["item"]): (r["source"], r["category"], r["credit"], r["similarity"], r["evidence"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert got == {
        (1, "React"): ("required", "EXACT", 1.0, None, 1), (1, "re-act"): ("required", "MISSING_REQ", 0.0, None, 1), (1, "Rust"): ("preferred", "EXACT", 1.0, None, 1),
        (2, "Rust"): ("required", "PARTIAL", 0.25, 0.7, 0), (None, "React"): ("required", "MISSING_REQ", 0.0, None, 0), (2, None): ("required", "MISSING_REQ", 0.0, None, 0),
    }
    assert plan.count("hashpartitioning(k#") == 1


def test_bullets_are_counted_beyond_any_block(spark, entities):
    at = [-65, -64, -1, 0, 1, 63, 64, 127, 128, 6400, 2**31 + 5]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    bullets = table([(1, p, t) for p in at for t in ("react", "React.js, react")] + [(1, 7, "vue")], "k int, pos long, text string")
    none = table([], "k int, pos int, item string")
    out = evidence.match_texts(table([(1, "react", "required")], "k int, item string, source string"), none, none, bullets, table([(1, "react")], "k int, text string"), entities, table([], "k int, item string, similarity double, of_bullet boolean"), "k")
    assert [tuple(r) for r in out.select("category", "evidence").collect()] == [("EXACT", len(at))]
