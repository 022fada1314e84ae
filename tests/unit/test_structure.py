"""Reports on dates and bullets against plain versions."""

import itertools
import random

from pyspark.sql import functions as F

from dossierflow.functions import dates, text
from dossierflow.operators import intervals, structure

NOW = 2020 * 12 + 5
ROLE = "k long, kind string, pos long, start_date string, end_date string, mixed string"


def test_ranges(spark):
    y = lambda year, month=1: year * 12 + month - 1
    cases = {
        "Jan 2019 - Present": (y(2019), NOW), "03/2018 to 04/2019": (y(2018, 3), y(2019, 4)), "2018": (y(2018), y(2018, 12)), "Summer 2019": (y(2019), y(2019, 12)), " - Mar 2018": (y(2018), y(2018, 12)),
        "Mar 2018 - soon": (y(2018, 3), None), "soon": (None, None), "": (None, None), "present - 2019": (None, y(2019)), "2018 – 2019": (y(2018), y(2019)),
    }
    got = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", dates.parse_range(F.col("t"), F.lit(NOW)).alias("r")).collect()
    assert {r.t: (r.r.start, r.r.end) for r in got} == cases | {None: (None, None)}
    ends = [(y(2021, 12), "ok"), (y(2022), "invalid"), (y(2018), "invalid"), (None, "unparsed")]
    got = spark.createDataFrame([(y(2019), e) for e, _ in ends], "s int, e int").select(dates.range_status(F.col("s"), F.col("e"), F.lit(NOW)).alias("r")).collect()
    assert [r.r for r in got] == [s for _, s in ends]


def test_overlap_count_and_order(spark):
    draw = random.Random(8)
    rows = [(draw.randint(0, 5), n, s := draw.randint(0, 40), s + draw.randint(-4, 12)) for n in range(400)] + [(9, 1, 5, 5), (8, 1, 9, 9), (8, 9000, 9, 9), (7, 1, 5, 5), (7, 9000, 6, 6)]
    df = spark.createDataFrame(rows, "k long, pos long, s int, e int")
    for least in (1, 2, 5):
        want = {}
        for a, b in itertools.combinations(rows, 2):
            if a[0] == b[0] and min(a[3], b[3]) - max(a[2], b[2]) + 1 >= least:
                want[a[0]] = want.get(a[0], 0) + 1
        assert {r.k: r.overlaps for r in intervals.overlap_count(df, "k", least).collect()} == want
    fall = spark.createDataFrame([(k, p, s) for k, starts in {1: (9, 9, 8, 3, 3, 1), 2: (9, 8, 7, 7, 8, 1), 3: (4,), 4: (1, 2)}.items() for p, s in enumerate(starts)], "k long, pos long, s int")
    for block in (1, 2, 3, 4096):
        assert {r.k: r.newest_first for r in intervals.newest_first(fall, "k", "pos", block=block).collect()} == {1: True, 2: False, 3: None, 4: False}
    assert intervals.newest_first(df, "k", "pos").where("k = 7").first().newest_first is False


def test_structure_and_quality(spark):
    job, school = structure.KINDS
    roles = [
        (1, job, 1, "Jan 2019", "Present", "x"), (1, job, 2, "Jan 2018", "Dec 2018", "x"),  # without a fault
        (2, job, 1, "2015", "2016", "x"), (2, job, 2, "01/2016", "03/2018", "x"), (2, job, 3, "Mar 2019", "whenever", "x"), (2, job, 4, "May 2019", "May 2001", "x"),
        (3, job, 1, None, "", "x"), (3, school, 1, "2011", "2012", "x"), (None, job, 1, "2015", "2016", "x"),
        *[(4, job, n, "Jan 2019", "nowhere" if n % 2 else "later", "x") for n in range(6)],
    ]
    told = structure.structure_report(spark.createDataFrame(roles, ROLE), "k", F.lit(NOW))
    got = {r.k: r for r in told.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].findings, got[1].structure_score, got[1].months, got[1].newest_first) == ([], 100.0, 30, True)
    assert (got[2].mixed, got[2].newest_first, got[2].overlaps, got[2].unparsed, got[2].invalid, got[2].structure_score) == (True, False, 0, 1, 1, 55.0)
    assert (got[2].unparsed_ranges, got[2].invalid_ranges, got[2].months, got[2].overlap_months) == (["Mar 2019 - whenever"], ["May 2019 - May 2001"], 39, 1)
    assert (got[3].newest_first, got[3].structure_score, got[3].months) == (None, 100.0, 0)
    assert (got[4].unparsed, got[4].unparsed_ranges, got[4].overlaps) == (3, ["Jan 2019 - later", "Jan 2019 - later", "Jan 2019 - later"], 3)  # "nowhere" holds "now"
    bullets = spark.createDataFrame([(1, "Built 3 tools for 40 users."), (1, "  "), (1, None), (5, "Was here"), (5, "Responsible for it. And more!"), (None, "Built")], "k long, b string")
    report = {r.k: r for r in structure.quality_report(bullets, told, "k", "b").collect()}
    assert sorted(report) == [1, 2, 3, 4, 5]
    assert (report[2].bullets, report[2].readability, report[2].quality_score) == (0, 60.0, 25.75) and report[2].findings[-1] == "no_bullets"
    assert report[1].verb_density == 100.0 and report[1].readability == 60.0 and report[1].quality_score == 77.0
    assert (report[5].structure_score, report[5].sentences, report[5].words) == (100.0, 3, 7) and "passive_openers" in report[5].findings
    nothing = structure.structure_report(spark.createDataFrame([], ROLE), "k", F.lit(NOW))
    assert structure.quality_report(bullets.limit(0), nothing, "k", "b").count() == 0


def test_bullets_count_as_one_text(spark):
    draw = random.Random(2)
    words = ["made", "it", "v.2", "e.g.", "so?", "well!", "1.", "...", "a.b", "x"]
    groups = [[" ".join(draw.choices(words, k=draw.randint(1, 6))) for _ in range(draw.randint(1, 5))] for _ in range(200)]
    df = spark.createDataFrame([(n, b) for n, g in enumerate(groups) for b in g], "n long, b string")
    parts = {r.n: r.s for r in df.groupBy("n").agg(F.sum(text.worded_parts(F.col("b"))).alias("s")).collect()}
    whole = spark.createDataFrame([(n, ". ".join(g)) for n, g in enumerate(groups)], "n long, t string").select("n", text.worded_parts(F.col("t")).alias("s")).collect()
    assert {r.n: r.s for r in whole} == parts
