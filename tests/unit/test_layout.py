"""Page layout against plain versions over small pages."""

import random

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import layout

ITEM = "doc long, page long, pos long, text string, x double, y double, width double, height double"
SIZE = "doc long, page long, page_width double, page_height double"


def random_pages(seed, pages):
    """Pages of one, two or three columns, with lines across them, blanks and few items; all places are whole, so sums are exact."""
    draw, out = random.Random(seed), []
    for page in range(pages):
        columns = draw.choice([(50,), (50, 330), (40, 300), (40, 240, 430), (20, 200), (60, 75, 300)])
        for pos in range(draw.choice([6, 11, 12, 20, 40])):
            x = draw.choice(columns) + draw.randint(0, 14)
            wide = draw.random() < 0.06
            text = " " if draw.random() < 0.05 else f"t{pos}"
            out.append((page % 3, page, pos, text, float(20 if wide else x), float(draw.randint(20, draw.choice([200, 780]))), float(500 if wide else draw.choice([0, 3, 60, 120, 150])), 10.0))
    return out


def split_of(items, width, height):
    items = sorted((i for i in items if i[3].strip()), key=lambda i: i[4])
    if len(items) < 12:
        return None
    clusters = []
    for i in items:
        if clusters and i[4] - clusters[-1][0][4] <= 12:
            clusters[-1].append(i)
        else:
            clusters.append([i])
    span = lambda c: (max(i[5] for i in c) - min(i[5] for i in c)) / height
    best, score = None, 0
    for a, b in zip(clusters, clusters[1:], strict=False):
        right = sorted(i[4] + i[6] for i in a)[len(a) // 2]
        gap, at = b[0][4] - right, (right + b[0][4]) / 2
        crossing = sum(i[4] < at - 2 and i[4] + i[6] > at + 2 for i in items)
        if min(len(a), len(b)) < 4 or gap <= width * 0.04 or crossing > max(2, len(items) * 0.2):
            continue
        wide = gap > width * 0.15 and span(a) >= 0.25 and span(b) >= 0.25
        narrow = min(len(a), len(b)) >= len(items) * 0.25 and span(a) >= 0.2 and span(b) >= 0.2 and right < width * 0.55 and b[0][4] > width * 0.45
        own = gap * min(len(a), len(b)) * (2 if wide else 1)
        if (wide or narrow) and own > score:
            best, score = (at, len(a), len(b), pytest.approx(span(a)), pytest.approx(span(b)), gap), own
    return best


def test_column_split(spark):
    rows = random_pages(3, 240)
    pages = sorted({r[:2] for r in rows})
    items, sizes = spark.createDataFrame(rows, ITEM), spark.createDataFrame([(*p, 600.0, 800.0) for p in pages] + [(9, 9, 0.0, 0.0)], SIZE)
    nothing = spark.createDataFrame([(0, 0, 99, None, 1.0, 1.0, 1.0, 1.0), (0, 0, 98, "t", None, 1.0, 1.0, 1.0), (9, 9, 1, "t", 1.0, 1.0, 1.0, 1.0)], ITEM)
    got = {(r.doc, r.page): tuple(r)[2:] for r in layout.column_split(items.unionByName(nothing), sizes).collect()}
    want = {p: s for p in pages if (s := split_of([r for r in rows if r[:2] == p], 600, 800))}
    assert got.keys() == want.keys() and all(got[p] == want[p] for p in want)
    assert 20 < len(want) < len(pages) - 20
    assert layout.column_split(items.limit(0), sizes).count() == 0


def test_lines_by_column(spark):
    rows = [(1, 1, n, f"l{n}", 50.0, 700.0 - 40 * n, 100.0, 9.0) for n in range(8)] + [(1, 1, 20 + n, f"r{n}", 330.0, 701.0 - 40 * n, 100.0, 9.0) for n in range(8)] + [(1, 1, 90, "head", 20.0, 750.0, 550.0, 9.0), (1, 2, 1, "b", 300.0, 700.0, 9.0, 9.0), (1, 2, 2, "a", 10.0, 700.0, 9.0, 9.0)]
    sizes = spark.createDataFrame([(1, 1, 600.0, 800.0)], SIZE)
    got = layout.lines_by_column(spark.createDataFrame(rows, ITEM), sizes).orderBy("page", "block", "line").collect()
    assert [r.text for r in got] == ["head", *[f"l{n}" for n in range(8)], *[f"r{n}" for n in range(8)], "a b"]
    assert [r.block for r in got] == [0] + [1] * 8 + [2] * 8 + [1]


def test_headers_and_footers(spark):
    rows = [(1, 1, 1, "Page 9", 0.0, 20.0), (1, 2, 1, "page 10", 0.0, 64.0), (1, 2, 2, "Page 1", 0.0, 400.0), (1, 1, 2, "No", 0.0, 790.0), (1, 2, 3, "No", 0.0, 790.0), (1, 1, 3, "once only", 0.0, 790.0), (2, 1, 1, "Page 1", 0.0, 20.0), (1, 1, 4, "Page 1", 0.0, None), (3, 1, 1, "Page 1", 0.0, 1.0), (1, 1, 5, None, 0.0, 1.0)]
    lines = spark.createDataFrame(rows, "doc long, page long, pos long, text string, x double, y double")
    sizes = spark.createDataFrame([(d, p, 600.0, 800.0) for d in (1, 2) for p in (1, 2)], SIZE)
    got = layout.strip_repeated(lines, sizes)
    assert got.columns == lines.columns
    assert {(r.doc, r.page, r.pos) for r in got.collect()} == {r[:3] for r in rows} - {(1, 1, 1), (1, 2, 1)}


def test_link_targets(spark):
    rows = random_pages(5, 12)
    rects = [(r[0], r[1], n, f"u{n}", r[4] + 9.0, r[5] + 150.0 * (n % 3), r[4] - 9.0, r[5] - 2.0) for n, r in enumerate(rows[::5])] + [(0, 0, 900, None, 0.0, 0.0, 600.0, 800.0), (0, 0, 901, "", 0.0, 0.0, 600.0, 800.0), (0, 0, 902, "none", None, 0.0, 600.0, 800.0)]
    want = {r[:3]: r[3] for r in rows}
    for d, p, _, url, x1, y1, x2, y2 in rects[:-3]:
        met = [r for r in rows if r[:2] == (d, p) and r[4] <= max(x1, x2) and r[4] + r[6] >= min(x1, x2) and r[5] <= max(y1, y2) and r[5] + r[7] >= min(y1, y2)]
        if met:
            want[max(r[:3] for r in met)] += f" ({url})"
    links = spark.createDataFrame(rects, "doc long, page long, nr long, url string, x1 double, y1 double, x2 double, y2 double")
    got = layout.with_link_targets(spark.createDataFrame(rows, ITEM), links)
    assert {(r.doc, r.page, r.pos): r.text for r in got.collect()} == want
    assert any(t.count("(") > 1 for t in want.values())


def test_tables_and_fonts(spark):
    lines = {"a   b   c": True, "a   b": False, "a   b | c": True, "a | b": False, "": False}
    got = spark.createDataFrame([(t,) for t in lines], "t string").select("t", layout.like_table_row(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == lines
    fonts = {"ABCDEF+Odd": "safe", "ABCDE+Odd": "unembedded", " Open Sans ": "safe", "ABCDEF+Symbol": "symbol", "serif": None, "Serif": "unembedded", " ": None}
    got = spark.createDataFrame([(t,) for t in fonts] + [(None,)], "t string").select("t", layout.font_kind(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == fonts | {None: None}
