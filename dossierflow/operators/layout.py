"""Page layout from positioned items, and image thresholds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_for_repeats


def group_lines(items: DataFrame, tolerance: float = 3.0, block: str | None = None) -> DataFrame:
    """``(doc, page, line, y, text)``: items whose baseline lies within the tolerance of the line's first.

    With a ``block``, an integer column of ``items``, lines are those of one
    block each and have it as a further column. What joins a line depends on
    its first item, so items are sorted within partitions of whole pages; a
    task holds a batch and the line that is open.
    """
    schema = "doc long, page long, block int, line int, y double, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line: list = []
        number = 0
        for batch in itertools.chain(batches, [None]):
            rows = []
            for item in batch.itertuples(index=False) if batch is not None else [None]:
                here = bool(line) and item is not None and (item.doc, item.page, item.block) == (line[0].doc, line[0].page, line[0].block)
                if line and (not here or abs(line[0].y - item.y) > tolerance):
                    rows.append((line[0].doc, line[0].page, line[0].block, number, line[0].y, joined(line)))
                    number = number + 1 if here else 0
                    line = []
                if item is not None:
                    line.append(item)
            yield pd.DataFrame(rows, columns=["doc", "page", "block", "line", "y", "text"])

    of = (F.col(block) if block else F.lit(0)).cast("int").alias("block")
    ordered = items.select("doc", "page", of, "text", "x", "y", "width").repartition("doc", "page").sortWithinPartitions("doc", "page", "block", F.desc("y"), "x", "text", "width")
    lines = ordered.mapInPandas(run, schema)
    return lines.withColumnRenamed("block", block) if block else lines.drop("block")


def joined(line: list) -> str:
    """A line's items from left to right, with a blank where the gap is wide."""
    text, at = "", None
    for i in sorted(line, key=lambda i: i.x):
        gap = 0 if at is None else i.x - at
        text += (" " if at is not None and gap > max(1.2, 0.4 * i.width / max(len(i.text), 1)) else "") + i.text
        at = i.x + i.width
    return " ".join(text.split())


def column_side(x: Column, width: Column, split: Column, slack: float = 2.0) -> Column:
    """``spanning`` where an item crosses the split, else the side it lies on."""
    return F.when((x < split - slack) & (x + width > split + slack), "spanning").when(x >= split - slack, "right").otherwise("left")


def in_reading_order(items: DataFrame, split: Column) -> DataFrame:
    """``items`` with ``side`` and ``place``: what spans the columns first, then the left, then the right one, each from the top; without a split all is the left column."""
    side = column_side(F.col("x"), F.col("width"), split)
    order = Window.partitionBy("doc", "page").orderBy(side_rank(side), F.desc("y"), "x", "text")
    return items.withColumn("side", side).withColumn("place", F.row_number().over(order))


def side_rank(side: Column) -> Column:
    return F.when(side == "spanning", 0).when(side == "left", 1).otherwise(2)


def _by_left_edge(items: DataFrame, most: float) -> DataFrame:
    """``items (doc, page, x, y, edge)`` with ``cluster``: from the left, an item opens a new one where it starts over ``most`` right of the cluster's first.

    Where a cluster starts depends on the one before, so items are sorted
    within partitions of whole pages; a task carries one start and its number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, start, number = None, 0.0, 0
        for batch in batches:
            numbers = []
            for doc, page, x in zip(batch["doc"], batch["page"], batch["x"], strict=True):
                if (doc, page) != of:
                    of, start, number = (doc, page), x, 0
                elif x - start > most:
                    start, number = x, number + 1
                numbers.append(number)
            yield batch.assign(cluster=numbers)

    ordered = items.select("doc", "page", "x", "y", "edge").repartition("doc", "page").sortWithinPartitions("doc", "page", "x")
    return ordered.mapInPandas(run, "doc long, page long, x double, y double, edge double, cluster int")


def column_split(items: DataFrame, sizes: DataFrame, slack: float = 2.0) -> DataFrame:
    """``(doc, page, split_x, left_count, right_count, left_span, right_span, gap)``: where a page of two columns is split; other pages have no row.

    ``sizes (doc, page, page_width, page_height)`` has one row for each page.
    Neighbouring clusters of items by left edge are compared: the gap is
    measured from the upper median of the left one's right edges, few items
    may cross it, and the greatest gap by the smaller cluster's items wins,
    wide gaps counting twice. Items that cross are counted by a running sum
    over where items start and end, so no pairs are formed. Items with blank
    texts or null places take no part, nor do pages without a positive size.
    """
    x, y, width = (F.col(c).cast("double") for c in ("x", "y", "width"))
    usable = items.where(F.trim("text") != "").select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("long").alias("page"), x.alias("x"), y.alias("y"), (x + width).alias("edge")).dropna()
    of = ["doc", "page"]
    cluster = Window.partitionBy(*of, "cluster")
    placed = _by_left_edge(usable, 12.0).withColumns({"i": F.row_number().over(cluster.orderBy("edge")) - 1, "m": F.count("*").over(cluster)})
    clusters = placed.groupBy(*of, "cluster").agg(F.min("x").alias("start"), F.max(F.when(F.expr("i = m div 2"), F.col("edge"))).alias("right"), F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span"))
    page = Window.partitionBy(*of)
    pairs = clusters.withColumns({"next": F.lead(F.struct("start", "n", "span")).over(page.orderBy("cluster")), "total": F.sum("n").over(page)})
    pairs = pairs.where("total >= 12 and n >= 4 and next.n >= 4").join(sizes.where("page_width > 0 and page_height > 0").select(*of, "page_width", "page_height"), of)
    pairs = pairs.withColumns({"gap": F.col("next.start") - F.col("right"), "split_x": (F.col("right") + F.col("next.start")) / 2}).where("gap > page_width * 0.04")
    found = ["split_x", "cluster", "total", "gap", "right", "n", "span", "next", "page_width", "page_height"]
    # at one place, items end before a split there and start after it
    ends = F.array(F.struct((F.col("edge") - slack).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step")), F.struct((F.col("x") + slack).alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("step")))
    events = usable.where(F.col("edge") - F.col("x") > 2 * slack).select(*of, F.inline(ends))
    asked = pairs.select(*of, F.col("split_x").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"), F.struct(*found).alias("pair"))
    running = page.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asked = events.unionByName(asked, allowMissingColumns=True).withColumn("crossing", F.sum("step").over(running)).where("kind = 1").select(*of, "crossing", "pair.*")
    asked = asked.where("crossing <= greatest(2.0D, total * 0.2D)").withColumns({"left_span": F.col("span") / F.col("page_height"), "right_span": F.col("next.span") / F.col("page_height")})
    wide = F.expr("gap > page_width * 0.15D and left_span >= 0.25D and right_span >= 0.25D")
    narrow = F.expr("least(n, next.n) >= total * 0.25D and left_span >= 0.2D and right_span >= 0.2D and right < page_width * 0.55D and next.start > page_width * 0.45D")
    score = F.col("gap") * F.least("n", "next.n") * F.when(wide, 2).otherwise(1)
    best = asked.where(wide | narrow).select(*of, F.struct(score.alias("score"), (-F.col("cluster")).alias("first")).alias("rank"), F.struct("split_x", F.col("n").alias("left_count"), F.col("next.n").alias("right_count"), "left_span", "right_span", "gap").alias("best"))
    return best.groupBy(*of).agg(F.max_by("best", "rank").alias("best")).select(*of, "best.*")


def lines_by_column(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(doc, page, block, line, y, text)``: lines of what spans the columns (block 0), of the left (1) and of the right column (2); a page without a split is block 1. Blocks and lines are in reading order."""
    split = column_split(items, sizes).select("doc", "page", "split_x")
    sided = items.join(split, ["doc", "page"], "left").withColumn("block", side_rank(column_side(F.col("x"), F.col("width"), F.col("split_x"))))
    return group_lines(sided, block="block")


def repeated_lines(lines: DataFrame, least_pages: int = 2, least_chars: int = 3) -> DataFrame:
    """Normal forms of lines that stand on several pages of a document."""
    keyed = lines.withColumn("key", normal_for_repeats(F.col("text"))).where(F.length("key") >= least_chars)
    return keyed.groupBy("doc", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least_pages)


def strip_repeated(lines: DataFrame, sizes: DataFrame, band: float = 0.08) -> DataFrame:
    """``lines (doc, page, y, text, ...)`` without headers and footers: lines in the band at a page's top or foot whose normal form stands in such bands of several pages of the document. Lines of null height or without a page size stay."""
    heights = sizes.select("doc", "page", F.col("page_height").alias("__height"))
    edge = (F.col("y") >= F.col("__height") * (1 - band)) | (F.col("y") <= F.col("__height") * band)
    keyed = lines.join(heights, ["doc", "page"], "left").withColumn("__key", F.when(edge, normal_for_repeats(F.col("text"))))
    repeated = repeated_lines(keyed.where("__key is not null").select("doc", "page", "text")).select("doc", F.col("key").alias("__key"))
    return keyed.join(repeated, ["doc", "__key"], "left_anti").select(*lines.columns)


def with_link_targets(items: DataFrame, links: DataFrame, band: float = 64.0) -> DataFrame:
    """``items (doc, page, pos, x, y, width, height, text, ...)``, each text followed by the addresses of the ``links (doc, page, nr, url, x1, y1, x2, y2)`` that lie on it.

    A link lies on the last item, by ``pos``, that its rectangle meets. Items
    and rectangles meet by page and by bands of height, so they are compared
    with their neighbours only. ``pos`` is unique in a page; null or empty
    addresses and null places meet nothing.
    """
    bands = lambda low, high: F.explode(F.sequence(F.floor(low / band), F.floor(high / band))).alias("band")
    y, top = F.col("y"), F.col("y") + F.col("height")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    boxes = items.select("doc", "page", "pos", "x", (F.col("x") + F.col("width")).alias("edge"), "y", top.alias("top"), bands(y, top))
    rects = links.where("url <> ''").select("doc", "page", "nr", "url", F.least("x1", "x2").alias("left"), F.greatest("x1", "x2").alias("right"), low.alias("low"), high.alias("high"), bands(low, high))
    met = boxes.join(rects, ["doc", "page", "band"]).where("x <= right and edge >= left and y <= high and top >= low")
    last = met.groupBy("doc", "page", "nr", "url").agg(F.max("pos").alias("pos"))
    added = last.groupBy("doc", "page", "pos").agg(F.array_sort(F.collect_list(F.struct("nr", "url"))).alias("__links"))
    text = F.concat("text", *[F.coalesce(F.array_join(F.transform("__links", lambda u: F.concat(F.lit(" ("), u["url"], F.lit(")"))), ""), F.lit(""))])
    return items.join(added, ["doc", "page", "pos"], "left").withColumn("text", text).select(*items.columns)


def like_table_row(line: Column) -> Column:
    """Whether a line has two wide gaps, or one and a separator."""
    gaps = F.regexp_count(line, F.lit(r"\s{3,}"))
    return (gaps >= 2) | (line.rlike("[|•·]") & (gaps >= 1))


# fixed values: generic names, and parts of the names of symbol and standard fonts
GENERIC_FONTS = ("sans-serif", "serif", "monospace")
SYMBOL_FONTS = ("symbol", "zapfdingbats", "dingbats", "wingdings", "mt extra", "cmmi", "cmsy", "cmex", "cmr")
STANDARD_FONTS = (
    "arial", "helvetica", "times", "courier", "calibri", "cambria", "georgia", "garamond",
    "verdana", "tahoma", "trebuchet", "liberation", "dejavu", "roboto", "lato", "open sans",
    "source sans", "noto", "pt sans", "franklin", "book antiqua", "palatino", "consolas",
    "menlo", "monaco", "segoe", "ubuntu", "futura", "gill sans", "arial narrow", "carlito",
)


def font_kind(name: Column) -> Column:
    """``symbol``, ``safe`` (standard or an embedded subset) or ``unembedded``; null for null, blank and generic names."""
    given = F.trim(name)
    holds = lambda words: given.rlike("(?i)" + "|".join(words))
    kind = F.when(holds(SYMBOL_FONTS), "symbol").when(given.rlike(r"^[A-Z]{6}\+") | holds(STANDARD_FONTS), "safe").otherwise("unembedded")
    return F.when((given != "") & ~given.isin(*GENERIC_FONTS), kind)


def otsu(histogram: DataFrame, key: str) -> DataFrame:
    """``(key, threshold)`` from ``(key, bin, n)``: the smallest bin with the greatest variance between classes. At most 256 bins a key."""
    upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    h = histogram.withColumn("w", F.sum("n").over(upto)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(upto))
    h = h.withColumn("total", F.sum("n").over(whole)).withColumn("moment", F.sum(F.col("n") * F.col("bin")).over(whole))
    below, above = F.col("m") / F.col("w"), (F.col("moment") - F.col("m")) / (F.col("total") - F.col("w"))
    h = h.where("total > w").withColumn("between", F.round(F.col("w") * (F.col("total") - F.col("w")) * (below - above) * (below - above), 4))
    return h.groupBy(key).agg(F.max_by("bin", F.struct(F.col("between"), -F.col("bin"))).alias("threshold"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey value of a pixel, rounded."""
    return F.round(0.299 * red + 0.587 * green + 0.114 * blue).cast("int")
