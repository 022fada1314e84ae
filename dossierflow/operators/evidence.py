"""Terms found in texts by a positional token index, staged matching over texts, and evidence for what matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.text import normal_for_grounding, normal_skill, to_sentence
from ..sources.shared import kept
from .matching import alias_index

TOKEN = r"[\p{L}\p{N}]+"
JOINT = "\x1f"  # between the tokens of a key; no token holds it
MENTIONED = 0.6  # fixed values: the share of a credit that a mention without evidence keeps, and the credits
EXACT, STRONG_RELATED = 1.0, 0.85
WEAK_BELOW = 0.72
AT_HAND = 200_000  # rows of a dictionary that tasks hold; a larger one is shuffled
IN_PLAN = 2_000  # terms of an index whose first tokens the plan itself holds, to pass over tokens that begin no term
#: What a row says of a document: an item asked for, listed, used, similar to something or to a bullet; a term shown in a bullet or held by the text.
ASKED, LISTED, TOOL, SIMILAR, OF_BULLET, SHOWN, IN_TEXT = range(7)
#: Where evidence is looked for, in this order.
ORIGINS = ("experience", "project", "summary", "achievement", "certification")


def _tokens(text: Column) -> tuple[Column, Column]:
    """Lower-cased tokens, and what stands before, between and behind them."""
    low = F.lower(text)
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), F.split(low, TOKEN)


def term_index(terms: DataFrame, term: str) -> DataFrame:
    """``(term, n, gram, lead, between, trail)`` for each distinct term of two characters at least that holds a letter or digit."""
    own = terms.select(F.trim(term).alias("term")).where(F.length("term") >= 2).distinct()
    tokens, gaps = _tokens(F.col("term"))
    own = own.select("term", tokens.alias("tokens"), gaps.alias("gaps")).withColumn("n", F.size("tokens")).where("n > 0")
    return own.select("term", "n", F.array_join("tokens", JOINT).alias("gram"), F.get("gaps", F.lit(0)).alias("lead"), F.slice("gaps", F.lit(2), F.col("n") - 1).alias("between"), F.element_at("gaps", -1).alias("trail"))


def _same_gap(asked: Column, given: Column) -> Column:
    """Blanks of a term stand for blanks and hyphens, all else for itself."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(asked, r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"[\\s\\-]+"), F.lit("$"))
    return F.when(~asked.rlike(r"\s"), asked == given).when(asked.rlike(r"^\s+$"), given.rlike(r"^[\s\-]+$")).otherwise(F.call_function("regexp_like", given, pattern))


def at_hand(dictionary: DataFrame) -> DataFrame:
    """The dictionary, broadcast by the joins that it takes part in if it has at most ``AT_HAND`` rows."""
    return F.broadcast(dictionary) if dictionary.count() <= AT_HAND else dictionary


def _places(lines: DataFrame, keys: list[str], text: str, index: DataFrame, first: bool) -> DataFrame:
    """``(*keys, term, at)``: each place where a row holds a term. Unless the ``first`` ones are wanted, plain words give one row, wherever they stand."""
    sizes = index.groupBy("n").agg(F.count("*").alias("terms"), F.every((F.col("lead") == "") & (F.col("trail") == "")).alias("plain")).collect()  # a few small numbers
    tokens, gaps = _tokens(F.col(text))
    if not sizes:
        return lines.select(*keys, F.lit("").alias("term"), F.lit(0).alias("at")).where(F.lit(False))
    terms = sum(r["terms"] for r in sizes)
    if terms <= AT_HAND:
        index = F.broadcast(index)
    most, plain = max(r["n"] for r in sizes), all(r["plain"] for r in sizes)
    once = not first and all(r["plain"] for r in sizes if r["n"] == 1)
    # one row for each token, beside it those that follow, as many as the longest term has, and what stands between and around them
    around = range(1, most) if plain else range(most + 2)
    shifted = lambda c, i: F.col(c) if i == 0 else F.slice(c, F.lit(i + 1), F.size(c))
    arrays = {f"__t{i}": shifted("__t", i) for i in range(most)} | {f"__g{i}": shifted("__g", i) for i in around} | ({"__word": F.array_distinct("__t")} if once else {})
    rows = lines.select(*keys, tokens.alias("__t"), gaps.alias("__g")).select(*keys, *[c.alias(n) for n, c in arrays.items()])
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("at", "__k")).select(*keys, "at", "__k.*")
    gram = lambda n: F.col("__word" if once else "__t0") if n == 1 else F.concat(*[c for i in range(n) for c in (F.lit(JOINT), F.col(f"__t{i}"))][1:])
    if terms <= IN_PLAN:
        heads = [(r["head"], r["one"]) for r in index.select(F.substring_index("gram", JOINT, 1).alias("head"), (F.col("n") == 1).alias("one")).distinct().collect()]
        begins = lambda c, *ones: F.col(c).isin([h for h, one in heads if one in ones])
        rows = rows.where(begins("__word", True) | begins("__t0", False) if once else begins("__t0", True, False))
    found = rows.select("*", F.explode(F.array(*[gram(r["n"]) for r in sizes])).alias("gram")).join(index, "gram")
    given = F.array(*[F.col(f"__g{i}") if i in around else F.lit("") for i in range(most + 2)])
    before, behind, ends = F.get(given, F.lit(0)), F.get(given, F.col("n")), F.get(given, F.col("n") + 1).isNull()
    left = (F.col("lead") == "") | (F.endswith(before, F.col("lead")) & ((F.length(before) > F.length("lead")) | (F.col("at") == 0)))
    right = (F.col("trail") == "") | (F.startswith(behind, F.col("trail")) & ((F.length(behind) > F.length("trail")) | ends))
    inner = (F.col("n") == 1) | F.forall(F.zip_with("between", F.slice(given, F.lit(2), F.col("n") - 1), _same_gap), lambda same: same)
    return found.where(left & right & inner).select(*keys, "term", "at")


def term_hits(lines: DataFrame, keys: list[str], text: str, index: DataFrame) -> DataFrame:
    """``(*keys, term, at)``: the terms that each row holds as whole terms, case aside, and the token where each one starts first.

    Rows become keys of one token or more, as many as the terms have, which
    meet the terms in an equi-join; what stands between and around the tokens
    is compared afterwards. So the work follows the length of the texts, not
    that times the number of terms. An index of at most ``AT_HAND`` terms is
    broadcast, so that hits alone are shuffled. Null texts hold nothing.
    """
    return _places(lines, keys, text, index, True).groupBy(*keys, "term").agg(F.min("at").alias("at"))


def search_terms(items: DataFrame, item: str, entities: DataFrame) -> DataFrame:
    """``(item, canonical, known, term)``: all names of the entity that an item names; an item without one stands for itself.

    ``entities (pos, canonical, aliases, parents)``; where names collide the
    first entity has them.
    """
    index = alias_index(entities, "canonical", "aliases", "pos").withColumnRenamed("canonical", "found")
    names = entities.groupBy("canonical").agg(F.min_by("aliases", "pos").alias("aliases")).withColumnRenamed("canonical", "found")
    own = items.select(F.col(item).alias("item")).distinct().withColumn("norm", normal_skill(F.col("item")))
    own = own.join(index, "norm", "left").join(names, "found", "left")
    terms = F.when(F.col("found").isNull(), F.array(F.trim("item"))).otherwise(F.array_distinct(F.concat(F.array("found"), "aliases")))
    return own.select("item", F.coalesce("found", F.trim("item")).alias("canonical"), F.col("found").isNotNull().alias("known"), F.explode(terms).alias("term")).where("term <> ''")


def _relations(entities: DataFrame) -> DataFrame:
    """``(a, b)``: canonical names that are the same, parent and child, or children of one parent that is an entity itself; names of parents count by their normal form."""
    same = entities.select(F.col("canonical").alias("a"), F.col("canonical").alias("b"))
    edges = entities.select(F.col("canonical").alias("a"), F.explode("parents").alias("parent")).select("a", normal_skill(F.col("parent")).alias("norm")).where("norm <> ''").distinct()
    up = edges.join(entities.select(F.col("canonical").alias("b"), normal_skill(F.col("canonical")).alias("norm")), "norm").select("a", "b")
    shared = edges.join(alias_index(entities, "canonical", "aliases", "pos"), "norm", "left_semi")
    siblings = shared.join(shared.withColumnRenamed("a", "b"), "norm").select("a", "b")
    return same.unionByName(up).unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(siblings).distinct()


def match_texts(required: DataFrame, listed: DataFrame, tools: DataFrame, bullets: DataFrame, texts: DataFrame, entities: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """``(key, item, source, canonical, related, category, credit, similarity, evidence)``: the first stage that succeeds decides.

    ``required (key, item, source)``, of repeated items the smallest source
    counts; ``listed`` and ``tools (key, pos, item)``; ``bullets (key, pos,
    text)``; ``texts (key, text)``; ``similar (key, item, similarity,
    of_bullet)``, the last telling what it was compared with.

    1. EXACT: listed or used under the same normal form, or a name of it is in the text.
    2. STRONG_RELATED: something related is listed or used, or the item is another name of an entity.
    3. PARTIAL: by the similarity's band; a weak one without evidence earns nothing.
    4. MISSING_REQ, or MISSING_PREF for preferred items.

    In the first two, what no bullet shows and no tool is, is
    MENTIONED_WITHOUT_EVIDENCE at a reduced credit. ``evidence`` counts the
    bullets that show the item, in the second stage what is related to it.
    Texts are read once, and what is known of a document is shuffled once, by
    its key: groups and windows of its items and names follow within it.
    """
    every = required.select("item").unionByName(listed.select("item")).unionByName(tools.select("item")).distinct()
    names = kept(search_terms(every, "item", entities), "names")
    # items with the same names are one group of names; where an item's own spelling is none of them, it is a group by itself
    of = names.groupBy("item", "canonical", "known").agg(F.max(F.trim("term") == F.trim("item")).alias("usual")).withColumn("norm", normal_skill(F.col("item")))
    of = of.withColumn("group", F.when(F.col("usual"), F.concat(F.when(F.col("known"), "e").otherwise("u"), "canonical")).otherwise(F.concat(F.lit("i"), "item")))
    spelt = names.select("item", F.trim("term").alias("term")).join(at_hand(of.select("item", "group")), "item").select("group", "term", F.lit(True).alias("named")).distinct()
    spelt = spelt.unionByName(of.where("not usual").select("group", F.trim("item").alias("term"), F.lit(False).alias("named")))
    index = term_index(spelt, "term")

    kind = lambda k: F.lit(k).cast("byte").alias("kind")
    name = F.col("item").alias("name")
    held = [df.select(key, kind(k), name, "pos") for k, df in ((LISTED, listed), (TOOL, tools))]
    alike = similar.where("item is not null").select(key, F.when(F.col("of_bullet"), kind(OF_BULLET)).otherwise(kind(SIMILAR)).alias("kind"), name, "similarity")
    shown = _places(bullets, [key, "pos"], "text", index, False).select(key, kind(SHOWN), F.col("term").alias("name"), "pos")
    in_text = _places(texts, [key], "text", index, False).select(key, kind(IN_TEXT), F.col("term").alias("name"))
    together = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    rows = reduce(together, [df.where(F.col(key).isNotNull()) for df in (*held, alike, shown, in_text)], required.select(key, kind(ASKED), name, "source")).repartition(key)

    # one row for each document and item or group of names, which the terms stand for
    found, is_ = F.col("kind") >= SHOWN, lambda k: F.col("kind") == k
    rows = rows.join(at_hand(spelt), found & (F.col("name") == F.col("term")), "left").withColumns({"found": found, "what": F.when(found, F.col("group")).otherwise(F.col("name")), "at": F.when(is_(SHOWN), F.col("pos").cast("long"))})
    told = {
        "asked": F.max(is_(ASKED)), "listed": F.min(F.when(is_(LISTED), F.col("pos"))), "tool": F.min(F.when(is_(TOOL), F.col("pos"))), "in_text": F.max(is_(IN_TEXT) & F.col("named")),
        "similarity": F.max("similarity"), "bullet": F.max(F.when(is_(OF_BULLET), F.col("similarity"))),
    }
    # which of 64 bullets show it is a bit each, so that one turn of groups is enough for most documents
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")))
    rows = rows.groupBy(key, "found", "what", "source", F.shiftright("at", 6).alias("block")).agg(*[c.alias(n) for n, c in told.items()], bits.alias("bits"))
    again = [(F.min if c in ("listed", "tool") else F.max)(c).alias(c) for c in told]
    rows = rows.groupBy(key, "found", "what").agg(*again, F.sum(F.bit_count("bits")).alias("shown"), F.min("source").alias("source"))

    rows = rows.withColumn("item", F.when(~F.col("found"), F.col("what"))).join(at_hand(of), "item", "left").withColumn("group", F.coalesce("group", F.when(F.col("found"), F.col("what"))))
    called = Window.partitionBy(key, "group")
    rows = rows.withColumns({c: F.max(F.when(F.col("found"), F.col(c))).over(called) for c in ("shown", "in_text")}).where("not found and (asked or listed is not null or tool is not null)")
    same = Window.partitionBy(key, "norm")
    rows = rows.withColumns({"is_listed": (F.col("norm") != "") & F.max(F.col("listed").isNotNull()).over(same), "is_tool": (F.col("norm") != "") & F.max(F.col("tool").isNotNull()).over(same)})

    # what is listed or used also stands beside what it is related to
    kin = _relations(entities).groupBy(F.col("a").alias("canonical")).agg(F.collect_list("b").alias("kin"))  # an entity's relations
    beside = lambda own, c: F.struct(F.lit(own).alias("own"), c.alias("beside"))
    holds = F.col("known") & (F.col("listed").isNotNull() | F.col("tool").isNotNull())
    others = F.transform(F.when(holds, F.col("kin")), lambda c: beside(False, c))
    rows = rows.join(at_hand(kin), "canonical", "left").select("*", F.inline(F.concat(F.array(beside(True, F.col("canonical"))), F.coalesce(others, F.array())))).drop("kin")
    near = Window.partitionBy(key, "beside")
    first = lambda c: F.min(F.when(~F.col("own") & F.col(c).isNotNull(), F.struct(c, "item", "shown"))).over(near)
    rows = rows.withColumns({"kin_listed": first("listed"), "kin_tool": first("tool")}).where("own and asked")
    first_kin = F.when(F.col("known"), F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c)["item"].alias("item"), F.col(c)["shown"].alias("shown"))) for c in ("kin_listed", "kin_tool")]))
    rows = rows.withColumns({"related": first_kin["item"], "kin_shown": first_kin["shown"]})

    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    own, kin_own = F.coalesce("shown", F.lit(0)), F.when(F.col("related").isNull(), F.coalesce("shown", F.lit(0))).otherwise(F.coalesce("kin_shown", F.lit(0)))
    exact = truth("is_listed") | truth("is_tool") | truth("in_text")
    strong = F.col("related").isNotNull() | (F.col("canonical") != F.trim("item"))
    # what is used counts as evidence only where nothing listed came first
    tool_kin = truth("known") & F.col("kin_tool").isNotNull()
    stage = F.when(exact, 0).when(strong, 1).when(numeric.credit(F.coalesce("similarity", F.lit(0.0))) > 0, 2).otherwise(3)
    rows = rows.withColumns({"stage": stage, "evidence": F.when(exact, own).when(strong, kin_own).otherwise(own)})
    bare = F.when(F.col("stage") == 0, (own == 0) & ~truth("is_tool")).when(F.col("stage") == 1, (kin_own == 0) & ~tool_kin).otherwise(False)
    full = F.when(F.col("stage") == 0, EXACT).when(F.col("stage") == 1, STRONG_RELATED)
    weak = (F.col("similarity") < WEAK_BELOW) & (own == 0) & (numeric.credit(F.coalesce("bullet", F.lit(0.0))) == 0)
    value = F.when(F.col("stage") < 2, F.round(F.when(bare, full * MENTIONED).otherwise(full), 3)).when((F.col("stage") == 2) & ~weak, numeric.credit(F.col("similarity"))).otherwise(0.0)
    category = F.when(bare, "MENTIONED_WITHOUT_EVIDENCE").when(F.col("stage") == 0, "EXACT").when(F.col("stage") == 1, "STRONG_RELATED").when(F.col("stage") == 2, "PARTIAL").when(F.col("source") == "preferred", "MISSING_PREF").otherwise("MISSING_REQ")
    return rows.select(key, "item", "source", "canonical", F.when(F.col("stage") == 1, F.col("related")).alias("related"), category.alias("category"), value.alias("credit"), F.when(F.col("stage") >= 2, F.round("similarity", 3)).alias("similarity"), "evidence")


def not_relevant(held: DataFrame, asked: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """``held (key, item)`` without what ``asked (key, item)`` names, by normal form, canonical name or relation: one anti join over expanded keys."""
    of = search_terms(held.select("item").unionByName(asked.select("item")), "item", entities).select("item", "canonical", "known").distinct()
    pairs = _relations(entities)
    wanted = asked.join(of, "item")
    by_norm = wanted.select(key, F.explode(F.array(normal_skill(F.col("item")), normal_skill(F.col("canonical")))).alias("norm")).distinct()
    by_kin = wanted.where("known").select(key, F.col("canonical").alias("b")).join(pairs, "b").select(key, F.col("a").alias("canonical")).distinct()
    rows = held.join(of, "item")
    for norm in (normal_skill(F.col("item")), normal_skill(F.col("canonical"))):
        rows = rows.withColumn("norm", norm).join(by_norm, [key, "norm"], "left_anti").drop("norm")
    # an item without an entity has no relations
    return rows.where("known").join(by_kin, [key, "canonical"], "left_anti").unionByName(rows.where("not known"), allowMissingColumns=True).select(key, "item", "canonical")


def related_assets(asked: DataFrame, held: DataFrame, texts: DataFrame, entities: DataFrame, key: str, most: int = 5) -> DataFrame:
    """``(key, item, rank, asset)``: up to ``most`` things that a document has and that are related to an item: parents that its text names, then what it lists, in order."""
    of = search_terms(asked.select("item").unionByName(held.select("item")), "item", entities).where("known").select("item", "canonical").distinct()
    wanted = asked.select(key, "item").distinct().join(of, "item")
    parents = entities.groupBy("canonical").agg(F.min_by("parents", "pos").alias("parents")).select("canonical", F.posexplode("parents").alias("pos", "asset"))
    named = term_hits(texts, [key], "text", term_index(parents.select("asset"), "asset")).select(key, F.col("term").alias("asset"))
    first = wanted.join(parents, "canonical").join(named, [key, "asset"]).select(key, "item", F.struct(F.lit(0).alias("stage"), F.col("pos")).alias("place"), "asset")
    own = held.select(key, "pos", F.col("item").alias("asset"), F.trim("item").alias("__own")).join(of.withColumnRenamed("item", "asset").withColumnRenamed("canonical", "a"), "asset")
    second = wanted.select(key, "item", F.col("canonical").alias("b")).join(_relations(entities), "b").join(own, [key, "a"]).where(F.lower("__own") != F.lower(F.trim("item")))
    second = second.select(key, "item", F.struct(F.lit(1).alias("stage"), "pos").alias("place"), F.col("__own").alias("asset"))
    places = first.unionByName(second).groupBy(key, "item", "asset").agg(F.min("place").alias("place"))
    order = Window.partitionBy(key, "item").orderBy("place", "asset")
    return places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "item", "rank", "asset")


def provenance(docs: DataFrame, key: str) -> DataFrame:
    """``(key, place, origin, company, title, text, snippet)``: every statement of a nested document, one row each, in the order that evidence is looked for.

    Of ``experience`` each role's bullets, then its technologies; of
    ``projects`` bullets, description, technologies; ``summary``,
    ``achievements``, ``certifications``. ``place`` compares in that order.
    Missing lists give no rows.
    """
    none = F.lit(None).cast("string")

    def rows(stage: int, list_of: Column, parts) -> Column:
        """Of each owner its statements: (kind, statements, snippet of each)."""
        return F.flatten(F.transform(F.coalesce(list_of, F.array()), lambda owner, i: F.flatten(F.array(*[_statements(stage, i, kind, texts, snippet, company, title) for kind, texts, snippet, company, title in parts(owner)]))))

    def listed(where: str, owner) -> Column:
        return lambda t: F.concat(t, F.lit(where), owner)

    def job(j: Column) -> list:
        at = F.concat(F.coalesce(j["title"], F.lit("")), F.lit(" at "), F.coalesce(j["company"], F.lit("")))
        return [(0, j["bullet_points"], to_sentence, j["company"], j["title"]), (1, j["technologies_used"], listed(" — listed under ", at), j["company"], j["title"])]

    def project(p: Column) -> list:
        return [(0, p["bullet_points"], to_sentence, none, p["title"]), (1, F.array(p["description"]), to_sentence, none, p["title"]), (2, p["technologies_used"], listed(" — listed under the project ", F.coalesce(p["title"], F.lit(""))), none, p["title"])]

    plain = lambda texts, snippet=to_sentence: (lambda _: [(0, texts, snippet, none, none)])
    one = F.array(F.lit(0))
    certs = F.coalesce("certifications", F.array().cast(docs.schema["certifications"].dataType))
    issued = F.transform(certs, lambda c: F.concat_ws(" — ", c["name"], F.nullif(c["issuer"], F.lit(""))))
    parts = [rows(0, F.col("experience"), job), rows(1, F.col("projects"), project), rows(2, one, plain(F.array("summary"))), rows(3, one, plain(F.col("achievements")))]
    cert_rows = F.transform(certs, lambda c, i: F.struct(F.struct(F.lit(4).alias("stage"), F.lit(0).alias("owner"), F.lit(0).alias("kind"), i.cast("int").alias("pos")).alias("place"), F.lit(ORIGINS[4]).alias("origin"), none.alias("company"), none.alias("title"), c["name"].alias("text"), F.get(issued, i).alias("snippet")))
    return docs.select(key, F.inline(F.concat(*parts, cert_rows))).where("trim(coalesce(text, '')) <> ''")


def _statements(stage: int, owner: Column, kind: int, texts: Column, snippet, company: Column, title: Column) -> Column:
    place = lambda pos: F.struct(F.lit(stage).alias("stage"), owner.cast("int").alias("owner"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"))
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, pos: F.struct(place(pos).alias("place"), F.lit(ORIGINS[stage]).alias("origin"), company.alias("company"), title.alias("title"), t.alias("text"), snippet(t).alias("snippet")))


def skill_evidence(statements: DataFrame, asked: DataFrame, entities: DataFrame, key: str, most: int = 2) -> DataFrame:
    """``(key, item, rank, origin, company, title, snippet)``: the first ``most`` statements, in the order of :func:`provenance`, that hold a name of each item of ``asked (key, item)`` in normal spelling."""
    names = search_terms(asked, "item", entities).select("item", normal_for_grounding(F.col("term")).alias("needle")).where("needle <> ''").groupBy("item").agg(F.collect_set("needle").alias("needles"))  # an entity's names
    wanted = asked.select(key, "item").distinct().join(names, "item")
    said = statements.withColumn("__norm", normal_for_grounding(F.col("text")))
    hits = said.join(wanted, key).where(F.exists("needles", lambda n: F.contains(F.col("__norm"), n)))
    order = Window.partitionBy(key, "item").orderBy("place")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "item", "rank", "origin", "company", "title", "snippet")


def summary_of_unmet(checks: DataFrame, key: str, pos: str, requirement: str, verified: str) -> DataFrame:
    """``(key, unmet, summary)``: one sentence on the requirements that could not be verified, in order."""
    rows = checks.groupBy(key).agg(F.sort_array(F.collect_list(F.when(~F.col(verified), F.struct(pos, requirement)))).alias("open"))  # a document's requirements
    n = F.size("open")
    text = F.concat(n.cast("string"), F.lit(" non-negotiable requirement(s) could not be verified: "), F.array_join(F.transform("open", lambda r: r[requirement]), "; "), F.lit("."))
    return rows.select(key, n.alias("unmet"), F.when(n == 0, "All stated non-negotiable requirements were found in your document.").otherwise(text).alias("summary"))

