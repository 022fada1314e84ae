"""Token alignment against plain loops over tokens and sets."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from dossierflow.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(held):
    """Rows by doc, from tokenizers called text by text, with sets of ends and loops over groups."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    t, s = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    docs, linked = [], Counter()
    for doc, text in held:
        rows, links = [], Counter()
        if text:
            raw = (" " + text).encode()
            a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, s.id_to_piece(i)) for i in s.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                ends = []
                for tokens in (a, b):
                    at, own = 0, []
                    for i, x in tokens:
                        at += len(x)
                        own.append((i, at))
                    ends.append(own)
                cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
                own_a, own_b = (iter(e) for e in ends)
                for cut in cuts:
                    group = ([], [])
                    for side, tokens in zip(group, (own_a, own_b), strict=True):
                        for i, e in tokens:
                            side.append(i)
                            if e == cut:
                                break
                    rows.append(group)
                    times_a, times_b = Counter(group[0]), Counter(group[1])
                    for x, n in times_a.items():
                        for y, m in times_b.items():
                            links[x, y] += n * m
        linked.update(links.keys())
        docs.append((doc, rows, links))
    best = Counter()
    for (x, _), n in linked.items():
        best[x] = max(best[x], n)
    out = []
    for doc, rows, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in rows)
        out.append(
            (doc, sum(len(x) for x, _ in rows), sum(len(y) for _, y in rows), len(rows), sum(links.values()), sum(n for p, n in links.items() if linked[p] == best[p[0]]), sum(n * linked[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if rows else "")
        )
    return out, linked, best


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["docs", "sample"])
def test_alignment_equals_loops(request, name):
    table = request.getfixturevalue(name)
    want, linked, best = plain([(r["doc_id"], r["text"]) for r in table.collect()])
    got, pairs = alignment.align(table)
    assert got.columns == COLUMNS
    assert in_order(got.collect()) == in_order(want)
    assert in_order(pairs.collect()) == in_order((x, y, n, n == best[x]) for (x, y), n in linked.items())


def test_small_blocks_give_the_same_rows(spark, docs, monkeypatch):
    whole = in_order(alignment.align(docs)[0].collect())
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    assert in_order(alignment.align(docs)[0].collect()) == whole


def test_odd_rows(spark):
    texts = [(None, "a b"), (1, None), (1, ""), (2, "a b"), (2, "a b"), (3, "a▁b"), (4, "� \x00\x01 <s></s><unk><0x41><|endoftext|>"), (5, " " * 70), (6, "  lead and trail  \n\n"), (7, "\U0001f600é日本語" * 50)]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: queries.F.lit(9) for c in ("block", "place", "id", "pair", "docs")})
    got = alignment.align(table)[0].collect()
    want, _, _ = plain(texts)
    assert in_order(got) == in_order(want)
    assert {r["groups_sha256"] for r in got if r["doc_id"] in (1, 3)} == {""}


def test_empty_table(spark):
    got, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and pairs.collect() == []


def test_long_groups_are_counted_before_they_are_expanded():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 3000), rng.integers(0, 30, 2500)
    of_a, of_b = np.sort(np.append(rng.integers(0, 6, 2994), np.arange(6))), np.sort(np.append(rng.integers(0, 6, 2494), np.arange(6)))
    want = Counter((int(x), int(y)) for g in range(6) for x in a[of_a == g] for y in b[of_b == g])
    for at_once in (7, 500, 10**9):
        pairs, times = alignment.links(a, b, of_a, of_b, 6, at_once)
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times, strict=True)} == want


def test_query(spark):
    got = queries.op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_groups_and_pairs_equal_plain_versions():
    """Ends marked by place against sets, links against all pairs of a group, and places of pairs over several documents."""
    draw, block, docs, place = np.random.default_rng(3), alignment._Block(0), {}, {}
    for _ in range(50):
        size = int(draw.integers(1, 60))
        cut = lambda: np.diff([0, *sorted(set(draw.integers(1, size, 20).tolist()) if size > 1 else ()), size])
        with_both = alignment.Aligner.__new__(alignment.Aligner)
        with_both.length_a = with_both.length_b = np.arange(size + 1)
        a, b = cut(), cut()  # an id is its token's length
        of_a, of_b, n = with_both.groups(a, b)
        ends = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
        assert n == len(ends)
        assert of_a.tolist() == [sum(e < x for e in ends) for x in np.cumsum(a)] and of_b.tolist() == [sum(e < x for e in ends) for x in np.cumsum(b)]
        want = {}
        for x, g in zip(a.tolist(), of_a.tolist(), strict=True):
            for y, h in zip(b.tolist(), of_b.tolist(), strict=True):
                if g == h:
                    want[x << 32 | y] = want.get(x << 32 | y, 0) + 1
        pairs, times = alignment.links(a, b, of_a, of_b, n)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want and pairs.tolist() == sorted(want)
        for pair, at in zip(pairs.tolist(), block.add(pairs).tolist(), strict=True):
            assert place.setdefault(pair, len(place)) == at
            docs[pair] = docs.get(pair, 0) + 1
    lists = block.frame()
    assert {p: (at, d) for p, at, d in zip(lists["pair"], lists["place"], lists["docs"], strict=True)} == {p: (at, docs[p]) for p, at in place.items()}
