"""Alignment of whole versions, against a plain version that tests all pairs."""

import collections
import difflib
import random
import re
import time

from foliary.operators import compare
from foliary.plans import catalog
from tests.helpers import views


def plain_align(base, target):
    """Equal texts pair by occurrence, then each base block takes the best free target of all."""
    out, free, left = [], list(target), []
    for b in base:
        same = next((t for t in free if t[1] == b[1]), None)
        if same:
            free.remove(same)
            out.append((b[0], same[0], 1.0))
        else:
            left.append(b)
    for b in left:
        best, x = None, set(re.findall(r"\w+(?:[-']\w+)?", b[1].casefold()))
        for t in free:
            y = set(re.findall(r"\w+(?:[-']\w+)?", t[1].casefold()))
            shared = len(x & y) / min(len(x), len(y)) if x and y else 0.0
            ratio = round(difflib.SequenceMatcher(None, b[1], t[1]).ratio(), 6)
            if shared >= compare.OVERLAP and ratio >= compare.SIMILAR and (best is None or (ratio, shared, -t[0]) > best[0]):
                best = (ratio, shared, -t[0]), t
        if best:
            free.remove(best[1])
        out.append((b[0], best[1][0] if best else None, best[0][0] if best else None))
    return sorted(out + [(None, t[0], None) for t in free], key=repr)


def test_align_is_as_by_all_pairs(spark):
    draw, known = random.Random(2), "The the river; stone Äpfel straße don't amber-field 42 of copper quiet winter lantern".split()
    rows = {"A": [], "B": []}
    for pair in ("p", "q", "only"):
        for side in rows:
            for i in range(90 if pair != "only" else 5 * (side == "A")):
                words = [draw.choice(known) for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 30, 60]))]
                rows[side].append((pair, i, draw.choice([" ".join(words)] * 6 + ["--- !!", "The river stone", "The river stones 42"])))
    side = lambda s: spark.createDataFrame([(p, i, f"{s}{i}", t) for p, i, t in rows[s]], "pair_id string, sequence_number long, source_id string, normal string")
    found = collections.defaultdict(list)
    for r in compare.align(side("A"), side("B")).collect():
        found[r.pair_id].append(tuple(x and int(x[1:]) for x in (r.base_id, r.target_id)) + (r.similarity,))
    for pair in ("p", "q", "only"):
        expected = plain_align(*([(i, t) for p, i, t in rows[s] if p == pair] for s in "AB"))
        assert sorted(found[pair], key=repr) == expected
        assert pair == "only" or sum(s is not None and s < 1 for *_, s in expected) > 10


def test_query_aligns_every_line(spark, sf_dir):
    lines = views(sf_dir).sql("SELECT source, count(*) FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source").fetchall()
    got = {r.pair_id: r.added + r.removed + 2 * (r.modified + r.unchanged) for r in catalog.queries()["align_text"](spark, sf_dir).collect()}
    assert got == dict(lines)


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    time.sleep(1)
    all_of = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(all_of.apply(i).totalShuffleWrite() for i in range(all_of.size()))


def test_texts_that_share_words_are_not_shuffled_pair_by_pair(spark):
    """Twice the lines, nearly all pairs of which share rare words, move about twice the bytes, not four times."""
    draw = random.Random(5)
    known = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=25)) for _ in range(40)]
    moved = []
    for n in (300, 600):
        side = lambda s, n=n: spark.createDataFrame([("p", i, f"{s}{i}", " ".join(draw.sample(known, 10))) for i in range(n)], "pair_id string, sequence_number long, source_id string, normal string")
        before = shuffled(spark)
        assert compare.align(side("A"), side("B")).count() >= n
        moved.append(shuffled(spark) - before)
    assert moved[1] < 3 * moved[0] and moved[1] < 2_000_000, moved


def test_blocks_of_both_sides_meet(spark, monkeypatch):
    """With blocks of few characters, and with one block, the pairs are those of all texts."""
    draw, known = random.Random(9), "the river stone amber field copper quiet winter lantern 42".split()
    rows = {s: [("p", i, f"{s}{i}", " ".join(draw.choices(known, k=draw.choice([2, 5, 9])))) for i in range(70)] for s in "AB"}
    rows["A"] += [("q", 0, "A0", "one two three")]
    rows["B"] += [("q", 0, "B0", "four five six"), ("r", 0, "B0", "alone")]
    side = lambda s: spark.createDataFrame(rows[s], "pair_id string, sequence_number long, source_id string, normal string")
    expected = plain_align(*([(i, t) for p, i, _, t in rows[s] if p == "p"] for s in "AB"))
    for chars in (200, 1 << 20):
        monkeypatch.setattr(compare, "BLOCK_CHARS", chars)
        found = compare.align(side("A"), side("B")).collect()
        got = [tuple(x and int(x[1:]) for x in (r.base_id, r.target_id)) + (r.similarity,) for r in found if r.pair_id == "p"]
        assert sorted(got, key=repr) == expected
        assert sorted(((r.pair_id, r.base_id, r.target_id) for r in found if r.pair_id != "p"), key=repr) == [("q", "A0", None), ("q", None, "B0"), ("r", None, "B0")]


def test_pieces_of_postings_give_the_same(monkeypatch):
    draw = random.Random(3)
    texts = lambda: [" ".join(draw.choices("a b c d e f g h i j".split(), k=draw.randint(0, 12))) for _ in range(60)]
    base, target = texts(), texts()
    whole = sorted(compare.similar_texts(base, target))
    words = lambda x: set(compare._WORD.findall(x))
    plain = [(i, j) for i, x in enumerate(base) for j, y in enumerate(target) if words(x) and words(y) and len(words(x) & words(y)) / min(len(words(x)), len(words(y))) >= compare.OVERLAP and round(difflib.SequenceMatcher(None, x, y).ratio(), 6) >= compare.SIMILAR]
    assert [w[:2] for w in whole] == plain and len(plain) > 100
    monkeypatch.setattr(compare, "TOGETHER", 7)
    assert sorted(compare.similar_texts(base, target)) == whole
