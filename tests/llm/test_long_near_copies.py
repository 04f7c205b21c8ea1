"""Long texts in large groups of near copies, many of which share a passage: no link between two of them is lost."""

import random

from foliary.llm import neardup


def clusters(seed, groups, each):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    some = lambda n: [draw.choice(words) for _ in range(n)]
    common, texts = some(60), []
    for _ in range(groups):
        base = some(draw.randint(300, 700))
        for k in range(each):
            text = list(base)
            for _ in range(int(len(text) * draw.choice([0.01, 0.03, 0.05, 0.08]))):
                text[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(text[:100] + common + text[100:] if k % 3 == 0 else text))
    return texts


def test_links_of_long_texts(spark):
    texts = clusters(11, 6, 40)
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if i // 40 == j // 40 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), shingle=2).collect()}
    assert len(links) > 500 and all(found[i] == found[j] for i, j in links)
    linked = {i for pair in links for i in pair}
    assert all(found[i] == i for i in found if i not in linked)
