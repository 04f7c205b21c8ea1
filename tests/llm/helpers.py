"""Small documents with the cases every operator must define: null, empty, very long, repeated, ties."""

import random

WORDS = "the of and to in stone river quiet lantern amber field winter copper meadow harbor signal".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def documents(spark, extra=()):
    draw = random.Random(3)
    base = [sentence(draw, n) for n in (3, 12, 40, 80, 120, 200)]
    texts = [*base, base[3], base[4] + " tail", None, "", "   ", "é🙂 Äpfel", "x" * 50_000, sentence(draw, 6000), *extra]
    rows = [(i, t, "en", "src0", len(t or ""), 1.5) for i, t in enumerate(texts)]
    rows += [rows[1], (None, base[2], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
