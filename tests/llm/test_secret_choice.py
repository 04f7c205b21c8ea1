"""Which of the overlapping candidates are reported, against plain code that lists every part of every run."""

import random
import re

from foliary.llm import secrets

DRAW = random.Random(3)
SOME = lambda letters, a, b: "".join(DRAW.choices(letters, k=DRAW.randint(a, b)))
LABELLED = [
    *(("dashed", "k" + SOME("ab-", 20, 30) + "a") for _ in range(150)),
    *(("dotted", "p." + SOME("0123", 8, 12) + "." + SOME("0123", 8, 30)) for _ in range(150)),
    *(("mixed", "c" + SOME("gggghhhhjkc-xz", 34, 50) + "a") for _ in range(150)),
    *(("strong", "zz" + SOME("xz", 20, 26)) for _ in range(150)),
    *((secrets.ORDINARY, "-".join(SOME("abcdefghijk", 2, 6) for _ in range(DRAW.randint(2, 4)))) for _ in range(300)),
]


def plain_parts(text: bytes, automata: secrets.Automata):
    """(margin, start, end, kind) of every part that fits, and of whole runs."""
    n, out = len(automata.kinds), []
    typical = [automata.typical[k] for k in automata.kinds]
    for run in re.finditer(rb"[A-Za-z0-9+/_.=-]+", text):
        lo, hi = secrets._trimmed(text, *run.span())
        if hi - lo < automata.least:
            continue
        verdict = automata.verdicts([text[lo:hi]])[0]
        if verdict:
            out.append((verdict[1], lo, hi, verdict[0]))
        for a in range(lo, hi):
            if a > lo and (text[a - 1] not in b"+/_.=-" or text[a] in b".-/="):
                continue
            state, total = list(automata.start), [0.0] * (n + 1)
            for b in range(a + 1, hi + 1):
                for j in range(n + 1):
                    total[j] += float(automata.log[state[j], text[b - 1]])
                    state[j] = int(automata.go[state[j], text[b - 1]])
                live = [j for j in range(n) if state[j]]
                if not live:
                    break
                if b - a < automata.least or text[b - 1] in b".-/=" or (b < hi and text[b] not in b"+/_.=-"):
                    continue
                got = [t + float(automata.end[s]) for t, s in zip(total, state, strict=True)]
                for j in [max(range(n), key=got.__getitem__)] if b - a <= secrets.TOGETHER else live:
                    if got[j] / (b - a + 1) >= typical[j] and got[j] - got[n] >= secrets.MARGIN:
                        out.append((got[j] - got[n], a, b, automata.kinds[j]))
    return out


def plain_choice(text, automata):
    taken = []
    for _, a, b, kind in sorted(plain_parts(text, automata), key=lambda p: (-p[0], p[1] - p[2], p[1])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))
    return sorted(taken)


def learnt(text, automata):
    return [s[:3] for s in secrets.scan([text], automata)[0] if s[2] not in secrets.BASE]


def texts():
    draw = random.Random(8)
    some = lambda letters, k: "".join(draw.choices(letters, k=k))
    for n in [1, 2, 3, 5, 8] * 12:
        pieces = [draw.choice([draw.choice(LABELLED)[1], some("ab-", 20), "k" + some("aab", 160), "c" + some("gghhjk", 33), "zz" + some("xz", 26)]) for _ in range(n)]
        yield "".join(p + draw.choice(["-", "-", ".", "/", "_", "=", " "]) for p in pieces).encode()
    for n in [2, 4, 7] * 60:  # long parts that share what follows and lose to what comes later
        yield "-".join(draw.choice(["c" + some("gggghhhhjkc", draw.randint(20, 90)), "zz" + some("xz", draw.randint(24, 150))]) for _ in range(n)).encode()


def test_as_by_all_parts():
    automata = secrets.Automata(LABELLED)
    several = longer = 0
    for text in texts():
        expected = plain_choice(text, automata)
        assert learnt(text, automata) == expected, text
        several += len(expected) > 3
        longer += any(b - a > 4 * 32 for a, b, _ in expected)
    assert several > 10 and longer > 10


def test_part_that_a_longer_one_of_its_length_class_beats():
    """The longer part loses to its neighbour; the shorter one of the same start and class has room."""
    automata = secrets.Automata(LABELLED)
    draw, found = random.Random(1), 0
    for _ in range(20):
        first, second = "c" + "".join(draw.choices("gggghhhhjk", k=33)), "zz" + "".join(draw.choices("xz", k=26))
        text = f"{first}-{second}".encode()
        expected = plain_choice(text, automata)
        assert learnt(text, automata) == expected
        margins = {(a, b): m for m, a, b, _ in plain_parts(text, automata)}
        found += [e[:2] for e in expected] == [(0, 34), (35, 63)] and margins[0, 34] < margins.get((0, 63), 0) < margins[35, 63]
    assert found > 5


def test_part_of_any_length():
    """A part far longer than what its format was learnt from, between strings that no format goes through."""
    automata = secrets.Automata(LABELLED)
    draw = random.Random(4)
    for n in (100, 300, 900, 5000):
        value = "k" + "".join(draw.choices("ab", k=n)) + "-a"
        text = f"see Q=Z/{value}/Z9 end".encode()
        a = text.index(value.encode())
        assert (a, a + len(value), "dashed") in learnt(text, automata), n


def test_ends_in_many_blocks():
    """The best end among many blocks of ends, with and without a limit, is that of a plain search."""
    draw = random.Random(6)
    for _ in range(20):
        tail = secrets.Tail(0)
        n = draw.choice([5, 130, 900, 2000])
        tail.ends = [(2 * i, float(draw.randint(-40, 0)), float(draw.randint(-40, 0))) for i in range(n)]
        ends = tail.ends
        tail.close(-0.01)
        for _ in range(50):
            since, limit, need = draw.randint(0, 2 * n), draw.randint(0, 2 * n), draw.randint(-40, 20)
            fit = [(own - plain, p) for p, own, plain in ends if since <= p <= limit and own + 0.01 * p >= need]
            assert tail.best(since, limit, need) == max(fit, default=(float("-inf"), -1))
