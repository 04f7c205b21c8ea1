"""Secret scans by grammar inference.

From labelled credentials of each format a prefix tree is built, and its states are merged as
long as the Hoeffding bound cannot tell their continuations apart (state merging with a red core
and a blue fringe).  What is left is a small probabilistic automaton for each format, and one for
ordinary strings.  Every run of credential characters in a text that is not far shorter than the
shortest credential is a candidate, and so is every part of it from a begin or a separator (``=``,
``/``, ``.`` and others) to a separator or its end, at any length; all are scored under all automata,
a part as far as some format's automaton goes.  A candidate is reported under the likeliest format
(beyond 64 characters, any) where that beats the ordinary strings by a margin and is about as likely,
for each character, as the credentials it was learnt from; of all candidates that overlap the one with
the greatest margin, then the longest, then the first, so one that loses to another makes room for those
that don't touch it.  Parts of up to 64 characters are listed, but for those that a shorter one of the
same start beats; longer parts that are in one state at one place share what follows, which is stored
once (``Tails``), so all parts are weighed without a list of them.

The three base patterns (assign, access, hex) are found exactly beside that and never dropped.  Their
values are scored as well, and a learnt span is added inside or across them unless it is just the
base span itself.  ``likelihoods`` holds for every span its likeliest format and the natural
logarithm of the likelihood, for each character.

Defined results: a null text is an empty one and has no spans; repeated rows are each scanned; texts
of any length are scanned whole; an empty table gives an empty one; offsets count code points, ends
are exclusive; a column called like a result (in any case) gives way to it.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE = ("assign", "access", "hex")

ORDINARY = "ordinary"
SHORTER = 0.6  # of the shortest labelled credential: the least length of a candidate
MARGIN = 8.0
SLACK = 1.0
TOGETHER = 64  # characters up to which all formats of a part are weighed against one another
LANES = 1 << 16
LONG = 4096
BLOCK = 128  # ends of parts that have one greatest value
GRAIN = 2.0**26  # log-likelihoods are multiples of its inverse: sums are exact in any order
ALPHA = 0.05
FLOOR = 1e-5

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_credentials(each: int = 240, seed: int = 7) -> list[tuple[str, str]]:
    """Credentials of public formats, with their format as label, and ordinary strings; drawn with a fixed seed."""
    draw = Random(seed)
    some = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    word = lambda: some(LOWER, draw.randint(2, 9))
    base62, hexa = UPPER + LOWER + DIGITS, DIGITS + "abcdef"
    url64 = base62 + "-_"
    formats = {
        "github": lambda: draw.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + some(base62, 36),
        "gitlab": lambda: "glpat-" + some(url64, 20),
        "slack": lambda: draw.choice(["xoxb-", "xoxp-"]) + some(DIGITS, 12) + "-" + some(DIGITS, 12) + "-" + some(base62, 24),
        "google": lambda: "AIza" + some(url64, 35),
        "stripe": lambda: draw.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(base62, 24),
        "npm": lambda: "npm_" + some(base62, 36),
        "sendgrid": lambda: "SG." + some(url64, 22) + "." + some(url64, 43),
        "jwt": lambda: "eyJ" + some(url64, draw.randint(17, 40)) + ".eyJ" + some(url64, draw.randint(20, 60)) + "." + some(url64, 43),
        "session_key": lambda: "ASIA" + some(UPPER + DIGITS, 16),
        "access_key": lambda: "AKIA" + some(UPPER + DIGITS, 16),
        "hex_lower": lambda: some(DIGITS + "abcdef", draw.choice([32, 40, 64])),
        "hex_upper": lambda: some(DIGITS + "ABCDEF", draw.choice([32, 40, 64])),
    }
    plain = [
        lambda: ".".join(word() for _ in range(draw.randint(2, 4))) + some(DIGITS, draw.randint(0, 3)),
        lambda: word() + str(draw.randint(1, 99)) + "." + word() + ".com",
        lambda: "-".join(word() for _ in range(draw.randint(2, 4))) + "-" + str(draw.randint(1, 2030)),
        lambda: "/".join([*(word() for _ in range(3)), str(draw.randint(1, 10**6))]),
        lambda: "_".join(word() for _ in range(draw.randint(2, 4))) + "=" + some(DIGITS, draw.randint(1, 9)),
        lambda: f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}",
        lambda: some(UPPER, 2) + some(DIGITS, 2) + some(UPPER, 4) + some(DIGITS, 14),
        lambda: "".join(word() for _ in range(3)).capitalize() + some(DIGITS, draw.randint(1, 4)),
        lambda: "-".join(some(DIGITS, n) for n in (3, 4, 4)) + word(),
    ]
    out = [(kind, f()) for kind, f in formats.items() for _ in range(each)]
    return out + [(ORDINARY, draw.choice(plain)()) for _ in range(4 * each)]


class Node:
    __slots__ = ("count", "end", "next")

    def __init__(self) -> None:
        self.count, self.end, self.next = 0, 0, {}


def prefix_tree(strings: Iterable[bytes]) -> Node:
    root = Node()
    for s in strings:
        node = root
        node.count += 1
        for c in s:
            node = node.next.setdefault(c, Node())
            node.count += 1
        node.end += 1
    return root


def _differs(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: Node, b: Node, alpha: float) -> bool:
    """Whether no pair of states below can be told apart."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if not x.count or not y.count:
            continue
        if _differs(x.end, x.count, y.end, y.count, alpha):
            return False
        for c in x.next.keys() | y.next.keys():
            u, v = x.next.get(c), y.next.get(c)
            if _differs(_arrivals(x, c), x.count, _arrivals(y, c), y.count, alpha):
                return False
            if u is not None and v is not None and u is not x and v is not y and y.count > 8:
                stack.append((u, v))
    return True


def _arrivals(x: Node, c: int) -> int:
    return x.edges.get(c, 0) if isinstance(x, Core) else (x.next[c].count if c in x.next else 0)


class Core(Node):
    """A state that is kept; its edges have counts of their own, as their targets may be shared."""

    __slots__ = ("edges",)

    def __init__(self, node: Node) -> None:
        self.count, self.end, self.next = node.count, node.end, dict(node.next)
        self.edges = {c: x.count for c, x in node.next.items()}


def _likelihood(core: Core, node: Node) -> float:
    total = core.count + 1.0
    out = node.end * math.log((core.end + 0.01) / total)
    return out + sum(x.count * math.log((core.edges.get(c, 0) + 0.01) / total) for c, x in node.next.items())


def infer(strings: Iterable[bytes], alpha: float = ALPHA) -> list[Core]:
    """Merges the prefix tree's states, those with most evidence first; state 0 is the start."""
    root = Core(prefix_tree(strings))
    cores: list[Core] = [root]
    kept = {id(root)}
    while True:
        fringe = [(x.count, -k, -c, core, c, x) for k, core in enumerate(cores) for c, x in core.next.items() if id(x) not in kept]
        if not fringe:
            return cores
        *_, parent, c, blue = max(fringe, key=lambda f: f[:3])
        fits = [core for core in cores if compatible(core, blue, alpha)]
        if fits:
            best = max(fits, key=lambda core: _likelihood(core, blue))
            parent.next[c] = best
            _fold(best, blue, kept)
        else:
            new = Core(blue)
            parent.next[c] = new
            cores.append(new)
            kept.add(id(new))


def _fold(into: Node, tree: Node, kept: set[int]) -> None:
    """Adds a tree's counts to a state, along its edges."""
    stack = [(into, tree)]
    while stack:
        x, t = stack.pop()
        x.count += t.count
        x.end += t.end
        for c, u in t.next.items():
            if isinstance(x, Core):
                x.edges[c] = x.edges.get(c, 0) + u.count
            if c in x.next:
                stack.append((x.next[c], u))
            else:
                x.next[c] = u


class Automata:
    """All formats' automata in one table; a state that lacks a symbol leads to a dead one, at a floor probability."""

    def __init__(self, labelled: list[tuple[str, str]], alpha: float = ALPHA) -> None:
        by: dict[str, list[bytes]] = defaultdict(list)
        for kind, s in labelled:
            by[kind].append(s.encode())
        self.kinds = [k for k in by if k != ORDINARY]
        self.least = max(4, int(SHORTER * min((len(x) for k in self.kinds for x in by[k]), default=0)))
        order = [*self.kinds, ORDINARY] if ORDINARY in by else self.kinds
        self.start, go, log, end = [], [np.zeros(256, np.int32)], [np.full(256, math.log(FLOOR), np.float32)], [math.log(FLOOR)]
        for kind in order:
            cores = infer(by[kind], alpha)
            at = {id(x): len(go) + i for i, x in enumerate(cores)}
            self.start.append(len(go))
            for x in cores:
                g, p = np.zeros(256, np.int32), np.full(256, math.log(FLOOR), np.float32)
                for c, y in x.next.items():
                    g[c], p[c] = at[id(y)], math.log(max(x.edges[c], 0.01) / x.count)
                go.append(g)
                log.append(p)
                end.append(math.log(max(x.end / x.count, FLOOR)))
        even = lambda x: (np.round(np.array(x, np.float32) * GRAIN) / GRAIN).astype(np.float32)
        self.go, self.log, self.end = np.array(go), even(log), even(end)
        self.order = order
        #: each automaton's tables as lists, for one long string
        self.lists = [[[*zip(g, p, strict=True)] for g, p in zip(self.go.tolist(), self.log.tolist(), strict=True)]]
        self.typical = {}
        for i, kind in enumerate(self.kinds):
            own = self.scores(by[kind])[:, i] / np.array([len(s) + 1 for s in by[kind]])
            self.typical[kind] = math.floor((float(own.min()) - SLACK * float(own.std())) * GRAIN) / GRAIN

    def scores(self, candidates: list[bytes]) -> np.ndarray:
        """Log-likelihood of each candidate under each automaton."""
        sizes = np.array([len(c) for c in candidates])
        total = np.zeros((len(candidates), len(self.start)))
        state = np.tile(np.array(self.start), (len(candidates), 1))
        by_size = np.argsort(-sizes, kind="stable")
        by_size = by_size[sizes[by_size] <= LONG]
        raw, at = np.frombuffer(b"".join(candidates), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        for pos in range(int(sizes[by_size].max(initial=0))):
            live = by_size[: int((sizes[by_size] > pos).sum())]
            c = raw[at[live] + pos][:, None]
            s = state[live]
            total[live] += self.log[s, c]
            state[live] = self.go[s, c]
        for i in np.flatnonzero(sizes > LONG):
            for j, first in enumerate(self.start):
                total[i, j], state[i, j] = self._followed(first, candidates[i])
        return total + self.end[state]

    def _followed(self, state: int, string: bytes) -> tuple[float, int]:
        """Log-likelihood of a long string, without its end, and the state it leads to."""
        total, tables = 0.0, self.lists[0]
        for c in string:
            state, more = tables[state][c]
            total += more
        return total, state

    def verdicts(self, candidates: list[bytes]) -> list[tuple[str, float] | None]:
        if not candidates or not self.kinds:
            return [None] * len(candidates)
        return self.judged(self.scores(candidates), np.array([len(c) for c in candidates]))

    def likeliest(self, values: list[bytes]) -> list[tuple[str, float]]:
        """The likeliest automaton (ordinary strings' is one) of each value, and the log-likelihood for each character."""
        if not values or not self.order:
            return [("", 0.0)] * len(values)
        got = self.scores(values)
        best = got.argmax(axis=1)
        return [(self.order[b], float(row[b]) / (len(v) + 1)) for row, b, v in zip(got, best.tolist(), values, strict=True)]

    def judged(self, got: np.ndarray, sizes: np.ndarray) -> list[tuple[str, float] | None]:
        n = len(self.kinds)
        best = got[:, :n].argmax(axis=1)
        out: list[tuple[str, float] | None] = []
        for row, b, size in zip(got, best, sizes.tolist(), strict=True):
            margin = float(row[b] - row[n]) if len(row) > n else float(row[b])
            kind = self.kinds[b]
            fits = row[b] / (size + 1) >= self.typical[kind] and (margin >= MARGIN or len(row) == n)
            out.append((kind, margin) if fits else None)
        return out

    def parts(self, raw: np.ndarray, closes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[tuple], "Tails"]:
        """Parts of up to ``TOGETHER`` characters that fit, as (-margin, -size, start, end, kind), and the longer ones' tails.

        ``closes`` marks the ends that parts may have.  Of one start's parts those stay that no shorter one beats:
        wherever one of the others has room, so has the one that beats it.
        """
        short: list[tuple] = []
        lanes = []
        for i in range(0, len(starts) if self.kinds else 0, LANES):
            own, left = self._parts(raw, closes, starts[i : i + LANES], stops[i : i + LANES])
            short += own
            lanes.append(left)
        return short, Tails(self, raw, closes, [np.concatenate(x) for x in zip(*lanes, strict=True)])

    def _parts(self, raw: np.ndarray, closes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[tuple], list[np.ndarray]]:
        n, found = len(self.kinds), []
        best = np.full(len(starts), MARGIN if len(self.start) > n else -math.inf)
        typical = np.array([self.typical[k] for k in self.kinds])
        lane, pos = np.arange(len(starts)), 0
        total, state = np.zeros((len(starts), len(self.start))), np.tile(np.array(self.start), (len(starts), 1))
        while len(lane) and pos < TOGETHER:  # all formats at once
            c = raw[starts[lane] + pos][:, None]
            total += self.log[state, c]
            state = self.go[state, c]
            pos += 1
            live = state[:, :n].any(axis=1)
            lane, total, state = lane[live], total[live], state[live]
            e = np.flatnonzero(closes[starts[lane] + pos]) if pos >= self.least else np.zeros(0, np.int64)
            got = total[e] + self.end[state[e]]
            kind = got[:, :n].argmax(axis=1)
            score = got[np.arange(len(e)), kind]
            margin = score - got[:, n] if len(self.start) > n else score
            fits = (score >= typical[kind] * (pos + 1)) & (margin >= best[lane[e]])
            of, kind, margin = lane[e[fits]], kind[fits], margin[fits]
            best[of] = margin
            found += [(-m, -pos, a, a + pos, self.kinds[k]) for a, k, m in zip(starts[of].tolist(), kind.tolist(), margin.tolist(), strict=True)]
            more = starts[lane] + pos < stops[lane]
            lane, total, state = lane[more], total[more], state[more]
        row, kind = np.nonzero(state[:, :n]) if len(lane) else (np.zeros(0, np.int64),) * 2
        plain, of = (total[row, n], state[row, n]) if len(self.start) > n else (np.zeros(len(row)), np.zeros(len(row), np.int32))
        lane = lane[row]
        return found, [starts[lane], stops[lane], kind, total[row, kind], state[row, kind], plain, of]


class Tail:
    """What follows a place in one state of a format and of the ordinary strings: the ends of parts, with the likelihoods up to them."""

    __slots__ = ("kind", "own", "plain", "ends", "joins", "pos", "gain", "room", "gains", "rooms", "most")

    def __init__(self, kind: int) -> None:
        self.kind, self.own, self.plain, self.ends, self.joins = kind, 0.0, 0.0, [], None

    def close(self, typical: float) -> None:
        """Tables of the ends: place, margin, likelihood beyond the typical one, and the greatest of each block."""
        pos, own, plain = np.array(self.ends).reshape(-1, 3).T
        self.ends = []
        self.pos, self.gain, self.room = pos.astype(np.int64), own - plain, own - typical * pos
        cuts = np.arange(0, len(pos), BLOCK)
        self.gains, self.rooms = (np.maximum.reduceat(x, cuts) if len(x) else x for x in (self.gain, self.room))
        self.most = float(self.room.max(initial=-math.inf))

    def best(self, since: int, limit: int, need: float) -> tuple[float, int]:
        """(margin, place) of the best end from ``since`` to ``limit`` that leaves the room, the last of equal ones."""
        out = (-math.inf, -1)
        if self.most < need:
            return out
        i, j = int(np.searchsorted(self.pos, since)), int(np.searchsorted(self.pos, limit, "right"))

        def look(a: int, b: int) -> tuple[float, int]:
            fit = np.flatnonzero(self.room[a:b] >= need) + a
            if not len(fit):
                return -math.inf, -1
            most = self.gain[fit].max()
            return float(most), int(self.pos[fit[self.gain[fit] == most][-1]])

        a, b = -(-i // BLOCK), j // BLOCK
        if a >= b:
            return look(i, j)
        out = max(look(i, a * BLOCK), look(b * BLOCK, j))
        gains = np.where(self.rooms[a:b] >= need, self.gains[a:b], -math.inf)
        while (m := int(gains.argmax())) >= 0 and gains[m] > -math.inf and gains[m] >= out[0]:
            out = max(out, look((a + m) * BLOCK, (a + m + 1) * BLOCK))
            gains[m] = -math.inf
        return out


class Tails:
    """Parts of more than ``TOGETHER`` characters.  Those in one state at one place go on as one, so a text is read once for all."""

    def __init__(self, automata: Automata, raw: np.ndarray, closes: np.ndarray, lanes: list[np.ndarray]) -> None:
        self.automata = automata
        self.lanes: list[tuple] = []  # start, stop, tail, first place of ends, likelihoods before the tail
        if not lanes or not len(lanes[0]):
            return
        tables, end, ordinary = automata.lists[0], automata.end.tolist(), len(automata.start) > len(automata.kinds)
        order = np.argsort(lanes[0], kind="stable")
        entering = list(zip(*(x[order].tolist() for x in lanes), strict=True))
        tails: list[Tail] = []
        active: dict[tuple[int, int, int], Tail] = {}
        i, p, stop = 0, 0, 0
        while i < len(entering) or active:
            if not active:
                p = entering[i][0] + TOGETHER
            while i < len(entering) and entering[i][0] + TOGETHER == p:
                start, stop, kind, own, at, plain, of = entering[i]
                tail = active.get((kind, at, of))
                if tail is None:
                    tail = active[kind, at, of] = Tail(kind)
                    tails.append(tail)
                self.lanes.append((start, stop, tail, p + 1, own - tail.own, plain - tail.plain))
                i += 1
            c = int(raw[p])
            p += 1
            going: dict[tuple[int, int, int], Tail] = {}
            for (kind, at, of), tail in active.items():  # the oldest first
                at, more = tables[at][c]
                tail.own += more
                if ordinary:
                    of, more = tables[of][c]
                    tail.plain += more
                if at:
                    first = going.setdefault((kind, at, of), tail)
                    if first is not tail:
                        tail.joins = (first, p, tail.own - first.own, tail.plain - first.plain)
            if closes[p]:
                for (_, at, of), tail in going.items():
                    tail.ends.append((p, tail.own + end[at], tail.plain + (end[of] if ordinary else 0.0)))
            active = going if p < stop else {}
        for tail in tails:
            tail.close(automata.typical[automata.kinds[tail.kind]])

    def best(self, lane: int, limit: int) -> tuple | None:
        """The lane's best part up to ``limit``: (-margin, -size, start, end, kind, lane)."""
        start, _, tail, since, own, plain = self.lanes[lane]
        kind = self.automata.kinds[tail.kind]
        typical, out = self.automata.typical[kind], (-math.inf, -1)
        while since <= limit:
            gain, b = tail.best(since, limit, typical * (1 - start) - own)
            out = max(out, (gain + own - plain, b))
            if tail.joins is None:
                break
            tail, since, more, other = tail.joins
            own, plain = own + more, plain + other
        floor = MARGIN if len(self.automata.start) > len(self.automata.kinds) else -math.inf
        return (-out[0], start - out[1], start, out[1], kind, lane) if out[1] >= 0 and out[0] >= floor else None


def apart(short: list[tuple], tails: Tails) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates that are left when each takes its place, the best first; none overlaps another."""
    short = sorted(short)
    long = [x for i, lane in enumerate(tails.lanes) if (x := tails.best(i, lane[1]))]
    heapq.heapify(long)
    begins: list[int] = []
    ends: list[int] = []
    out, i = [], 0
    while i < len(short) or long:
        if long and (i == len(short) or long[0] < short[i]):
            _, _, a, b, kind, lane = heapq.heappop(long)
        else:
            (_, _, a, b, kind), lane = short[i], None
            i += 1
        at = bisect.bisect_right(begins, a)
        if at and ends[at - 1] > a:
            continue
        if at == len(begins) or begins[at] >= b:
            begins.insert(at, a)
            ends.insert(at, b)
            out.append((a, b, kind))
        elif lane is not None and (x := tails.best(lane, begins[at])):
            heapq.heappush(long, x)
    return out


_RUN = np.zeros(256, np.uint8)
_RUN[[ord(c) for c in UPPER + LOWER + DIGITS + "+/_.=-"]] |= 2
_RUN[[ord(c) for c in DIGITS + "abcdef"]] |= 1
_SEPARATOR, _EDGE = np.zeros(256, bool), np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "+/_.=-"]] = True
_EDGE[[ord(c) for c in ".-/="]] = True


def _runs(bits: np.ndarray, bit: int, least: int) -> list[tuple[int, int]]:
    mask = np.zeros(len(bits) + 2, np.int8)
    mask[1:-1] = (bits & bit) != 0
    edge = np.diff(mask)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def base_matches(data: bytes, bits: np.ndarray) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) in bytes, over a whole buffer of texts."""
    low, found = data.lower(), []
    places = []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    after = 0
    for at in sorted(places):
        if at >= after and (m := ASSIGN.match(data, at)):
            after = m.end()
            if len(m[1]) >= LEAST["assign"]:
                found.append((m.start(), m.end(), "assign", m.start(1)))
    found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    found += [(a, b, "hex", a) for a, b in _runs(bits, 1, LEAST["hex"])]
    return found


def _trimmed(data: bytes, a: int, b: int) -> tuple[int, int]:
    while b > a and data[b - 1] in b".-/=":
        b -= 1
    while a < b and data[a] in b".-/=":
        a += 1
    return a, b


def _starts(raw: np.ndarray, places: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the runs' parts, each with its run's end."""
    begins, ends = (np.array([p[i] for p in places], np.int64) for i in (0, 1))
    behind = np.flatnonzero(_SEPARATOR[raw]) + 1
    run = np.searchsorted(begins, behind, "right") - 1
    inside = run >= 0
    behind, run = behind[inside], run[inside]
    inside = (behind > begins[run]) & (behind + least <= ends[run])
    behind, run = behind[inside], run[inside]
    own = ~_EDGE[raw[behind]]
    return np.concatenate([begins, behind[own]]), np.concatenate([ends, ends[run[own]]])


def scan(texts: list[bytes], automata: Automata) -> list[list[tuple[int, int, str, str, float]]]:
    """Per text, its spans (start, end, kind, likeliest format, likelihood for each character) in bytes, base kinds first at ties."""
    out: list[list[tuple[int, int, str, str, float]]] = [[] for _ in texts]
    rank = {k: i for i, k in enumerate((*BASE, *automata.kinds))}
    for x, y in C.sub_batches(texts):
        raw, at = C.joined(texts[x:y])
        data, bits = raw.tobytes(), _RUN[raw]
        base = base_matches(data, bits)
        places = [(a, b) for a, b in (_trimmed(data, *run) for run in _runs(bits, 2, automata.least)) if b - a >= automata.least]
        spans = [(a, b, kind, v) for a, b, kind, v in base]
        own = {(v, b) for _, b, _, v in base}
        if places:
            closes = np.append(_SEPARATOR[raw], False)
            closes[[b for _, b in places]] = True
            closes[1:] &= ~_EDGE[raw]
            short, tails = automata.parts(raw, closes, *_starts(raw, places, automata.least))
            whole = automata.verdicts([data[a:b] for a, b in places])
            short += [(-v[1], a - b, a, b, v[0]) for (a, b), v in zip(places, whole, strict=True) if v]
            spans += [(a, b, kind, a) for a, b, kind in apart(short, tails) if (a, b) not in own]
        for (a, b, kind, _), (best, each) in zip(spans, automata.likeliest([data[v:b] for _, b, _, v in spans]), strict=True):
            d = int(np.searchsorted(at, a, "right")) - 1
            out[x + d].append((a - int(at[d]), b - int(at[d]), kind, best, each))
    for spans in out:
        spans.sort(key=lambda s: (s[0], rank[s[2]], s[1]))
    return out


def _code_points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """The same spans, counted in code points (spans begin in order, ends may lie in any)."""
    edges = sorted({e for a, b, *_ in spans for e in (a, b)})
    place, done, points = {}, 0, 0
    for e in edges:
        points += len(text[done:e].decode())
        place[e], done = points, e
    return [(place[a], place[b], *rest) for a, b, *rest in spans]


def _shown(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, *_ in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learnt long, likelihoods string"
_TYPES = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_learnt": pa.int64(), "likelihoods": pa.string()}


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """Secrets of every text; ``labelled`` are the credentials to learn formats from (bounded: it stays on the driver).

    Returns the columns ``keep`` (default: all, but those called like a result), the base kinds'
    counts, the hash of the base spans, all spans, the number of learnt ones, and the likelihoods.
    """
    C.prepare(docs.sparkSession)
    kept = C.Kept(docs, RESULT, keep)
    columns = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(Automata(labelled_credentials() if labelled is None else labelled))
    none = hashlib.sha256(b"").hexdigest()

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            texts = C.texts_of(batch, "body")
            got: dict[str, list] = {c: [] for c in _TYPES}
            for body, spans in zip(texts, scan(texts, shared.value), strict=True):
                spans = _code_points(body, spans)
                own = [s for s in spans if s[2] in LEAST]
                for kind in BASE:
                    got[f"n_{kind}"].append(sum(s[2] == kind for s in own))
                got["base_sha256"].append(hashlib.sha256(_shown(own).encode()).hexdigest() if own else none)
                got["spans"].append(_shown(spans))
                got["n_learnt"].append(len(spans) - len(own))
                got["likelihoods"].append(",".join(f"{best}:{each:.3f}" for *_, best, each in spans))
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {c: pa.array(got[c], t) for c, t in _TYPES.items()})

    return kept.apply(task, body=kept.column(text))


def redacted(text: bytes, spans: list[tuple]) -> bytes:
    """The text with each run of overlapping spans as ``[kind]``, after the first span's kind."""
    out, done = [], 0
    for a, b, kind, *_ in spans:
        if a >= done:
            out += [text[done:a], b"[" + kind.upper().encode() + b"]"]
        done = max(done, b)
    return b"".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, text: str = "text", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """All rows and columns, with secrets in ``text`` blotted out; a null text stays null."""
    C.prepare(docs.sparkSession)
    kept = C.Kept(docs, "unused int", [])
    at = kept.place(text)
    shared = docs.sparkSession.sparkContext.broadcast(Automata(labelled_credentials() if labelled is None else labelled))

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            given = batch.column(at)
            bodies = C.texts_of(batch, f"c{at}")
            new = [None if null else (redacted(body, spans) if spans else body).decode() for body, spans, null in zip(bodies, scan(bodies, shared.value), given.is_null().to_pylist(), strict=True)]
            columns = [*batch.columns]
            columns[at] = pa.array(new, given.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return kept.df.mapInArrow(task, kept.df.schema).toDF(*docs.columns)
