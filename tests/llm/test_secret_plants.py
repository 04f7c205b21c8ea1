"""Credentials that no automaton was learnt from, planted in prose; and long texts of separators."""

import random
import time

import pytest

from foliary.llm import secrets
from tests.llm.helpers import sentence

AROUND = ["{p} {c} {q}", "{p} KEY={c} {q}", "{p} https://host-1.example.com/a/{c}/b {q}", "{p}: \"{c}\", {q}", "{p} x.{c}= {q}"]


def planted(seed):
    """Texts, and the format and place of the credential in each (ordinary strings have none)."""
    draw = random.Random(seed)
    out = []
    for kind, value in secrets.labelled_credentials(40, seed=seed):
        text = draw.choice(AROUND).format(p=sentence(draw, 20), c=value, q=sentence(draw, 20))
        out.append((text, None if kind == secrets.ORDINARY else (kind, text.index(value), text.index(value) + len(value))))
    return out


def test_held_out_credentials_in_prose(spark):
    cases = planted(99)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in secrets.find_secrets(rows).collect()}
    hit = wrong = reported = of = 0
    for i, (_, secret) in enumerate(cases):
        spans = [(k, int(a), int(b)) for k, a, b in found[i]]
        reported += len(spans)
        of += secret is not None
        covers = [s for s in spans if secret and s[1] <= secret[1] and s[2] >= secret[2]]
        hit += bool(covers)
        wrong += len(spans) - len([s for s in spans if secret and s[1] < secret[2] and s[2] > secret[1]])
    assert hit / of >= 0.97 and wrong / reported <= 0.01, (hit, of, wrong, reported)


@pytest.mark.parametrize("unit", ["a1-", "eyJabc.", "0a1b/", "x", "=", "sk_live_"])
def test_long_texts_of_separators(spark, unit):
    """Work in proportion to the length: four times the text in not much more than four times the time."""
    automata = secrets.Automata(secrets.labelled_credentials())
    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        secrets.scan([(unit * (n // len(unit))).encode()], automata)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 20


def test_long_text_is_blotted(spark):
    token = "ghp_aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"
    text = "a1-" * 40_000 + "\n" + "eyJabc." * 10_000 + " end KEY=" + token
    clean = secrets.redact_secrets(spark.createDataFrame([(text,)], "text string")).first().text
    assert clean.startswith("a1-a1-") and clean.endswith("KEY=[GITHUB]")


def test_overlapping_long_runs_of_one_text():
    automata = secrets.Automata(secrets.labelled_credentials())
    values = [v for k, v in secrets.labelled_credentials(6, seed=5) if k in ("github", "stripe", "npm")]
    text = "/".join(values).encode()
    spans = secrets.scan([text], automata)[0]
    assert sorted(text[a:b].decode() for a, b, *_ in spans) == sorted(values)
