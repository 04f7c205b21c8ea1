"""English words as a full-text index holds them: stop words left out, endings taken off (the published Snowball rules)."""

from __future__ import annotations

import functools
import re

# Stop words, words with stems of their own, and the tables of endings.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

VOWEL = "aeiouy"
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_WORD = re.compile(r"[^\W_]+")


def _after(word: str, start: int) -> int:
    """Where the region behind the first vowel and consonant begins."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        return w[:-1]
    return w


def _past(w: str, first: int) -> str:
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return w
    base = w[: -len(ending)]
    if ending.startswith("eed"):
        return base + "ee" if len(base) >= first else w
    if not re.search("[aeiouy]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base):
        return base[:-1]
    return base + "e" if len(base) <= first and _SHORT.search(base) else base


def _derived(w: str, first: int, second: int) -> str:
    e = _longest(w, SECOND)
    if e is not None and len(w) - len(e) >= first:
        base = w[: -len(e)]
        if (e != "ogi" or base.endswith("l")) and (e != "li" or base[-1:] in tuple("cdeghkmnrt")):
            w = base + SECOND[e]
    e = _longest(w, THIRD)
    if e is not None and len(w) - len(e) >= (second if e == "ative" else first):
        w = w[: -len(e)] + THIRD[e]
    e = _longest(w, FOURTH)
    if e is not None and len(w) - len(e) >= second and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    return w


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """A small-lettered word without its endings; words that aren't of ASCII letters stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    m = re.match("gener|commun|arsen", w)
    first = m.end() if m else _after(w, 0)
    second = _after(w, first)
    w = _plural(w)
    if w in WHOLE:
        return w
    w = _past(w, first)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    w = _derived(w, first, second)
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: str) -> list[tuple[str, int]]:
    """(stem, place) of the words that count; places go over stop words too."""
    return [(stem(w), i) for i, w in enumerate(_WORD.findall(text.lower())) if w not in STOP]


_PART = re.compile(r'(-?)"([^"]*)"?|(-?)(\S+)')


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-like query as groups (any of them), each of items (all of them): (excluded, stems one behind the other).

    Quotes make a phrase, ``-`` excludes, ``or`` parts groups; words with signs inside are phrases;
    stop words don't count.
    """
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for not_phrase, phrase, not_word, word in _PART.findall(query):
        if word.lower() == "or" and not not_word:
            groups.append([])
            continue
        stems = [t for t, _ in lexemes(phrase or word)]
        if stems:
            groups[-1].append((bool(not_phrase or not_word), stems))
    return [g for g in groups if g]
