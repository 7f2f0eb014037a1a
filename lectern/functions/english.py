"""English stems, by the rules of the Porter2 (Snowball English) description."""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own, and words that keep their form after step 1a. Fixed values.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of steps 2 to 4 with what takes their place. Fixed values.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_ENDS_2, _ENDS_3 = tuple(STEP_2), tuple(STEP_3)
_LI = "cdeghkmnrt"
#: Beginnings after which the first region starts at once. Fixed values.
_BEGINNINGS = ("gener", "commun", "arsen")


def _region(word: str, start: int) -> int:
    """Where the region begins that follows the first non-vowel after a vowel, from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    # a y that begins the word or follows a vowel is a consonant, written Y
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    begun = next((b for b in _BEGINNINGS if word.startswith(b)), None)
    r1 = len(begun) if begun else _region(word, 0)
    r2 = _region(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    word = _plural(word)
    if word in INVARIANT:
        return word.lower()
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    end = _longest(word, _ENDS_2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in tuple(_LI)):
        word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, _ENDS_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not any(c in _VOWELS for c in rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLE):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest
