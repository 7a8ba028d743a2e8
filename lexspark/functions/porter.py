"""Porter's stemmer, with the endings of its reference program (bli to ble, logi to log)."""

from __future__ import annotations

import re

# Endings and what replaces them, by step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """The word as c (consonant) and v (vowel); y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def measure(part: str) -> int:
    """How many vowel runs are followed by a consonant run."""
    return len(re.findall("v+c+", shape(part)))


def has_vowel(part: str) -> bool:
    return "v" in shape(part)


def ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def ends_cvc(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def longest(word: str, endings) -> str:
    """The longest of these endings that the word has, or the empty string."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = longest(w, ("ed", "ing"))
    if not end or not has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if ends_double(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and ends_cvc(w) else w


def swap(w: str, table: dict[str, str]) -> str:
    end = longest(w, table)
    part = w[: len(w) - len(end)]
    return part + table[end] if end and measure(part) > 0 else w


def strip(w: str) -> str:
    end = longest(w, STEP4)
    part = w[: len(w) - len(end)]
    if not end or measure(part) < 2 or (end == "ion" and not part.endswith(("s", "t"))):
        return w
    return part


def finish(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not ends_cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    w = past(plural(word))
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return finish(strip(swap(swap(w, STEP2), STEP3)))
