"""English stemmer after the published Snowball "English (Porter2)" definition,
meant to run once per distinct token."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")

# Fixed values of the published definition.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(i: int) -> int:
        for k in range(i + 1, len(w)):
            if w[k] not in VOWELS and w[k - 1] in VOWELS:
                return k + 1
        return len(w)

    r1 = next((len(p) for p in R1_PREFIXES if w.startswith(p)), None)
    if r1 is None:
        r1 = after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS and w[-1] not in "wxY"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-case token; tokens of one or two characters stay."""
    w = word[1:] if word.startswith("'") else word
    if len(word) <= 2:
        return word
    if w in WHOLE_WORDS:
        return WHOLE_WORDS[w]
    if len(w) <= 2:
        return w
    # a y at the start or after a vowel is a consonant
    out = []
    for i, c in enumerate(w):
        out.append("Y" if c == "y" and (i == 0 or out[i - 1] in VOWELS) else c)
    w = "".join(out)
    r1, r2 = _regions(w)

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w.replace("Y", "y")
    # step 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            at = len(w) - len(s)
            if s in ("eedly", "eed"):
                if at >= r1:
                    w = w[:at] + "ee"
            elif any(c in VOWELS for c in w[:at]):
                w = w[:at]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_syllable(w):
                    w += "e"
            break
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # step 2
    for s, to in STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in LI_ENDINGS):
                w = w[:at] + to
            break
    # step 3
    for s, to in STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + to
            break
    # step 4
    for s in STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # step 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(w[:at])):
            w = w[:at]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
