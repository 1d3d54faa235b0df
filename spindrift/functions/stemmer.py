"""The English stemmer of the Snowball project (Porter2, a published algorithm), and its stop words."""

from __future__ import annotations

import re
from functools import lru_cache

# --- fixed values: the published lists of the algorithm ---------------------------------------

STOPWORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now
    """.split()
)

#: Whole words with a stem of their own, and words that stay as they are.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay once plurals are off.
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Step 2, in the first region: endings and what they become.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
#: Step 3, in the first region.
SHORTENED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Step 4, in the second region.
DROPPED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_region = re.compile("[aeiouy][^aeiouy]")
_short_end = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_vowel = re.compile("[aeiouy]")


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin: after the first consonant that follows a vowel, and again."""
    begin = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if begin is None:
        found = _region.search(word)
        begin = found.end() if found else len(word)
    found = _region.search(word, begin)
    return begin, found.end() if found else len(word)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; of one with other than ASCII letters it is the word."""
    if len(word) < 3 or not word.isascii():
        return word
    word = word.replace("’", "'").lstrip("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)  # a y that is a consonant
    first, second = _regions(word)

    # step 0 and 1a: possessives and plurals
    word = re.sub("'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel.search(word[:-2]):
        word = word[:-1]
    if word in SETTLED:
        return word

    # step 1b: past and present participles
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    elif end and _vowel.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif _short_end.search(word) and first >= len(word):
            word += "e"

    # step 1c: a final y after a consonant that isn't the first letter
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    # steps 2 to 4: derived endings, if they lie in the region
    end = _ending(word, [*DERIVED, "ogi", "li"])
    if end and len(word) - len(end) >= first:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(end)] + DERIVED[end]
    end = _ending(word, [*SHORTENED, "ative"])
    if end == "ative":
        word = word[:-5] if len(word) - 5 >= second else word
    elif end and len(word) - len(end) >= first:
        word = word[: -len(end)] + SHORTENED[end]
    end = _ending(word, [*DROPPED, "ion"])
    if end and len(word) - len(end) >= second and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]

    # step 5: a final e or l
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _short_end.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
