"""English stemming by the published Porter2 rules, as tables of endings tried longest first."""

from __future__ import annotations

import functools
import re

# Fixed values of the Porter2 algorithm: words with a stem of their own, words left alone, endings and what they become.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ALONE = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
ALONE_LATER = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
V, C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"^{C}*{V}+{C}")
_EARLY = re.compile("^(?:gener|commun|arsen)")
_SHORT = re.compile(f"(?:^{V}{C}|{C}{V}[^aeiouywxY])$")


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other alphabets and of two letters stay."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in OWN or word in ALONE:
        return OWN.get(word, word)
    w = re.sub(f"(^|(?<={V}))y", "Y", word.lstrip("'"))
    start = _EARLY.match(w) or _REGION.match(w)
    r1 = start.end() if start else len(w)
    rest = _REGION.match(w[r1:])
    r2 = r1 + rest.end() if rest else len(w)
    w = re.sub(r"'s'?$|'$", "", w)

    if e := _ending(w, ("sses", "ied", "ies", "us", "ss", "s")):
        if e == "sses":
            w = w[:-2]
        elif e in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif e == "s" and re.search(V, w[:-2]):
            w = w[:-1]
    if w in ALONE_LATER:
        return w
    if e := _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        base = w[: -len(e)]
        if e.startswith("eed"):
            w = base + "ee" if len(base) >= r1 else w
        elif re.search(V, base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
                w = base[:-1]
            else:
                w = base + "e" if len(base) <= r1 and _SHORT.search(base) else base
    if len(w) > 2 and w[-1] in "yY" and re.match(C, w[-2]):
        w = w[:-1] + "i"
    e = _ending(w, STEP_2)
    base = w[: -len(e)] if e else w
    if e and len(base) >= r1 and (e != "ogi" or base.endswith("l")) and (e != "li" or re.search("[cdeghkmnrt]$", base)):
        w = base + STEP_2[e]
    e = _ending(w, STEP_3)
    base = w[: -len(e)] if e else w
    if e and len(base) >= (r2 if e == "ative" else r1):
        w = base + STEP_3[e]
    e = _ending(w, STEP_4)
    base = w[: -len(e)] if e else w
    if e and len(base) >= r2 and (e != "ion" or base.endswith(("s", "t"))):
        w = base
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
