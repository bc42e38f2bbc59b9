"""English stems (the Snowball English definition) and full-text match and rank over them.

A stem is worked out once for each distinct word of a batch, in Python; matching and OR-ranking are column expressions
over the arrays of stems.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that the English configuration of full-text search leaves out, and stems that follow no rule.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "inning": "inning", "outing": "outing", "canning": "canning", "herring": "herring", "earring": "earring", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_TWO = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_THREE = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_FOUR = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _vowel(part: str) -> bool:
    return any(c in "aeiouy" for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    one, two = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel(word[:-2]):
        word = word[:-1]
    if word in IRREGULAR and word in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return word
    # past and progressive
    for ending in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if ending in ("eed", "eedly"):
                word = base + "ee" if len(base) >= one else word
            elif _vowel(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLE):
                    word = word[:-1]
                elif one >= len(word) and _SHORT.match(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for ending, instead in STEP_TWO:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= one and (ending != "ogi" or base.endswith("l")) and (ending != "li" or base[-1:] in tuple("cdeghkmnrt")):
                word = base + instead
            break
    for ending, instead in STEP_THREE:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= (two if ending == "ative" else one):
                word = base + instead
            break
    for ending in STEP_FOUR:
        if word.endswith(ending):
            base = word[: -len(ending)]
            if len(base) >= two and (ending != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= two or len(base) >= one and not _SHORT.match(base):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= two:
        word = word[:-1]
    return word.lower()


def text_stems(text: str | None) -> list[str]:
    """Stems of the words (letters and digits) of a text in order; '' keeps the place of a stop word."""
    return ["" if w in STOP else stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]


#: Texts whose stems a worker holds as Python lists at once; those done are kept in Arrow's form.
TEXTS = 256


def _stems(texts: pd.Series) -> pd.Series:
    kind = pd.ArrowDtype(pa.list_(pa.string()))
    parts = [pa.array([text_stems(t) for t in texts.iloc[k : k + TEXTS]], pa.list_(pa.string())) for k in range(0, len(texts), TEXTS)]
    return pd.Series(pd.array(pa.chunked_array(parts, pa.list_(pa.string())), dtype=kind))


def stems(text: Column) -> Column:
    """The stems of a column of texts, in Arrow batches, of which ``TEXTS`` at a time are split."""
    return F.pandas_udf(_stems, ArrayType(StringType()))(text)


def query_stems(query: str) -> list[str]:
    return list(dict.fromkeys(s for s in text_stems(query) if s))


def matches(found: Column, query: list[str], every: bool) -> Column:
    """Whether an array of stems has any, or all, of the query's; no query matches nothing."""
    if not query:
        return F.lit(False)
    wanted = F.array(*map(F.lit, query))
    return F.size(F.array_except(wanted, found)) == 0 if every else F.arrays_overlap(wanted, found)


def places(found: Column, word: str) -> Column:
    """Positions of a stem, from 1."""
    return F.filter(F.transform(found, lambda s, i: F.when(s == word, i + 1)), lambda i: i.isNotNull())


def or_rank(found: Column, query: list[str]) -> Column:
    """0.1 times the sum of 1/j**2 over each stem's occurrences, over pi**2/6 and the number of stems."""
    score = F.lit(0.0)
    for word in query:
        count = F.size(places(found, word))
        part = F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
        score = score + part
    return score * 0.1 / 1.64493406685 / max(1, len(query))


def _apart(one: Column, two: Column) -> Column:
    """The distance of each place of one to each of two."""
    return F.flatten(F.transform(one, lambda p: F.transform(two, lambda q: F.abs(p - q))))


def and_rank(found: Column, query: list[str]) -> Column:
    """Proximity rank of all stems together: 1 less the product, over pairs of places of different stems, of 1 less the root of 0.1 * 0.1 * closeness.

    Closeness is 1 / (1.005 + 0.05 * exp(distance / 1.5 - 2)), and next to nothing beyond a distance of 100.
    With one stem it is the OR-rank.
    """
    if len(query) < 2:
        return or_rank(found, query)
    left = F.lit(1.0)
    for k, a in enumerate(query):
        for b in query[k + 1 :]:
            pairs = _apart(places(found, a), places(found, b))
            near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
            left = left * F.aggregate(pairs, F.lit(1.0), lambda s, d: s * (1.0 - F.sqrt(0.01 * near(d))))
    return 1.0 - left
