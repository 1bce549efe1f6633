"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping", 1980."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix tables of steps 2, 3 and 4 of the paper.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """Consonant / vowel pattern, e.g. ``trouble`` -> ``ccvvccv``."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _replace(word: str, table) -> str:
    suffix = _longest(word, [s for s, _ in table])
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    return stem + dict(table)[suffix] if _measure(stem) > 0 else word


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _drop_step4(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    if _measure(stem) < 2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_drop_step4(_replace(_replace(word, STEP2), STEP3)))


def _ends(word: Column, *suffixes: str) -> Column:
    out = F.endswith(word, F.lit(suffixes[0]))
    for suffix in suffixes[1:]:
        out = out | F.endswith(word, F.lit(suffix))
    return out


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _shape_of(word: Column) -> Column:
    """``_shape`` of a column. A y is a consonant first or behind a vowel; in a run of y the kinds alternate."""
    letters = F.translate(F.regexp_replace(word, "[^aeiouy]", "c"), "aeiou", "vvvvv")
    plain = F.regexp_replace(F.regexp_replace(letters, "^y", "c"), "vy", "vc")  # the first of a run, unless behind a consonant
    paired = F.regexp_replace(plain, r"(?:(?<=c)|\G(?!^))yy", "vc")
    return F.when(F.instr(word, "y") > 0, F.regexp_replace(paired, "(?<=c)y", "v")).otherwise(letters)


def _more_than(word: Column, m: int) -> Column:
    """Measure above ``m``."""
    return F.contains(_shape_of(word), F.lit("vc")) if m == 0 else F.rlike(_shape_of(word), F.lit("vc.*" * m + "vc"))


def _vowel_in(word: Column) -> Column:
    return F.contains(_shape_of(word), F.lit("v"))


def _short_end_of(word: Column) -> Column:
    return F.endswith(_shape_of(word), F.lit("cvc")) & ~F.right(word, F.lit(1)).isin("w", "x", "y")


def _by_table(word: Column, table) -> Column:
    """The longest suffix that fits decides; it is replaced if the measure of what stands before it is above 0."""
    last = sorted({suffix[-2:] for suffix, _ in table})
    out = None
    for suffix, new in sorted(table, key=lambda row: -len(row[0])):
        head = _cut(word, len(suffix))
        done = F.when(_more_than(head, 0), F.concat(head, F.lit(new))).otherwise(word)
        out = F.when(_ends(word, suffix), done) if out is None else out.when(_ends(word, suffix), done)
    return F.when(F.right(word, F.lit(2)).isin(last), out.otherwise(word)).otherwise(word)


def _without_plural(t: Column) -> Column:
    return F.when(_ends(t, "sses", "ies"), _cut(t, 2)).when(_ends(t, "s") & ~_ends(t, "ss"), _cut(t, 1)).otherwise(t)


def _without_past(t: Column) -> Column:
    """The word and whether an ending went that wants a repair."""
    def pair(word, open_end):
        return F.struct(word.alias("w"), F.lit(open_end).alias("open"))

    out = F.when(_ends(t, "eed"), F.when(_more_than(_cut(t, 3), 0), pair(_cut(t, 1), False)).otherwise(pair(t, False)))
    for suffix in ("ed", "ing"):
        head = _cut(t, len(suffix))
        out = out.when(_ends(t, suffix), F.when(_vowel_in(head), pair(head, True)).otherwise(pair(t, False)))
    return out.otherwise(pair(t, False))


def _repaired(t: Column) -> Column:
    w = t["w"]
    twice = (F.length(w) > 1) & (F.right(w, F.lit(1)) == F.substring(w, -2, 1)) & F.endswith(_shape_of(w), F.lit("c"))
    one = _more_than(w, 0) & ~_more_than(w, 1)
    fixed = F.when(_ends(w, "at", "bl", "iz"), F.concat(w, F.lit("e"))).when(
        twice & ~_ends(w, "l", "s", "z"), _cut(w, 1)).when(one & _short_end_of(w), F.concat(w, F.lit("e"))).otherwise(w)
    return F.when(t["open"], fixed).otherwise(w)


def _y_to_i(t: Column) -> Column:
    return F.when(_ends(t, "y") & _vowel_in(_cut(t, 1)), F.concat(_cut(t, 1), F.lit("i"))).otherwise(t)


def _without_step4(t: Column) -> Column:
    out = None
    for suffix in sorted(STEP4, key=len, reverse=True):
        head = _cut(t, len(suffix))
        fits = _more_than(head, 1) & _ends(head, "s", "t") if suffix == "ion" else _more_than(head, 1)
        done = F.when(fits, head).otherwise(t)
        out = F.when(_ends(t, suffix), done) if out is None else out.when(_ends(t, suffix), done)
    return F.when(F.right(t, F.lit(1)).isin(sorted({x[-1] for x in STEP4})), out.otherwise(t)).otherwise(t)


def _without_e(t: Column) -> Column:
    head = _cut(t, 1)
    return F.when(_ends(t, "e") & (_more_than(head, 1) | (_more_than(head, 0) & ~_short_end_of(head))), head).otherwise(t)


def _without_double_l(t: Column) -> Column:
    return F.when(_ends(t, "ll") & _more_than(t, 1), _cut(t, 1)).otherwise(t)


def stem_tokens(c: Column | str) -> Column:
    """Stems of a token array, by built-in expressions alone.

    Each step of the paper is one pass over the array, so that a step reads its
    word as a variable and no expression is written out twice.
    """
    tokens = F.col(c) if isinstance(c, str) else c
    out = tokens
    for step in (_without_plural, _without_past, _repaired, _y_to_i, lambda t: _by_table(t, STEP2),
                 lambda t: _by_table(t, STEP3), _without_step4, _without_e, _without_double_l):
        out = F.transform(out, step)
    return F.zip_with(tokens, out, lambda t, s: F.when(F.length(t) < 3, t).otherwise(s))


def stem_word(c: Column | str) -> Column:
    """Stem of one word a row, for columns that already hold distinct terms."""
    return stem_tokens(F.array(F.col(c) if isinstance(c, str) else c))[0]


def stop_words_with_stems(words: list[str]) -> list[str]:
    """The list together with the stems of its longer members."""
    return sorted(set(words) | {stem(w) for w in words if len(w) > 2})
