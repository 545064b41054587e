"""The plain search box: words over all fields, as condition groups with a three-valued answer; where a hit landed."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from archivum.operators.search import Condition, Group, word_match

#: Words of the grammar.
IN_ATTACHMENTS = ("in:attachments", "in:attachment")


def plain_terms(line: str) -> tuple[list[list[tuple[str, bool, bool]]], bool]:
    """(alternatives, in attachments): each alternative a list of (text, is a phrase, is left out).

    ``OR`` parts alternatives, ``NOT`` and a leading minus leave out, ``AND`` says nothing; only in capitals.  White space
    inside double quotes doesn't end a token; a token in quotes is a phrase.
    """
    tokens = re.findall(r'(?:[^\s"]|"[^"]*(?:"|$))+', line)
    inside = any(t.lower() in IN_ATTACHMENTS for t in tokens)
    out: list[list[tuple[str, bool, bool]]] = [[]]
    leave_out = False
    for t in tokens:
        if t == "AND" or t.lower() in IN_ATTACHMENTS:
            continue
        if t == "OR":
            if out[-1]:
                out.append([])
            continue
        if t == "NOT":
            leave_out = True
            continue
        minus = len(t) > 1 and t[0] == "-"
        text = t[1:] if minus else t
        phrase = len(text) > 1 and text[0] == text[-1] == '"'
        text = (text[1:-1] if phrase else text).strip()
        if text:
            out[-1].append((text, phrase, leave_out or minus))
        leave_out = False
    return [a for a in out if a], inside


def plain_groups(line: str, anywhere: list[Column], attachments: list[Column], whole_words: bool = False) -> list[Group]:
    """The condition groups of a line; none for a line without words.

    One alternative: all its words and phrases, somewhere in ``anywhere`` (each word for itself), the last word as a
    beginning unless ``whole_words``; what it leaves out is left out of the whole answer.  Several alternatives: one of them,
    by whole words, each without what was left out in it.  With ``in:attachments`` the words must be in ``attachments``.
    """
    alternatives, inside = plain_terms(line)
    fields = attachments if inside else anywhere

    def found(text: str, phrase: bool, beginning: bool = False) -> Column:
        words = [text] if phrase else text.split()
        return reduce(Column.__and__, [reduce(Column.__or__, [word_match(f, w, prefix=beginning) for f in fields]) for w in words])

    def condition(term: tuple[str, bool, bool], beginning: bool = False) -> Condition:
        return Condition(found(term[0], term[1], beginning), reads_text=True)

    wanted = [a for a in alternatives if any(not t[2] for t in a)]
    if len(wanted) > 1:
        return [Group("any", [[Condition(found(t[0], t[1]), True, t[2]) for t in a] for a in wanted])]
    out = []
    if wanted:
        terms = [t for t in wanted[0] if not t[2]]
        last = max((i for i, t in enumerate(terms) if not t[1]), default=-1)
        out.append(Group("all", [[condition(t, i == last and not whole_words)] for i, t in enumerate(terms)]))
    left_out = [t for a in alternatives for t in a if t[2]]
    if left_out:
        out.append(Group("exclude", [[condition(t)] for t in left_out]))
    return out


#: The suffixes of the stemmer's steps 2 to 4, with what they become.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem of an English word in lower case; words of up to two letters and of other letters stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    end = _longest(w, ("sses", "ies", "ss", "s"))
    w = {"sses": w[:-2], "ies": w[:-2], "s": w[:-1]}.get(end, w)
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif end := _longest(w, ("ed", "ing")):
        cut = w[: -len(end)] if "v" in _shape(w[: -len(end)]) else None
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted({stem(w) for w in re.findall(r"[^\W_]+", (t or "").lower())}))


def matched_fields(df: DataFrame, fields: dict[str, str], words: list[str], out: str = "matched", body: str = "body") -> DataFrame:
    """Add ``out``: the names of ``fields`` (name: text column) that hold one of the search words, in that order.

    A field holds a word as a part of it, any case; where no field does so for any word, fields whose words have the stem of a
    search word count; where there is none of these either, the hit can only be in the ``body``.  Stems are worked out
    only for rows that need them.
    """
    low = [w.lower() for w in words if w]
    part = F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False)) for w in low], F.lit(False)), n) for n, c in fields.items()]))
    wanted = F.array(*[F.lit(stem(w)) for w in low]) if low else F.array().cast("array<string>")
    df = df.withColumn("_part", part)
    need = F.size("_part") == 0
    df = df.withColumns({f"_stems_{n}": _stems(F.when(need, F.col(c))) for n, c in fields.items()})
    by_stem = F.array_compact(F.array(*[F.when(F.arrays_overlap(f"_stems_{n}", wanted), n) for n in fields]))
    found = F.when(~need, F.col("_part")).when(F.size(by_stem) > 0, by_stem).otherwise(F.array(F.lit(body)))
    return df.withColumn(out, found).drop("_part", *[f"_stems_{n}" for n in fields])
