"""Kinship words in free text, as steps along family edges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words: kinship term, its steps (kind, sex hint).
WORDS = {
    "mother": [("parent", "F")], "father": [("parent", "M")], "parent": [("parent", None)], "son": [("child", "M")], "daughter": [("child", "F")], "child": [("child", None)],
    "brother": [("sibling", "M")], "sister": [("sibling", "F")], "sibling": [("sibling", None)], "husband": [("spouse", "M")], "wife": [("spouse", "F")], "spouse": [("spouse", None)],
    "uncle": [("parent", None), ("sibling", "M")], "aunt": [("parent", None), ("sibling", "F")], "nephew": [("sibling", None), ("child", "M")], "niece": [("sibling", None), ("child", "F")],
    "cousin": [("parent", None), ("sibling", None), ("child", None)],
}


#: Fixed words of other languages, and the English ones they mean.
ALIASES = {
    "мать": "mother", "мама": "mother", "отец": "father", "папа": "father", "сын": "son", "дочь": "daughter", "брат": "brother", "сестра": "sister", "муж": "husband", "жена": "wife",
    "дядя": "uncle", "тётя": "aunt", "тетя": "aunt", "племянник": "nephew", "племянница": "niece", "бабушка": "grandmother", "дедушка": "grandfather", "дед": "grandfather", "внук": "grandson", "внучка": "granddaughter",
    "мати": "mother", "батько": "father", "син": "son", "дочка": "daughter", "чоловік": "husband", "дружина": "wife",
    "mutter": "mother", "vater": "father", "sohn": "son", "tochter": "daughter", "bruder": "brother", "schwester": "sister", "ehemann": "husband", "ehefrau": "wife", "onkel": "uncle", "tante": "aunt",
    "neffe": "nephew", "nichte": "niece", "großmutter": "grandmother", "oma": "grandmother", "großvater": "grandfather", "opa": "grandfather", "enkel": "grandson", "enkelin": "granddaughter",
    "matka": "mother", "ojciec": "father", "syn": "son", "córka": "daughter", "siostra": "sister", "mąż": "husband", "żona": "wife", "babcia": "grandmother", "dziadek": "grandfather",
    "אמא": "mother", "אבא": "father", "בן": "son", "בת": "daughter", "אח": "brother", "אחות": "sister", "סבא": "grandfather", "סבתא": "grandmother",
}


def steps(text: str) -> list[tuple[str, str | None]] | None:
    """Steps of ``my father's mother``, ``great-grandmother``, ``wife's brother`` and the like; None if not understood.

    Single words of the other languages stand for their English ones.
    """
    out: list = []
    plain = re.sub(r"^\s*(my|the|моя|мой|meine?|moja|mój)\s+", "", text.lower().strip())
    for word in re.split(r"\s+of\s+my\s+|'s\s+|\s+", plain):
        m = re.fullmatch(r"((?:great-?\s?)*)(grand)?-?(\w+)", ALIASES.get(word, word))
        if not m or m[3] not in WORDS:
            return None
        base = WORDS[m[3]]
        up = m[1].count("great") + (1 if m[2] else 0)
        if up and base[0][0] not in ("parent", "child"):
            return None
        out += [(base[0][0], None)] * up + base
    return out


def ancestor(number: Column) -> Column:
    """(child, is_father) of an Ahnentafel number: whose parent it numbers, and whether the father; null for 1 and malformed ones."""
    n = number.cast("string").try_cast("long")
    return F.when(n > 1, F.struct(F.floor(n / 2).cast("long").alias("child"), (n % 2 == 0).alias("is_father")))
