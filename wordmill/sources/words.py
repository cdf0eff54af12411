"""A small lexicon of our own, in the article notation that the loader reads.

A line is ``stem|ending 0|ending 1|...``, the part of speech, ``LID:`` and a number, and
perhaps ``post:`` and a postfix, set apart by tabs. An ending ``0`` is empty, ``-`` is a
form that doesn't exist, ``/`` sets alternatives apart; no ``|`` at all is a word that
isn't inflected.
"""

from __future__ import annotations

# Codes of parts of speech.
POS = {
    "N": 1, "V": 2, "A": 3, "ADV": 4, "NUM": 5, "INT": 6, "CONJ": 7, "PREP": 8, "REFL": 9, "PERS": 10,
    "INDEF": 11, "POSS": 12, "DEMO": 13, "REL": 14, "ART": 15, "PARTICLE": 16, "INTER": 17, "NAME": 18, "V_BE": 19,
}

REGULAR_VERBS = "click view sign order ship open close return check call ask look need add end start help play show seem turn want work act"
E_VERBS = "purchase use like move live change release include receive license place close require state"
NOUNS = "order error event page user part customer supplier region nation widget bolt gear thing word line claim account deposit request package pattern"
ADJECTIVES = "small light dark bright cool warm soft hard green black deep slow quick"
PLAIN = {
    "ART": "the a an",
    "CONJ": "and or but if as than that",
    "PREP": "of to in for on with by at from into under",
    "PERS": "he she it they we you him her them us",
    "DEMO": "this these those",
    "REL": "which who whom",
    "INTER": "what when where why how",
    "INDEF": "all any each some none",
    "PARTICLE": "not",
    "ADV": "here there now then only also very",
}


def lines() -> list[str]:
    """All articles, numbered from 1000 on; each part of speech starts a new thousand."""
    out = ["|be|am|is|are|was|were|been\tV_BE\tLID:100"]

    def add(first: int, tag: str, articles: list[str], post: str = "") -> None:
        out.extend(f"{a}\t{tag}\tLID:{first + i}{post}" for i, a in enumerate(articles))

    add(1000, "V", [f"{w}|0|s|ing|ed|ed" for w in REGULAR_VERBS.split()])
    add(2000, "V", [f"{w[:-1]}|e|es|ing|ed|ed" for w in E_VERBS.split()])
    add(3000, "V", ["|go|goes|going|went|gone", "|do|does|doing|did|done", "ha|ve|s|ving|d|d", "s|ee|ees|eeing|aw|een", "stop|0|s|ping|ped|ped", "sa|y|ys|ying|id|id"])
    add(4000, "N", [f"{w}|0|s|'s|s'" for w in NOUNS.split()])
    add(4500, "N", ["m|an|en|an's|en's", "compan|y|ies|y's|ies'"])
    add(4600, "N", ["father|0|-", "mother|0|-"], "\tpost:-in-law")
    add(5000, "A", [f"{w}|0|er|est" for w in ADJECTIVES.split()])
    add(5500, "A", ["red|0|der|dest", "larg|e|er|est", "free|0|r|st", "blu|e|er|est"])
    add(6000, "ADV", ["f|ar|arther/urther|arthest/urthest", "soon|0|er|est"])
    add(7000, "NAME", ["Andrew|0|'s|-|-", "Anna|0|'s|-|-", "New-York|0|'s", "Stoke-on-Trent|0|'s", "TPC|0"])
    for k, (tag, words) in enumerate(PLAIN.items()):
        add(8000 + 100 * k, tag, words.split())
    return out
