"""Vocabularies of the dictionary notations: marks, codes and names that files use."""

from __future__ import annotations

# Russian parts of speech by the keys "marks type" of an article, in the order of their codes.
RUSSIAN_POS = {
    1: ["# нсв"], 2: ["# нсв_нп"], 3: ["# св"], 4: ["# св_нп"], 5: ["# св-нсв"], 6: ["# св-нсв_нп"],
    7: ["# м", "м мп", "м ммс"], 8: ["# мо", "мо мпо", "мо момс"], 9: ["# м//мо", "# мо//м"],
    10: ["м с"], 11: ["мо жо"], 12: ["мо со"],
    13: ["# ж", "ж жп", "ж жмс"], 14: ["# жо", "жо жпо"], 15: ["# ж//жо", "# жо//ж"],
    16: ["# с", "с сп", "с смс"], 17: ["# со", "со спо"], 18: ["# с//со", "# со//с"],
    19: ["м//ж ж"], 20: ["# мо-жо", "# мо//жо", "мо-жо жо", "мо//жо жо"], 21: ["# м//с", "# с//м"], 22: ["мо//со со"], 23: ["# ж//с", "# с//ж"],
    25: ["# п"], 26: ["# г-п"], 27: ["п мс"], 28: ["мс-п мсп", "# мс-п"],
    29: ["# мс"], 30: ["# мсм"], 31: ["# мсж"], 32: ["# мсс"],
    33: ["# числ."], 34: ["# числ._2"], 35: ["# числ._с"], 36: ["числ.-п мс", "числ.-п мсп", "числ.-п мс-п"],
    37: ["# и"], 38: ["# им", "им иж"], 39: ["# иж"], 40: ["# ом"], 41: ["# ож"], 42: ["# ф", "ф фп", "ф фж"],
    43: ["# г", "# гп"], 44: ["# гм", "# гмп"], 45: ["# гж", "# гжп"], 46: ["# гс", "# гсп"],
    48: ["# вводн."], 49: ["# межд."], 50: ["# предик."], 51: ["# предл."], 52: ["# союз"], 53: ["# част."], 54: ["# н"],
    55: ["# сокр._сущ."], 56: ["# сокр._прил."], 57: ["# сокр._вводн."], 58: ["# сравн."], 59: ["# АБ"], 60: ["# аб"], 61: ["# #1"], 62: ["# #2"],
}
# Those that only have a plural, and conjunctions that join equals; their words carry the bit 0x40 beside the code.
RUSSIAN_PLURAL_POS = {
    7: ["мн. м", "# мн._от_м", "мн._неод. мп"], 8: ["мн. мо", "мн._одуш. мпо"],
    13: ["мн. ж", "# мн._от_ж"], 14: ["мн. жо"], 16: ["мн. с", "# мн._от_с", "мн._от_с сп"], 17: ["мн. со"],
    24: ["мн. ж//м", "мн. м//ж"], 29: ["# мс_мн."], 47: ["# мн._от_гж", "# мн._от_гм", "мн. гп"], 52: ["# союз_соч."],
}
# The first code of words that are not inflected, prepositions, and codes of what is declined by gender.
UNINFLECTED, PREPOSITION, BY_GENDER = 48, 51, (25, 26, 27, 28, 34, 36, 42, 52)

# Comment marks and their bits; the mark and letters of a preposition's cases.
FLAG_MARKS = {"{превосх.}": 0x0080, "{исчисл.}": 0x0100, "{разг.}": 0x0200, "{руг.}": 0x0400}
CASE_MARK, CASE_LETTERS = "ШП:", "ИРДВТП"

# Letters that conditions of alternations and accent tests speak of.
VOWELS, HISSING, VELAR = "аеиоуыэюя", "жцчшщ", "кгх"
SIBILANTS, CONSONANTS, ACCENT_VOWELS = "жчшщ", "бвгджзклмнпрстфхцчшщ", "аеоуыэюя"

# Russian grammar tokens: kept grammar bits, set grammar bits, kept flags, set flags.
ALL, FORM_BITS, TENSE_FORM = 0xFFFF, 0x8FFF, 0x0067
RUSSIAN_TOKENS = {
    "В": (FORM_BITS, 3 << 12, 255, 3), "Вн": (FORM_BITS, 3 << 12, 252, 2), "Во": (FORM_BITS, 3 << 12, 252, 1),
    "Д": (FORM_BITS, 2 << 12, 255, 3), "И": (FORM_BITS, 0, 255, 3), "П": (FORM_BITS, 5 << 12, 255, 3), "П2": (FORM_BITS, 7 << 12, 255, 3),
    "Р": (FORM_BITS, 1 << 12, 255, 3), "Р2": (FORM_BITS, 6 << 12, 255, 3), "Т": (FORM_BITS, 4 << 12, 255, 3),
    "время Б": (0, 3, 255, 3), "время Н": (0, 4, 255, 3), "время П": (0, 5, 255, 3), "вф": (ALL, 0x8000, 255, 0),
    "деепр": (7, 0x60, 255, 3), "действ": (7, 0x20, 255, 3), "затрудн": (ALL, 0, 255, 4), "инфинитив": (0, 1, 0, 3),
    "кф": (0x0E67, 0x0100, 255, 3), "лицо 1": (7, 0x08, 255, 3), "лицо 2": (7, 0x10, 255, 3), "лицо 3": (7, 0x18, 255, 3),
    "нр": (0, 0x40, 255, 3), "повел": (0, 2, 255, 3), "проф": (ALL, 0, 255, 0), "род": (0x0867, 0, 255, 0),
    "род ж": (TENSE_FORM, 2 << 9, 255, 0), "род м": (TENSE_FORM, 1 << 9, 255, 0), "род с": (TENSE_FORM, 3 << 9, 255, 0),
    "соед": (ALL, 0, 255, 8), "ср": (0, 0x80, 255, 3), "страд": (7, 0x40, 255, 3),
    "число": (TENSE_FORM, 0, 255, 3), "число Е": (TENSE_FORM, 0, 255, 3), "число М": (TENSE_FORM, 0x0800, 255, 3),
}
# Ukrainian grammar tokens, likewise.
UKRAINIAN_TOKENS = {
    "act": (7, 0x20, 255, 3), "face 1": (7, 0x08, 255, 3), "face 2": (7, 0x10, 255, 3), "face 3": (7, 0x18, 255, 3),
    "fem": (TENSE_FORM, 2 << 9, 255, 0), "fut": (0, 3, 255, 3), "ger": (7, 0x60, 255, 3), "imp": (0, 2, 255, 3), "inf": (0, 1, 0, 3),
    "msc": (TENSE_FORM, 1 << 9, 255, 0), "nwt": (TENSE_FORM, 3 << 9, 255, 0), "prs": (0, 4, 255, 3), "pst": (0, 5, 255, 3), "psv": (7, 0x40, 255, 3),
    "sing": (TENSE_FORM, 0, 255, 3), "plur": (TENSE_FORM, 0x0800, 255, 3),
    "В": (FORM_BITS, 3 << 12, 255, 3), "Вн": (FORM_BITS, 3 << 12, 252, 2), "Во": (FORM_BITS, 3 << 12, 252, 1), "Д": (FORM_BITS, 2 << 12, 255, 3),
    "З": (FORM_BITS, 6 << 12, 255, 3), "И": (FORM_BITS, 0, 255, 3), "П": (FORM_BITS, 5 << 12, 255, 3), "Р": (FORM_BITS, 1 << 12, 255, 3), "Т": (FORM_BITS, 4 << 12, 255, 3),
    "вф": (ALL, 0x8000, 255, 0),
}

# Names of code pages, whatever their case.
CODE_PAGES = {
    "windows-1251": "cp1251", "windows": "cp1251", "1251": "cp1251", "win-1251": "cp1251", "win": "cp1251", "windows 1251": "cp1251", "win 1251": "cp1251", "ansi": "cp1251",
    "koi-8": "koi8-r", "koi8": "koi8-r", "20866": "koi8-r", "dos": "cp866", "oem": "cp866", "866": "cp866",
    "28595": "iso8859-5", "iso-88595": "iso8859-5", "iso-8859-5": "iso8859-5", "10007": "mac-cyrillic", "mac": "mac-cyrillic",
    "65001": "utf-8", "utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16", "utf16": "utf-16",
}


def pos_rows() -> list[tuple[str, int]]:
    """(key, word information) of every Russian part of speech."""
    plural = [(k, code | 0x40) for code, keys in RUSSIAN_PLURAL_POS.items() for k in keys]
    return [(k, code) for code, keys in RUSSIAN_POS.items() for k in keys] + plural
