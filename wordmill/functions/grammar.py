"""Packed grammar of Russian words, as bit expressions on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks of grammar words, and what cases count as in form ids.
REFLEXIVE, CASE, PLURAL, GENDER, SHORT, COMPARATIVE, PARTICIPLE, ADVERB, PERSON, TENSE = 0x8000, 0x7000, 0x0800, 0x0600, 0x0100, 0x0080, 0x0060, 0x0040, 0x0018, 0x0007
ANIMATE, INANIMATE, HARD, JOINING = 1, 2, 4, 8
PLURAL_ONLY, SUPERLATIVE, COUNTABLE, INFORMAL, OBSCENE = 0x0040, 0x0080, 0x0100, 0x0200, 0x0400
INFINITIVE, IMPERATIVE, FUTURE, PRESENT, PAST = 1, 2, 3, 4, 5
# Kinds of alternation, by number.
VERB_MIX, MASCULINE, MASCULINE_ANIMATE, MASCULINE_MIXED, FEMININE, FEMININE_ANIMATE, FEMININE_MIXED, ADJECTIVE_MIX = range(1, 9)
# Parts of speech that are adjectives, and those whose lexemes are capitalized at least (1) or throughout (2).
ADJECTIVES = (25, 26, 27, 28, 34, 36, 42)
NAMES, ABBREVIATION = (37, 47), 59


def bits(x: Column, mask: int) -> Column:
    """A field of a packed word, shifted down."""
    shift = (mask & -mask).bit_length() - 1
    return F.shiftright(x.bitwiseAND(F.lit(mask)), shift)


def pos(wd: Column) -> Column:
    return x_and(wd, 0x3F)


def x_and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def is_verb(wd: Column) -> Column:
    return pos(wd).between(1, 6)


def is_adjective(wd: Column) -> Column:
    return pos(wd).isin(*ADJECTIVES)


def is_participle(gr: Column) -> Column:
    return bits(gr, PARTICIPLE) != 0


def min_capitals(wd: Column) -> Column:
    return F.when(pos(wd).between(*NAMES), 1).when(pos(wd) == ABBREVIATION, 2).otherwise(0)


def case_number(gr: Column, flags: Column) -> Column:
    """0 nominative to 2 dative as packed; the accusative is 3 if it may be inanimate, else 4; later cases follow one higher."""
    c = bits(gr, CASE)
    return F.when(c < 3, c).when(c == 3, F.when(x_and(flags, INANIMATE) != 0, 3).otherwise(4)).otherwise(c + 1)


def pack_noun(gr: Column, flags: Column) -> Column:
    return case_number(gr, flags) + 10 * bits(gr, PLURAL)


def gender_number(gr: Column) -> Column:
    """0 masculine, 1 feminine, 2 neuter, 3 plural."""
    return F.when(bits(gr, PLURAL) != 0, 3).otherwise(bits(gr, GENDER) - 1)


def _declined(gr: Column, flags: Column) -> Column:
    return gender_number(gr) * 8 + F.when(bits(gr, SHORT) != 0, 7).otherwise(case_number(gr, flags))


def pack_adjective(gr: Column, flags: Column) -> Column:
    return F.when(bits(gr, ADVERB) != 0, 65).when(bits(gr, COMPARATIVE) != 0, 64).otherwise(_declined(gr, flags) + 32 * bits(gr, REFLEXIVE))


def pack_verb(gr: Column, flags: Column) -> Column:
    """Blocks of form ids by tense: infinitive 0, imperative 2, future 6, present 18 and its participles 30, past 128 and its participles 136."""
    reflexive, kind, tense = bits(gr, REFLEXIVE), bits(gr, PARTICIPLE), bits(gr, TENSE)
    number = reflexive * 2 + bits(gr, PLURAL)
    personal = (bits(gr, PERSON) - 1) * 4 + number
    participle = F.when(kind == 1, reflexive * 32 + _declined(gr, flags)).when(kind == 2, 64 + _declined(gr, flags)).otherwise(96 + reflexive)
    return (
        F.when(tense == INFINITIVE, reflexive)
        .when(tense == IMPERATIVE, 2 + number)
        .when(tense == FUTURE, 6 + personal)
        .when(tense == PRESENT, F.when(kind == 0, 18 + personal).otherwise(30 + participle))
        .when(tense == PAST, F.when(kind == 0, 128 + reflexive * 4 + gender_number(gr)).otherwise(136 + participle))
        .otherwise(255)
    )


def pack(wd: Column, gr: Column, flags: Column) -> Column:
    """The form id of a grammar word."""
    return F.when(is_verb(wd), pack_verb(gr, flags)).when(is_adjective(wd), pack_adjective(gr, flags)).otherwise(pack_noun(gr, flags))


def unpack_noun(form: Column, plural_only: Column) -> Column:
    """The grammar word of a noun's form id; -1 where there is no such form."""
    case = form % 10
    packed = F.when(case <= 3, case).otherwise(case - 1)
    out = F.shiftleft(packed, 12) + F.when(form >= 10, PLURAL).otherwise(0)
    return F.when((form < 0) | (form > 17) | (case > 8) | (plural_only & (form < 10)), -1).otherwise(out)


def unpack_case(number: Column) -> Column:
    """The case bits of a case number; 3 and 4 are the accusative of things and of beings."""
    return F.shiftleft(F.when(number <= 3, number).otherwise(number - 1), 12)


def _undeclined(number: Column) -> Column:
    """Gender and case, or the short form, of a number below 32."""
    gender, case = F.shiftright(number, 3), number % 8
    return F.when(gender == 3, PLURAL).otherwise(F.shiftleft(gender + 1, 9)) + F.when(case == 7, SHORT).otherwise(unpack_case(case))


def _personal(number: Column) -> Column:
    return F.shiftleft(F.shiftright(number, 2) + 1, 3) + _number(number % 4)


def _number(two: Column) -> Column:
    return F.when(two >= 2, REFLEXIVE).otherwise(0) + F.when(two % 2 == 1, PLURAL).otherwise(0)


def _participles(number: Column) -> Column:
    reflexive = lambda on: F.when(on, REFLEXIVE).otherwise(0)
    return (
        F.when(number >= 96, (3 << 5) + reflexive(number % 2 == 1))
        .when(number >= 64, (2 << 5) + _undeclined(number - 64))
        .otherwise((1 << 5) + reflexive(number >= 32) + _undeclined(number % 32))
    )


def unpack_verb(form: Column) -> Column:
    """The grammar word of a verb's form id, by the blocks of ``pack_verb``; -1 where there is no such form."""
    past = F.when(form % 4 == 3, PLURAL).otherwise(F.shiftleft(form % 4 + 1, 9)) + F.when(form >= 132, REFLEXIVE).otherwise(0)
    return (
        F.when((form < 0) | (form > 233), -1)
        .when(form < 2, INFINITIVE + F.when(form == 1, REFLEXIVE).otherwise(0))
        .when(form < 6, IMPERATIVE + _number(form - 2))
        .when(form < 18, FUTURE + _personal(form - 6))
        .when(form < 30, PRESENT + _personal(form - 18))
        .when(form < 128, PRESENT + _participles(form - 30))
        .when(form < 136, PAST + past)
        .otherwise(PAST + _participles(form - 136))
    )


def unpack(wd: Column, form: Column) -> Column:
    """The grammar word of a form id; -1 where the part of speech has no such form."""
    plural_only = x_and(wd, PLURAL_ONLY) != 0
    return F.when(is_verb(wd), unpack_verb(form)).when(is_adjective(wd), unpack_adjective(form)).otherwise(unpack_noun(form, plural_only))


def unpack_flags(wd: Column, form: Column) -> Column:
    """Animate and inanimate bits of a form id: one of them for an accusative that only one may have."""
    def declined(n: Column) -> Column:
        case = n % 8
        return F.when(case == 3, INANIMATE).when(case == 4, ANIMATE).otherwise(ANIMATE | INANIMATE)

    both = F.lit(ANIMATE | INANIMATE)
    parts = lambda n: F.when(n >= 96, both).when(n >= 64, declined(n - 64)).otherwise(declined(n % 32))
    verb = F.when(form.between(30, 127), parts(form - 30)).when(form.between(136, 233), parts(form - 136)).otherwise(both)
    noun = F.when(form % 10 == 3, INANIMATE).when(form % 10 == 4, ANIMATE).otherwise(both)
    found = F.when(is_verb(wd), verb).when(is_adjective(wd), F.when(form >= 64, both).otherwise(declined(form % 32))).otherwise(noun)
    return F.when(unpack(wd, form) == -1, -1).otherwise(found)


def unpack_adjective(form: Column) -> Column:
    base = form % 32
    gender, case = F.shiftright(base, 3), base % 8
    packed = F.when(case <= 3, case).otherwise(case - 1)
    number = F.when(gender == 3, PLURAL).otherwise(F.shiftleft(gender + 1, 9))
    out = number + F.when(case == 7, SHORT).otherwise(F.shiftleft(packed, 12)) + F.when(form.between(32, 63), REFLEXIVE).otherwise(0)
    return F.when(form == 64, COMPARATIVE).when(form == 65, ADVERB).when((form < 0) | (form > 65), -1).otherwise(out)


def only_plural(gr: Column) -> Column:
    return bits(gr, PLURAL) != 0


def in_level(mask: Column, level: Column) -> Column:
    """Whether a reading's level is one of those that an alternation holds for."""
    return (level >= 1) & (F.call_function("getbit", mask.cast("int"), F.greatest(level - 1, F.lit(0)).cast("int")) == 1)


def swap_level(kind: Column, wd: Column, gr: Column, flags: Column) -> Column:
    """Which level of a stem's alternation a reading takes: 1, 2 or 3."""
    tense, verb_kind, form = bits(gr, TENSE), bits(gr, PARTICIPLE), bits(gr, CASE) * 2 + bits(gr, PLURAL)
    passive_past = (tense == PAST) & (verb_kind == 2)
    by_person = F.when(passive_past, 3).when((bits(gr, PERSON) == 1) & (bits(gr, PLURAL) == 0), 2).otherwise(1)
    by_stem = F.when(passive_past, 3).when(tense.isin(PAST, INFINITIVE), 1).otherwise(2)
    by_present = F.when(tense.isin(PRESENT, FUTURE), 2).otherwise(1)
    sort = F.shiftright(wd.bitwiseAND(F.lit(0x1800)), 11)
    verb = F.when(sort == 0, by_person).when(sort == 1, by_stem).when(sort == 2, by_present).otherwise(1)
    # singular nominative is 0, singular accusative 6, plural genitive 3, plural accusative 7
    masculine, masculine_animate = F.when(form.isin(0, 6), 1).otherwise(2), F.when(form == 0, 1).otherwise(2)
    feminine, feminine_animate = F.when(form == 3, 2).otherwise(1), F.when(form.isin(3, 7), 2).otherwise(1)
    live = x_and(flags, ANIMATE) != 0
    adjective = F.when(gr == COMPARATIVE, 3).when(gr == (1 << 9 | SHORT), 2).otherwise(1)
    return (
        F.when(kind == VERB_MIX, verb)
        .when((kind == MASCULINE) | ((kind == MASCULINE_MIXED) & ~live), masculine)
        .when(kind.isin(MASCULINE_ANIMATE, MASCULINE_MIXED), masculine_animate)
        .when((kind == FEMININE) | ((kind == FEMININE_MIXED) & ~live), feminine)
        .when(kind.isin(FEMININE_ANIMATE, FEMININE_MIXED), feminine_animate)
        .when(kind == ADJECTIVE_MIX, adjective)
        .otherwise(1)
    )


def swap_level_ukrainian(kind: Column, variant: Column, wd: Column, gr: Column, flags: Column) -> Column:
    """The level for Ukrainian words. ``variant`` (0, 1 or 2) is what the word's alternation says of its way."""
    tense, verb_kind, form, sort = bits(gr, TENSE), bits(gr, PARTICIPLE), bits(gr, CASE) * 2 + bits(gr, PLURAL), pos(wd)
    person, plural = bits(gr, PERSON), bits(gr, PLURAL)
    changes = sort.isin(24, 25) | (sort.isin(22, 23, 26, 27) & (tense == PRESENT))
    by_change = F.when(changes, 2).otherwise(1)
    first = (person == 1) & (plural == 0)
    passive_past = (tense == PAST) & (verb_kind == 2)
    all_forms = F.when(tense.isin(PAST, INFINITIVE), 1).when(tense == IMPERATIVE, 2).otherwise(by_change)
    only_first = F.when(passive_past, 3).when(first, by_change).otherwise(1)
    outer = F.when(passive_past, 3).when(tense.isin(INFINITIVE, PAST, IMPERATIVE), 1).when(verb_kind != 0, 2).when(first | ((person == 3) & (plural == 1)), by_change).otherwise(1)
    verb = F.when(variant == 0, all_forms).when(variant == 1, only_first).otherwise(outer)
    # case * 2 + plural: 0 nominative, 2 genitive, 4 dative, 6 accusative, 8 instrumental, 10 locative, 12 vocative
    plain = variant == 0
    thing = F.when(plain, F.when(form.isin(0, 6), 1).otherwise(2)).otherwise(F.when(form == 10, 2).otherwise(1))
    being = F.when(plain, F.when(form == 0, 1).otherwise(2)).otherwise(F.when(form == 12, 2).otherwise(1))
    third = F.when(form.isin(4, 10), 3).otherwise(1)
    other = F.when(form == 8, 2).when(form.isin(2, 6, 12), 1).otherwise(3)
    feminine = F.when(plain, F.when(form == 3, 2).otherwise(third)).otherwise(other)
    feminine_being = F.when(plain, F.when(form.isin(3, 7), 2).otherwise(third)).otherwise(other)
    live = x_and(flags, ANIMATE) != 0
    return (
        F.when(kind == VERB_MIX, verb)
        .when((kind == MASCULINE) | ((kind == MASCULINE_MIXED) & ~live), thing)
        .when(kind.isin(MASCULINE_ANIMATE, MASCULINE_MIXED), being)
        .when((kind == FEMININE) | ((kind == FEMININE_MIXED) & ~live), feminine)
        .when(kind.isin(FEMININE_ANIMATE, FEMININE_MIXED), feminine_being)
        .otherwise(1)
    )


def dictionary_form(wd: Column, gr: Column, keep_participles: bool = False) -> Column:
    """The grammar word of the dictionary form: infinitive, masculine nominative, or plural where there is no singular."""
    plain = F.when(is_adjective(wd), 1 << 9).otherwise(0) + F.when(x_and(wd, PLURAL_ONLY) != 0, PLURAL).otherwise(0)
    verb = F.when(is_participle(gr), x_and(gr, TENSE | PARTICIPLE) + (1 << 9)).otherwise(INFINITIVE) if keep_participles else F.lit(INFINITIVE)
    return F.when(is_verb(wd), verb).otherwise(plain)


def fold_future(form: Column) -> Column:
    """Future forms of a verb count as present ones."""
    return F.when(form.between(6, 17), form + 12).otherwise(form)


def coarse_pos(wd: Column) -> Column:
    """Parts of speech as statistics count them: verbs 1, nouns by gender 7, 13 and 16, adjectives 25, names as they are, 0 for all else."""
    p = pos(wd)
    named = p.between(38, 42) | p.between(44, 46)
    return F.when(p.between(1, 6), 1).when(p.between(7, 9), 7).when(p.between(13, 15), 13).when(p.between(16, 18), 16).when(p.between(25, 26), 25).when(named, p).otherwise(0)


def token_algebra(expression: Column, start: Column, vocabulary: dict[str, tuple[int, int]]) -> Column:
    """Applies 'a|b|...' to a grammar word: each token keeps a mask and sets a value."""
    masks = F.create_map(*[F.lit(x) for k, (m, _) in vocabulary.items() for x in (k, m)])
    values = F.create_map(*[F.lit(x) for k, (_, v) in vocabulary.items() for x in (k, v)])
    return F.aggregate(F.split(expression, r"\|"), start, lambda g, t: g.bitwiseAND(F.element_at(masks, F.trim(t))).bitwiseOR(F.element_at(values, F.trim(t))))
