"""What a dictionary's forms become on their way to paradigm classes, and the tuning of score weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.sources import notation


def selected(forms: DataFrame, mandatory: list[int], optional: list[int] = ()) -> DataFrame:
    """Forms of the given ids of lexemes that have every mandatory one and no hyphen in any."""
    own = forms.where(F.col("form_id").isin(*mandatory, *optional))
    has = own.groupBy("lexeme_id").agg(F.collect_set("form_id").alias("ids"), F.max(F.contains("form", F.lit("-"))).alias("hyphen"))
    whole = has.where(~F.col("hyphen") & (F.size(F.array_except(F.array(*map(F.lit, mandatory)), F.col("ids"))) == 0)).select("lexeme_id")
    return own.join(whole, "lexeme_id", "left_semi")


def expanded(forms: DataFrame, as_well: dict[int, int]) -> DataFrame:
    """``forms`` and, for each form id in ``as_well``, the same form under another id; chains are not followed."""
    second = F.create_map(*[F.lit(x) for kv in as_well.items() for x in kv])
    ids = F.filter(F.array(F.col("form_id"), F.element_at(second, F.col("form_id"))), lambda x: x.isNotNull())
    return forms.withColumn("form_id", F.explode(ids))


def renumbered(forms: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """Form ids replaced by others, where they are in ``numbers``."""
    second = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    return forms.withColumn("form_id", F.coalesce(F.element_at(second, F.col("form_id")), F.col("form_id")))


def _ends(form: Column, last: str, before: str, at: int = 1) -> Column:
    """Whether one of ``last`` stands ``at`` letters from the end, behind one of ``before``."""
    return F.substring(form, -at, 1).isin(*last) & F.substring(form, -at - 1, 1).isin(*before)


def stressed(pos: Column, form_id: Column, form: Column) -> Column:
    """Whether a form shows that its paradigm is stressed on the ending."""
    noun = (
        F.when(form_id == 0, _ends(form, "й", notation.ACCENT_VOWELS))
        .when(form_id == 5, _ends(form, "о", notation.SIBILANTS, 2))
        .when(form_id == 10, _ends(form, "а", notation.CONSONANTS))
        .otherwise(False)
    )
    return F.when(pos.isin(7, 38, 40, 42), noun).when(pos == 25, (form_id == 0) & form.endswith("ой")).otherwise(False)


def accents(forms: DataFrame) -> DataFrame:
    """lexeme_id, accent: whether any form of a lexeme(lexeme_id, pos, form_id, form) is stressed on the ending."""
    return forms.groupBy("lexeme_id").agg(F.max(stressed(F.col("pos"), F.col("form_id"), F.col("form"))).alias("accent"))


def counted_lines(lines: DataFrame) -> DataFrame:
    """pos, form_id, n of lines 'pos, form:count, form:count, ...' in all; uninflected forms (255) are left out."""
    cut = lines.select(F.trim(F.split("line", ",", 2)[0]).cast("int").alias("pos"), F.explode(F.split(F.split("line", ",", 2)[1], ",")).alias("e"))
    parts = cut.select("pos", F.trim(F.split("e", ":")[0]).cast("int").alias("form_id"), F.trim(F.split("e", ":")[1]).cast("long").alias("n"))
    return parts.where("form_id <> 255").groupBy("pos", "form_id").agg(F.sum("n").alias("n"))


def rank_of(power: Column, ending_len: Column, weights: list[float]) -> Column:
    """A hypothesis's rank from 0 to 1: a class's power, and a curve of the ending's length with three weights."""
    floor, steep, middle = weights
    curve = F.sin(F.atan(F.lit(steep) * (ending_len - F.lit(middle))))
    return power * (floor + (1.0 - floor) * curve)


def loss(samples: DataFrame, candidates: list[list[float]]) -> list[float]:
    """For each candidate's weights the loss over samples(n, power, ending_len, hit): one pass for all of them."""
    terms = []
    for i, weights in enumerate(candidates):
        rank = rank_of(F.col("power"), F.col("ending_len"), weights)
        terms.append(F.sum(F.col("n") * F.when(F.col("hit") == 1, 1.0 - rank).otherwise(rank)).alias(f"c{i}"))
    row = samples.agg(*terms).first()
    return [x if x is not None else 0.0 for x in row]


def tuned(samples: DataFrame, start: list[float], low: list[float], high: list[float], step: float = 0.1, least: float = 1e-3, rounds: int = 40) -> tuple[list[float], float]:
    """Weights that lower the loss, by descent along a numeric gradient.

    A step that doesn't lower the loss is halved; weights stay between ``low`` and
    ``high``. Each round is one aggregation over the samples, which are never collected.
    """
    weights, best = list(start), loss(samples, [start])[0]
    for _ in range(rounds):
        if step < least:
            break
        moved = [[w + (least if i == k else 0.0) for i, w in enumerate(weights)] for k in range(len(weights))]
        slope = [(x - best) / least for x in loss(samples, moved)]
        size = math.sqrt(sum(g * g for g in slope))
        if size == 0:
            break
        tries = [[min(max(w - step / 2**h * g / size, a), b) for w, g, a, b in zip(weights, slope, low, high)] for h in range(4)]
        found = min(zip(loss(samples, tries), range(4)))
        if found[0] < best:
            best, weights, step = found[0], tries[found[1]], step / 2 ** found[1]
        else:
            step /= 16
    return weights, best
