"""Personal data in texts, by built-in expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97
for account numbers) and words nearby, before or behind a span, adjust a score.

Spark has no function that returns where a pattern matched. The matches of a
pattern and the pieces between them alternate, so running sums of their lengths
give the offsets (in code points, end exclusive).

The patterns are written so that each run of characters is read once: a match may
only begin where the character before cannot belong to it, or right behind the
match before (``\\G``). This finds the same spans as the plain patterns, and a pattern
reads a text in time proportional to its length. Offsets are listed one by one, so that
a single text with very many matches (tens of thousands) takes time that grows with
their square.

Account numbers may be followed by capitals and digits that could belong to them. So a
pattern only says where one may begin; it ends at a word end, after as many characters
as its country has, or, where the country is not in the list, after the fewest that
pass mod-97. A beginning inside a number found before is none.

Defined cases: a null text counts as empty; an empty table gives an empty table;
repeated rows give repeated rows; ``doc_id`` may be null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order in which spans are listed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:[ ]?[A-Z0-9]){11})"
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+"
# The lengths of account numbers, by the countries that have them.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

# Words that make a kind likelier when they stand near a span, and the score without and with them.
CONTEXT = {
    "email": (r"(?i)\b(e-?mail|mail|contact|write to|courriel|correo)\b", 0.9, 1.0),
    "ip": (r"(?i)\b(ip|host|server|address|addr)\b", 0.6, 0.8),
    "card": (r"(?i)\b(card|credit|visa|mastercard|amex|karte|carte|tarjeta)\b", 0.8, 1.0),
    "phone": (r"(?i)\b(phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone)\b", 0.6, 0.9),
    "iban": (r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b", 0.9, 1.0),
}
#: Code points before and behind a span in which context words are looked for.
WINDOW = 40


def proposed(text: Column, pattern: str) -> Column:
    """array<struct<s int, e int, hit string>> of a pattern's leftmost, non-overlapping matches."""

    def place(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def over(gaps: Column) -> Column:
            empty = F.array().cast("array<struct<s:int,e:int,hit:string>>")

            def step(acc: Column, i: Column) -> Column:
                hit = F.get(hits, i)
                s = acc["at"] + F.length(F.get(gaps, i))
                e = s + F.length(hit)
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), hit.alias("hit")))).alias("out"))

            start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda acc: acc["out"])

        # a one-element array names an intermediate value, so that the pattern runs once
        return F.when(F.size(hits) == 0, F.array().cast("array<struct<s:int,e:int,hit:string>>")).otherwise(F.get(F.transform(F.array(gaps), over), F.lit(0)))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), place), F.lit(0))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (capitals and digits) leaves 1 modulo 97, as ISO 7064 asks."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def accounts(text: Column) -> Column:
    """array<struct<s int, e int>> of the account numbers in a text, none inside another."""
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_COUNTRIES.items() for c in names.split() for x in (c, n)])

    def ended(x: Column) -> Column:
        part = F.substring(text, x["s"] + 1, F.lit(4 + 2 * 30 + 1))

        def valid(e: Column) -> Column:
            code = F.regexp_replace(F.substring(part, F.lit(1), e), " ", "")
            fits = F.coalesce(F.try_element_at(lengths, F.substring(part, 1, 2)) == F.length(code), F.lit(True))
            at_end = ~F.substring(part, e, F.lit(1)).eqNullSafe(F.lit(" ")) & ~F.substring(part, e + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            return F.when(at_end & fits, mod97(code)).otherwise(False)

        ends = F.sequence(F.lit(15), F.length(F.regexp_extract(part, IBAN_RUN, 0)))
        return F.struct(x["s"].alias("s"), (x["s"] + F.get(F.filter(ends, valid), F.lit(0))).alias("e"))

    def apart(acc: Column, x: Column) -> Column:
        free = x["s"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    found = F.filter(F.transform(proposed(text, IBAN), ended), lambda x: x["e"].isNotNull())
    return F.aggregate(found, F.array().cast("array<struct<s:int,e:int>>"), apart)


def _ip_ok(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _passing(valid):
    return lambda x: valid(x["hit"])


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``found``: array<struct<kind, s, e, score>>, by kind in the order listed, then by place."""
    body = F.coalesce(F.col(text), F.lit(""))
    rules = [
        ("email", EMAIL, F.contains(body, F.lit("@")), lambda h: F.lit(True)),
        ("ip", IP, body.rlike(r"[0-9]\.[0-9]"), _ip_ok),
        ("card", CARD, body.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), lambda h: luhn(digits(h))),
        ("phone", PHONE, F.contains(body, F.lit("+")), lambda h: F.length(digits(h)).between(8, 15)),
    ]
    rules = [(kind, hint, F.filter(proposed(body, pattern), _passing(valid))) for kind, pattern, hint, valid in rules]
    rules.append(("iban", body.rlike(r"[A-Z]{2}[0-9]{2}"), accounts(body)))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")

    def confirmed(kind: str, hint: Column, places: Column) -> Column:
        words, plain, near = CONTEXT[kind]

        def scored(x: Column) -> Column:
            before = F.substring(body, F.greatest(x["s"] - WINDOW, F.lit(0)) + 1, F.least(x["s"], F.lit(WINDOW)))
            behind = F.substring(body, x["e"] + 1, F.lit(WINDOW))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(before.rlike(words) | behind.rlike(words), near).otherwise(plain).cast("double").alias("score"))

        return F.when(hint, F.transform(places, scored)).otherwise(none)

    parts = [confirmed(*rule) for rule in rules]
    return docs.withColumn("found", F.concat(*parts))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts, a digest of the base spans and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = spans(docs).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("email", "ip", "card", "phone")),
        F.sha2(listed(F.filter("found", lambda x: x["kind"] != "iban")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        count("iban"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
