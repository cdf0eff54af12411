"""From article lines to tables of articles, word forms and lexemes.

``articles``: lexeme_id, raw, spec, pos, postfix.
``forms``: lexeme_id, pos, form_id, ending, form, surface, lemma, min_cap.
``lexemes``: lexeme_id, pos, lemma, min_cap, n_forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmill.functions.text import with_capitals
from wordmill.sources import words
from wordmill.sources.notation import CODE_PAGES

#: The form id of a word that isn't inflected.
PLAIN_FORM = 255

def article_lines(spark: SparkSession, paths: str | list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Lines of article files, or of the lexicon that comes with the package."""
    if paths is None:
        return spark.createDataFrame([(x,) for x in words.lines()], "line string")
    if encoding.upper() == "UTF-8":
        return spark.read.text(paths).withColumnRenamed("value", "line")
    # bytes as Latin-1, then each of the upper half by the code page
    upper = bytes(range(128, 256))
    read = spark.read.options(encoding="iso-8859-1", sep="\u0001", quote="").schema("line string").csv(paths)
    return read.select(F.translate("line", upper.decode("latin-1"), upper.decode(CODE_PAGES.get(encoding.lower(), encoding), "replace")).alias("line"))


def parse(lines: DataFrame, *keep: str) -> DataFrame:
    """The columns in ``keep``, line, lexeme_id, raw, spec, pos, postfix and ``reject``: null, or why a line is no article."""
    line = F.trim(F.col("line"))
    number = F.regexp_extract(line, r"[\t ]LID:([0-9]+)", 1)
    body = F.regexp_extract(line, r"^([^\t ]+)[\t ]+([A-Z_]+)[\t ]", 1)
    tag = F.regexp_extract(line, r"^([^\t ]+)[\t ]+([A-Z_]+)[\t ]", 2)
    pos = F.create_map(*[F.lit(x) for kv in words.POS.items() for x in kv])
    reason = (
        F.when(line == "", "blank")
        .when(line.startswith("//"), "comment")
        .when(number == "", "no number")
        .when(F.regexp_replace(number, "^0+", "") == "", "number 0")
        .when(F.element_at(pos, tag).isNull(), "part of speech")
    )
    ok = reason.isNull()
    return lines.select(
        *keep,
        "line",
        F.when(ok, number.try_cast("long")).alias("lexeme_id"),
        F.when(ok, F.regexp_extract(body, r"^([^|]*)", 1)).alias("raw"),
        F.when(ok & body.contains("|"), F.regexp_extract(body, r"^[^|]*\|(.*)$", 1)).alias("spec"),
        F.when(ok, F.element_at(pos, tag)).alias("pos"),
        F.when(ok, F.regexp_extract(line, r"post:\s*(\S+)", 1)).alias("postfix"),
        reason.alias("reject"),
    )


def articles(lines: DataFrame) -> DataFrame:
    return parse(lines).where("reject is null").select("lexeme_id", "raw", "spec", "pos", "postfix")


def rejects(lines: DataFrame) -> DataFrame:
    return parse(lines).where("reject is not null and reject <> 'blank'").select("line", "reject")


def write_rejects(lines: DataFrame, path: str) -> None:
    """What is no article, as lines of text; a folder without lines if there is none."""
    rejects(lines).select("line").write.text(path)


def upper_half(page: str) -> str:
    """The 128 characters of a single-byte code page beyond ASCII, in order; unassigned ones as U+FFFD."""
    return bytes(range(128, 256)).decode(CODE_PAGES.get(page.lower(), page), "replace")


def to_code_page(text: Column, page: str) -> Column:
    """The bytes of a text in a code page of CODE_PAGES; what it lacks becomes a question mark."""
    name = CODE_PAGES.get(page.lower(), page)
    if name in ("utf-8", "utf-16"):
        return F.encode(text, name.upper())
    upper, latin = upper_half(page), bytes(range(128, 256)).decode("latin-1")
    known = [(u, c) for u, c in zip(upper, latin) if u != "\ufffd"]
    plain = F.regexp_replace(text, "[^\\x{00}-\\x{7F}" + "".join(f"\\x{{{ord(u):X}}}" for u, _ in known) + "]", "?")
    return F.encode(F.translate(plain, "".join(u for u, _ in known), "".join(c for _, c in known)), "ISO-8859-1")


def from_code_page(data: Column, page: str) -> Column:
    """The text of bytes in a code page."""
    name = CODE_PAGES.get(page.lower(), page)
    if name in ("utf-8", "utf-16"):
        return F.decode(data, name.upper())
    return F.translate(F.decode(data, "ISO-8859-1"), bytes(range(128, 256)).decode("latin-1"), upper_half(page))


def save(table: DataFrame, path: str) -> None:
    """Word forms as a packed table: Parquet sorted by form within its parts, so that ranges of forms skip row groups."""
    table.repartitionByRange("form").sortWithinPartitions("form").write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def min_cap(raw: Column) -> Column:
    return F.when(raw.rlike("^[A-Z][A-Z]"), 2).when(raw.rlike("^[A-Z][a-z]"), 1).otherwise(0)


def expand(table: DataFrame) -> DataFrame:
    """Word forms: every ending of every slot behind the stem, and the postfix behind that."""
    base = table.select("lexeme_id", "pos", F.lower("raw").alias("stem"), "spec", F.lower("postfix").alias("postfix"), min_cap(F.col("raw")).alias("min_cap"))
    slots = base.where("spec is not null").select("*", F.posexplode(F.split("spec", r"\|")).alias("form_id", "slot"))
    inflected = slots.select("*", F.explode(F.split("slot", "/")).alias("e")).where("e <> '-'").withColumn("ending", F.when(F.col("e") == "0", "").otherwise(F.lower("e")))
    plain = base.where("spec is null").withColumn("form_id", F.lit(PLAIN_FORM)).withColumn("ending", F.lit(""))
    columns = ["lexeme_id", "pos", "form_id", "ending", F.concat("stem", "ending", "postfix").alias("form"), "min_cap"]
    both = inflected.select(columns).union(plain.select(columns)).distinct()
    first = F.first("form").over(Window.partitionBy("lexeme_id").orderBy("form_id", "ending"))
    return both.withColumn("lemma", with_capitals(first, F.col("min_cap"))).withColumn("surface", with_capitals(F.col("form"), F.col("min_cap")))


_own: dict[str, DataFrame] = {}


def forms(spark: SparkSession, paths: str | list[str] | None = None) -> DataFrame:
    """Word forms of article files; of the lexicon that comes with the package, the same table for a whole session."""
    if paths is not None:
        return expand(articles(article_lines(spark, paths)))
    session = spark.sparkContext.applicationId
    if session not in _own:
        _own.clear()
        _own[session] = expand(articles(article_lines(spark)))
    return _own[session]


def lexemes(table: DataFrame) -> DataFrame:
    return table.groupBy("lexeme_id").agg(F.min("pos").alias("pos"), F.min("lemma").alias("lemma"), F.min("min_cap").alias("min_cap"), F.count_distinct("form").cast("int").alias("n_forms"))


_small: dict[tuple, bool] = {}


def is_small(table: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> bool:
    """Whether a table's rows and bytes are few enough to be sent to all tasks. Equal plans are checked once a session."""
    key = table.sparkSession.sparkContext.applicationId, table.semanticHash(), most, most_bytes
    if key not in _small:
        found = table.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
        _small[key] = found["n"] <= most and (found["size"] or 0) <= most_bytes
    return _small[key]


def for_join(table: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A lexicon table as a join's build side: broadcast if its rows and bytes are checked to be few, else shuffled."""
    return F.broadcast(table) if is_small(table, most, most_bytes) else table.hint("merge")
