"""Ending and alternation tables, lexicon checks and class files: what the compilers of a dictionary read and write.

Ending tables are written as blocks:

    .table name            (or .type name)
    ending, grammar[, next table[, options]]
    .include other/file

``//`` starts a comment. An ending with a next table goes on with each of that table's
endings; grammar words are joined by OR, options (flags) by AND. The files are small and
are parsed on the driver; expansion is an iterated join on the table of rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "name string, ending string, grammar int, next string, flags int"


def read_table_lines(path: str | Path, encoding: str = "utf-8", opened: frozenset[str] = frozenset()) -> list[str]:
    """The lines of a table file without comments; included files stand where they are named, relative to the file."""
    path = Path(path)
    if str(path.resolve()) in opened:
        raise ValueError(f"{path} includes itself")
    out: list[str] = []
    for line in path.read_text(encoding).splitlines():
        line = line.split("//")[0].strip()
        if line.startswith(".include"):
            out += read_table_lines(path.parent / line.split(None, 1)[1].strip("\"'"), encoding, opened | {str(path.resolve())})
        elif line:
            out.append(line)
    return out


def parse_tables(lines: list[str], grammar) -> list[tuple[str, str, int, str | None, int]]:
    """Rows (name, ending, grammar, next, flags). ``grammar(text, before)`` gives the number; an empty text repeats the one before."""
    rows, name, before = [], "", 0
    for line in lines:
        head = line.split(None, 1)
        if head[0] in (".table", ".type"):
            name, before = head[1], 0
            continue
        if line in "{}":
            continue
        parts = [p.strip() for p in line.split(",")] + ["", "", ""]
        before = grammar(parts[1], before) if parts[1] else before
        rows.append((name, "" if parts[0] == "0" else parts[0], before, parts[2] or None, int(parts[3] or 0xFF)))
    return rows


def ending_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ROWS)


def expand_endings(rows: DataFrame, depth: int = 16) -> DataFrame:
    """name, ending, grammar, flags of whole endings: tables joined to the tables they go on with, until none is left."""
    open_rows, done = rows, None
    for _ in range(depth):
        whole = open_rows.where("next is null").drop("next")
        done = whole if done is None else done.union(whole)
        more = open_rows.where("next is not null")
        if not more.limit(1).count():
            return done.distinct()
        after = rows.select(F.col("name").alias("of"), F.col("ending").alias("tail"), F.col("grammar").alias("g"), F.col("next").alias("then"), F.col("flags").alias("f"))
        open_rows = more.join(after, more["next"] == after["of"]).select(
            "name", F.concat("ending", "tail").alias("ending"), F.col("grammar").bitwiseOR(F.col("g")).alias("grammar"), F.col("then").alias("next"), F.col("flags").bitwiseAND(F.col("f")).alias("flags")
        )
    raise ValueError(f"tables go on more than {depth} times: one goes on with itself")


def equal_tables(expanded: DataFrame) -> DataFrame:
    """name, stands_for: tables with the same endings share the first name."""
    body = expanded.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("ending", "grammar", "flags"))).alias("body"))
    return body.groupBy("body").agg(F.min("name").alias("stands_for"), F.collect_list("name").alias("names")).select(F.explode("names").alias("name"), "stands_for")


def parse_alternations(lines: list[str]) -> list[tuple[str, int, str, int, str]]:
    """Rows (name, place, condition, level, text) of blocks '.table name { condition, text 1, text 2, ... }'; '' is an empty text."""
    rows, name, place = [], "", 0
    for line in lines:
        head = line.split(None, 1)
        if head[0] in (".table", ".таблица"):
            name, place = head[1].strip(), 0
        elif line not in "{}":
            condition, *texts = [x for x in line.replace(",", " ").split()]
            if len(texts) < 2:
                raise ValueError(f"an alternation of {name} has fewer than 2 texts: {line}")
            rows += [(name, place, condition, level, "" if text == "''" else text) for level, text in enumerate(texts, 1)]
            place += 1
    return rows


def token_values(spark: SparkSession, vocabulary: dict[str, tuple[int, int, int, int]], expressions: list[str]) -> DataFrame:
    """expression, grammar, flags: each 'a|b|...' applied from 0 on; an unknown token is an error."""
    names = list(vocabulary)
    kept = lambda i: F.create_map(*[F.lit(x) for k in names for x in (k, vocabulary[k][i])])
    maps = [kept(i) for i in range(4)]

    def step(state: Column, token: Column) -> Column:
        t = F.trim(token)
        known = F.when(F.map_contains_key(maps[0], t), t).otherwise(F.raise_error(F.concat(F.lit("unknown token "), t)).cast("string"))
        of = lambda i: F.element_at(maps[i], known)
        return F.struct(state["g"].bitwiseAND(of(0)).bitwiseOR(of(1)).alias("g"), state["f"].bitwiseAND(of(2)).bitwiseOR(of(3)).alias("f"))

    rows = spark.createDataFrame([(x,) for x in expressions], "expression string")
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("f"))
    out = rows.withColumn("s", F.aggregate(F.split("expression", r"\|"), start, step))
    return out.select("expression", F.col("s.g").alias("grammar"), F.col("s.f").alias("flags"))


def alternations(rows: DataFrame) -> DataFrame:
    """name, text, mask from (name, level, text): equal texts share levels."""
    return rows.groupBy("name", "text").agg(F.bit_or(F.pow(F.lit(2), F.col("level") - 1).cast("int")).alias("mask"))


def build(stems: DataFrame, alternation: DataFrame, endings: DataFrame) -> DataFrame:
    """lexeme_id, form, grammar: stem, alternation, ending and postfix of every stem, where the ending's level is in the alternation's mask.

    stems(lexeme_id, stem, alt, table, postfix); endings has ``level`` beside what ``expand_endings`` gives.
    """
    alt = alternation.withColumnRenamed("name", "alt")
    both = stems.join(alt, "alt", "left").join(endings.withColumnRenamed("name", "table"), "table", "left")
    fits = F.col("mask").isNull() | F.col("level").isNull() | (F.col("mask").bitwiseAND(F.pow(F.lit(2), F.col("level") - 1).cast("int")) != 0)
    return both.where(fits).select("lexeme_id", F.concat("stem", F.coalesce("text", F.lit("")), F.coalesce("ending", F.lit("")), F.coalesce("postfix", F.lit(""))).alias("form"), "grammar").distinct()


def russian_lines(lines: DataFrame) -> DataFrame:
    """line, normal, marks, kind, index, comment, remark, postfix from four columns and a comment; an index 'a//b' gives two rows."""
    line = F.translate("line", "ёЁ", "еЕ")
    col = lambda i: F.regexp_extract(line, r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$", i)
    cut = lines.select("line", col(1).alias("normal"), col(2).alias("marks"), col(3).alias("kind"), F.explode(F.split(col(4), "//")).alias("index"), col(5).alias("comment")).where("normal <> ''")
    return cut.withColumn("normal", F.regexp_replace("normal", "=", "")).withColumn("remark", remark(F.col("comment"))).withColumn("postfix", F.regexp_extract("comment", r"post:\s*(\S+)", 1))


def remark(comment: Column) -> Column:
    """The first token between hyphens."""
    return F.regexp_extract(comment, r"-([^-\s]+)-", 1)


def flags(comment: Column, markers: dict[str, int]) -> Column:
    """The bits of all markers that a comment holds."""
    out = F.lit(0)
    for mark, bit in markers.items():
        out = out.bitwiseOR(F.when(F.contains(comment, F.lit(mark)), bit).otherwise(0))
    return out


def case_scale(letters: Column, order: str) -> Column:
    """A bit for each letter of ``order`` that stands in a string."""
    out = F.lit(0)
    for i, c in enumerate(order):
        out = out.bitwiseOR(F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0))
    return out


def preferred(lines: DataFrame) -> DataFrame:
    """lexeme_id, wish ('+' or '-') of lines that mark samples."""
    return lines.select(F.regexp_extract("line", r"LID:([0-9]+)", 1).try_cast("long").alias("lexeme_id"), F.when(F.col("line").contains("+++"), "+").when(F.col("line").contains("---"), "-").alias("wish")).where("lexeme_id is not null and wish is not null")


CLASS_JSON = "struct<partSp:int,rate:bigint,index:int,accent:boolean,models:array<struct<suffix:string,weight:bigint,sample:string>>,inflex:array<struct<id:int,sz:string>>>"


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """class_id, pos, accent, models, inflex from a class file; a class without models, endings or ids, or with a suffix not of 2 characters, is an error."""
    df = spark.read.schema(f"classes array<{CLASS_JSON}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = df.select(F.explode("classes").alias("c")).select(F.col("c.index").alias("class_id"), F.col("c.partSp").alias("pos"), F.coalesce("c.accent", F.lit(False)).alias("accent"), "c.models", "c.inflex")
    bad = (
        F.col("models").isNull() | F.col("inflex").isNull() | F.col("class_id").isNull() | F.exists("models", lambda m: m["suffix"].isNull() | (F.length(m["suffix"]) != 2)) | F.exists("inflex", lambda x: x["id"].isNull())
    )
    return rows.withColumn("class_id", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad class "), F.coalesce(F.col("class_id").cast("string"), F.lit("?"))))).otherwise(F.col("class_id")))


def class_json(classed: DataFrame, models: DataFrame, endings: DataFrame) -> DataFrame:
    """json: one row a class, in the notation that ``read_classes`` reads; with ``accent`` where the classes have that column."""
    m = models.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("suffix", "weight", "sample"))).alias("models"))
    e = endings.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct(F.col("form_id").alias("id"), F.col("ending").alias("sz")))).alias("inflex"))
    both = classed.join(m, "class_id").join(e, "class_id")
    return both.select("class_id", F.to_json(F.struct(F.col("pos").alias("partSp"), F.col("n").alias("rate"), F.col("class_id").alias("index"), *[F.col(c) for c in classed.columns if c == "accent"], "models", "inflex")).alias("json"))
