"""The data source of dictionary files: parts, order, code pages, rejects."""

import os

import pytest

from wordmill.sources import files, lexicon


def read(spark, path, **options):
    source = files.registered(spark).read.format(files.NAME).option("path", path)
    for k, v in options.items():
        source = source.option(k, v)
    return sorted((r["file_no"], r["place"], r["line"]) for r in source.load().collect())


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1 << 20])
def test_every_line_once_whatever_the_parts(spark, tmp_path, split):
    data = "один\r\nдва\n\nтри четыре\nпоследняя".encode("cp1251")
    (tmp_path / "b.dic").write_bytes(data)
    (tmp_path / "a.dic").write_bytes(b"\n")
    (tmp_path / "c.dic").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    assert read(spark, str(tmp_path), encoding="windows-1251", split=split) == [(0, 0, ""), (1, 0, "один"), (1, 6, "два"), (1, 10, ""), (1, 11, "три четыре"), (1, 22, "последняя")]


def test_given_order_and_long_lines(spark, tmp_path):
    (tmp_path / "z").write_text("first\n" + "x" * 200_000 + "\nlast\n")
    (tmp_path / "y").write_text("second\n")
    got = read(spark, f"{tmp_path}/z\n{tmp_path}/y", split=1000)
    assert [(n, len(line)) for n, _, line in got] == [(0, 5), (0, 200_000), (0, 4), (1, 6)]
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        read(spark, f"{tmp_path}/nothing")


def test_empty_folder(spark, tmp_path):
    assert read(spark, str(tmp_path)) == []


@pytest.mark.parametrize("page", ["utf-8", "win", "koi8", "dos", "mac", "iso-8859-5", "utf-16"])
def test_round_trip_in_every_code_page(spark, tmp_path, page):
    lines = ["ёлка # ж 3*а", "Ok", "ещё"]
    files.save(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), str(tmp_path / "d"), page)
    assert [line for _, _, line in read(spark, str(tmp_path / "d"), encoding=page) if line] == lines
    if page == "win":
        (name,) = [x for x in os.listdir(tmp_path / "d") if x.endswith(".dic")]
        assert (tmp_path / "d" / name).read_bytes() == "".join(x + "\n" for x in lines).encode("cp1251")


def test_load_and_rejects(spark, tmp_path):
    lines = ["walk|0|s\tV\tLID:7\tpost:-то", "// comment", "word N", "bad XX LID:5", "", "sing|0\tV\tLID:8"]
    (tmp_path / "d.dic").write_bytes("\n".join(lines).encode("koi8-r"))
    got = files.load(spark, str(tmp_path / "d.dic"), "koi8", str(tmp_path / "rejects"))
    assert [(r["lexeme_id"], r["raw"], r["spec"], r["postfix"]) for r in got.orderBy("file_no", "place").collect()] == [(7, "walk", "0|s", "-то"), (8, "sing", "0", "")]
    assert sorted(x for _, _, x in read(spark, str(tmp_path / "rejects"), encoding="koi8")) == sorted(["// comment", "word N", "bad XX LID:5"])
    forms = lexicon.expand(got.drop("file", "file_no", "place"))
    assert {r["form"] for r in forms.collect()} == {"walk-то", "walks-то", "sing"}


def test_modes_and_failed_tasks(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "line string")
    path = str(tmp_path / "d")
    files.save(one, path)
    files.save(one, path)
    assert len(read(spark, path)) == 2
    files.save(one, path, mode="overwrite")
    assert len(read(spark, path)) == 1
    from pyspark.sql import functions as F

    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise("b").alias("line"))
    with pytest.raises(Exception, match="stop"):
        files.save(bad, path)
    assert len(read(spark, path)) == 1 and not [x for x in os.listdir(path) if x.startswith(".") and not x.endswith(".crc")]
    with pytest.raises(Exception, match="no column line"):
        spark.range(1).write.format(files.NAME).mode("append").save(path)


@pytest.mark.parametrize("split", [1 << 30, 50_000])
def test_a_part_is_read_once(tmp_path, monkeypatch, split):
    """Not so many bytes for each line."""
    from pyarrow import fs

    path, count = tmp_path / "lines.dic", []
    path.write_bytes(b"".join(b"line %d\r\n" % i for i in range(20_000)) + b"last")

    class Counting:
        def open_input_file(self, at):
            f = fs.LocalFileSystem().open_input_file(at)

            class Opened:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                def read(self, n):
                    data = f.read(n)
                    count.append(len(data))
                    return data

                seek, tell = f.seek, f.tell

            return Opened()

    monkeypatch.setattr(files, "_files", lambda p: iter([(Counting(), str(path), path.stat().st_size)]))
    reader = files.Reader({"path": str(path), "split": str(split)})
    parts = reader.partitions()
    lines = [x for part in parts for x in reader._lines(part)]
    assert [x for _, x in lines] == [f"line {i}" for i in range(20_000)] + ["last"]
    assert all(path.read_bytes()[at:].startswith(x.encode()) for at, x in lines[::997])
    assert sum(count) <= path.stat().st_size + len(parts) * (1 << 18)
