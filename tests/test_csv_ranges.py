"""CSV by byte ranges equals Spark's multi-line reader, whatever the borders."""

import random

import pytest

from civicflow import sources
from civicflow.sources import csv_ranges


def multi_line(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@pytest.fixture
def split(spark):
    """``split(n)``: files are cut into ranges of n bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def at(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", n)
    yield at
    for k, v in kept.items():
        spark.conf.set(k, v)


def equal(spark, path):
    a, b = csv_ranges.read_csv(spark, path), multi_line(spark, path)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    return a


def field(rng, end):
    kind = rng.randrange(9)
    word = "".join(rng.choice("abcé ü") for _ in range(rng.randrange(1, 12)))
    plain = {0: "", 1: word, 2: f'"{word}"', 3: f'"{word},{word}"', 4: f'"{word}{end}{word}"', 5: f'"say ""{word}"", {end}{end}ok"', 6: '""', 7: '""""', 8: f"{end}".join(["\"long", *[word] * 30, 'end"'])}
    return plain[kind]


@pytest.mark.parametrize(("size", "end", "seed"), [(64, "\n", 1), (37, "\r\n", 2), (500, "\n", 3), (1 << 20, "\r\n", 4)])
def test_random_files(spark, tmp_path, split, size, end, seed):
    rng = random.Random(seed)
    for f in range(3):
        rows = [",".join(["id", '"the ""name"""', "x"])] + [",".join([str(i), field(rng, end), field(rng, end)]) for i in range(120)]
        if f == 1:
            rows.insert(4, "")
        (tmp_path / f"f{f}.csv").write_bytes((end.join(rows) + (end if f else "")).encode())
    split(size)
    out = equal(spark, str(tmp_path))
    if size < 100:
        assert out.rdd.getNumPartitions() > 20


def test_quotes_in_unquoted_fields(spark, tmp_path, split):
    rows = ['a,b', '5" pipe,x', 'y,"z"', '12" by 3",w', '"q" tail,1', 'u,"v', 'still v"', ' "lead,t', 'k,l']
    (tmp_path / "f.csv").write_text("\n".join(rows) + "\n")
    split(16)
    equal(spark, str(tmp_path / "f.csv"))


def test_header_over_ranges_and_empty_files(spark, tmp_path, split):
    (tmp_path / "f.csv").write_text('"a\nvery long\nname of a column that has breaks",b\n1,"x\n\n\ny"\n')
    split(8)
    equal(spark, str(tmp_path / "f.csv"))
    (tmp_path / "g.csv").write_text("a,b\n")
    assert csv_ranges.read_csv(spark, str(tmp_path / "g.csv")).count() == 0


def test_one_field_over_many_ranges(spark, tmp_path, split):
    (tmp_path / "f.csv").write_text("a,b\n1,\"" + "line\n" * 400 + "\"\n2,x\n3,\"open to the end\nof the file")
    split(100)
    out = csv_ranges.read_csv(spark, str(tmp_path / "f.csv"))
    got = {r["a"]: r["b"] for r in out.collect()}
    assert got["1"] == "line\n" * 400 and got["2"] == "x"


def test_states_joined_by_shuffle(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(csv_ranges, "BROADCAST_RANGES", 0)
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(300)))
    split(50)
    equal(spark, str(tmp_path / "f.csv"))


def test_lines_end_inside():
    for line, out, inside in [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a"",', True, False), ('x,"', True, False),
                              ('"",""', False, False), ('","', False, True), ("", False, True)]:
        assert (csv_ranges.ends_inside(line, False), csv_ranges.ends_inside(line, True)) == (out, inside), line


def test_tickets_from_one_file_are_many_tasks(spark, tmp_path, split):
    rows = ["Agency,Extra,Descriptor"] + [f'A{i},e,"line one\nline, two {i}"' for i in range(2000)]
    (tmp_path / "f.csv").write_text("\n".join(rows))
    split(4096)
    out = sources.read_tickets_csv(spark, str(tmp_path / "f.csv"), ["Descriptor", "Agency"])
    assert out.rdd.getNumPartitions() > 10
    assert out.count() == 2000 and out.where("Descriptor like 'line one\\nline, two%'").count() == 2000
