import csv
import io
import json
import random

import pytest

from weft.sources import io as IO
from weft.sources import ranges

NASTY = ['a "quoted" word', "{[}]", "line\nbreak", "back\\slash", 'end\\', "tab\tcr\r\nlf", "ünï☃😀", "", ",", '"', '""', "}{", '\\"}', "x" * 300, "]", "plain"]


@pytest.fixture
def small_splits(spark, tmp_path):
    """Splits of a few bytes; the settings go back to what they were."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}

    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return r.choice(NASTY)
    if kind == 3:
        return r.choice([1, -2.5, True, None])
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(NASTY): value(r, depth + 1) for _ in range(r.randrange(4))}


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_json_records_do_not_depend_on_splits(spark, tmp_path, small_splits, size):
    small_splits(size)
    r = random.Random(size)
    files = {}
    for i in range(5):
        items = [value(r) for _ in range(r.randrange(12))]
        items += [{"k": r.choice(NASTY), "n": {"m": [r.choice(NASTY)]}} for _ in range(r.randrange(5))]
        text = json.dumps(items, indent=r.choice([None, 2]), ensure_ascii=r.choice([True, False])) + r.choice(["", "\n", " \n "])
        (tmp_path / f"f{i:02}.json").write_bytes(text.encode())
        files[f"f{i:02}.json"] = (text, [x for x in items if isinstance(x, dict)])
    (tmp_path / "g.json").write_text('{"a": {"instruction": "not in an array"}}')
    (tmp_path / "h.json").write_text("")
    got = {}
    for x in ranges.json_records(spark, str(tmp_path)).collect():
        got.setdefault(x.file.rsplit("/", 1)[1], []).append((x.offset, x.text))
    for name, (text, objects) in files.items():
        rows = sorted(got.pop(name, []))
        assert [json.loads(t) for _, t in rows] == objects
        raw = text.encode()
        assert all(raw[o:o + len(t.encode())].decode() == t for o, t in rows)
    assert not got


@pytest.mark.parametrize("size", [33, 1 << 20])
def test_parts_of_one_array(spark, tmp_path, small_splits, size):
    small_splits(size)
    items = [{"instruction": t, "output": f"o{i}", "tags": ["a}", "["]} for i, t in enumerate(NASTY)]
    text = json.dumps(items, ensure_ascii=False).encode()
    cuts = [0, 10, 11, 200, 201, 400, len(text)]
    cuts = [next(c for c in range(x, len(text) + 1) if c == len(text) or text[c] & 0xC0 != 0x80) for x in cuts]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"part-{i}").write_bytes(text[a:b])
    rows = sorted((x.offset, x.text) for x in ranges.json_records(spark, str(tmp_path), one_array=True).collect())
    assert [json.loads(t) for _, t in rows] == items
    assert all(text[o:o + len(t.encode())].decode() == t for o, t in rows)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_csv_records_are_the_one_task_read(spark, tmp_path, small_splits, size):
    r = random.Random(size)
    for i in range(3):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        w.writerow(["item_id", "instruction", "output", "context", "tags", "category"])
        for j in range(r.randrange(1, 15)):
            w.writerow([i * 100 + j, r.choice(NASTY) or "i", r.choice(NASTY), r.choice(NASTY), "a,b", 'mid"quote'])
        text = out.getvalue()
        (tmp_path / f"f{i}.csv").write_bytes((text if i % 2 else text.rstrip("\r\n")).encode())
    cols = ["item_id", "instruction", "output", "context", "tags", "category"]
    want = sorted(tuple(str(x) for x in row) for row in (
        row for i in range(3) for row in list(csv.reader(io.StringIO((tmp_path / f"f{i}.csv").read_bytes().decode(), newline="")))[1:]))
    small_splits(size)
    records = ranges.csv_records(spark, str(tmp_path)).filter("offset > 0").collect()
    assert sorted(tuple(next(csv.reader(io.StringIO(x.text, newline="")))) for x in records) == want
    got = IO.read_items_csv(spark, str(tmp_path))
    assert sorted(str(x.item_id) for x in got.collect()) == sorted(x[0] for x in want)
    by = {str(x.item_id): x for x in got.collect()}
    for row in want:
        x = by[row[0]]
        assert (x.instruction, x.output, x.context) == (row[1], row[2], row[3])
        assert x.category == row[5] and x.tags == ["a", "b"]
    assert len(cols) == 6


def test_values_with_a_quote_in_the_middle(spark, tmp_path, small_splits):
    small_splits(4)
    (tmp_path / "f.csv").write_bytes(b'instruction,output\r\n5" pipe,ok\r\n"two\r\nlines",x\r\n\r\nlast,"q"')
    assert sorted(x.text for x in ranges.csv_records(spark, str(tmp_path)).collect()) == [
        '"two\r\nlines",x', '5" pipe,ok', "instruction,output", 'last,"q"']


def test_a_few_bytes_a_split(spark, tmp_path, small_splits):
    small_splits(3)
    items = [{"a": '}"\\'}, [{"b": 1}, "["], {"c": {"d": ["}\n{"]}}, "{", {}]
    (tmp_path / "f.json").write_text(json.dumps(items))
    assert [json.loads(x.text) for x in ranges.json_records(spark, str(tmp_path)).orderBy("offset").collect()] == [items[0], items[2], {}]


@pytest.mark.parametrize("one_array", [True, False])
def test_array_writer(spark, tmp_path, one_array):
    items = spark.range(57).selectExpr("id item_id", "concat('in ', id, ' ]') instruction", "repeat('}\n', int(id % 4)) output", "array('a,b') tags")
    for rows in (items.repartition(7).filter("item_id % 5 < 2"), items.filter("item_id < 0"), items.coalesce(1)):
        path = tmp_path / f"x{rows.count()}"
        IO.write_items_array(rows, str(path), one_array)
        texts = [f.read_text() for f in sorted(path.glob("part-*"))]
        arrays = [json.loads("".join(texts))] if one_array else [json.loads(t) for t in texts if t]
        assert sorted(x["item_id"] for a in arrays for x in a) == sorted(r.item_id for r in rows.collect())
        back = IO.read_items_json(spark, str(path), one_array=one_array)
        assert sorted(back.select("item_id", "instruction", "output").collect()) == sorted(rows.select("item_id", "instruction", "output").collect())


def test_items_from_one_large_array(spark, tmp_path, small_splits):
    items = [{"instruction": f"i {n} }}", "output": "o\n" * (n % 9), "tags": [str(n)]} for n in range(90)]
    items += [{"conversations": [{"from": "human", "value": "h"}, {"from": "assistant", "value": "}"}]}, 5, "text", {"instruction": "no output"}]
    (tmp_path / "items.json").write_text(json.dumps(items, indent=2))
    whole = {tuple(x) for x in IO.read_items_json(spark, str(tmp_path)).select("item_id", "instruction", "output").collect()}
    small_splits(400)
    split = IO.read_items_json(spark, str(tmp_path))
    assert split.rdd.getNumPartitions() >= 1 and {tuple(x) for x in split.select("item_id", "instruction", "output").collect()} == whole
    assert len(whole) == 91 and ranges._segments(spark, str(tmp_path), "}").rdd.getNumPartitions() > 9


def test_routing_opens_text_files_only(spark, tmp_path, small_splits):
    small_splits(64)
    for name, text in {"a.md": "# x", "b.json": "[]", "c.JSONL": "{}", "d.csv": "a,b", "e.txt": " \t{\"a\": 1}\nplain", "f.TXT": "plain\n{\"a\": 1}\n" + "x\n" * 200, "g.txt": "", "sub/h.txt": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {x.path.rsplit("/", 1)[1]: x.format for x in IO.route_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "markdown", "b.json": "json", "c.JSONL": "jsonl", "d.csv": "csv", "e.txt": "jsonl", "f.TXT": "markdown", "h.txt": "jsonl"}
    (tmp_path / "i.bin").write_text("x")
    with pytest.raises(Exception, match="Unsupported format"):
        IO.route_files(spark, str(tmp_path)).collect()


def test_catalog_of_nothing_and_of_one_instant(spark, tmp_path):
    import datetime as dt

    assert IO.list_datasets(spark, str(tmp_path)).count() == 0
    at = dt.datetime(2024, 1, 1)
    for i in (1, 2):
        IO.register_dataset(spark, str(tmp_path / str(i)), "d", spark.range(i), created_at=at)
        spark.read.parquet(str(tmp_path / str(i) / "catalog")).write.mode("append").parquet(str(tmp_path / "catalog"))
    assert IO.load_dataset(spark, str(tmp_path), "d").count() == 2
