"""One large JSON array or quoted CSV file, read by as many tasks as it has splits.

A value may hold line breaks, brackets and quotes, so a task that starts in the middle of a file does
not know where it stands. Two passes settle that:

1. Spark's text reader cuts the file into splits at a fixed separator (``}`` for arrays, line feed for
   CSV), in every store that Spark reads. Each split reports what it does to the state for every state
   it could start in: whether it ends inside a quoted string, the change of depth, the least depth on
   the way, and its bytes. The reports of a file, one small row per split, are composed in order.
2. Each split is read again with the state it really starts in and cuts out its records. A record that
   crosses splits leaves a fragment in each; only fragments are grouped, by the split where it began.

Records carry the offset of their first byte in the file (in all files, where these are parts of one
array), so numbers made from it do not depend on the splits. The starts are broadcast: one row per split
(128 MB by default), 80 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# for a start outside (a) and inside (b) of a quoted string
_REPORT = "file string, block long, a_inside boolean, a_delta long, a_least long, b_inside boolean, b_delta long, b_least long, size long, records boolean, file_size long"
_STARTS = "file string, block long, number long, inside boolean, depth long, offset long, opened long, closed boolean"
_RECORDS = "file string, opened long, block long, offset long, whole boolean, text binary"
_BATCH_BYTES = 1 << 22
_NOWHERE = -(1 << 60)  # no record is found at this depth


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [pa.field(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", "))]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))


def _segments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("file_size"))


def _stretches(batches) -> Iterator[tuple[tuple, list[bytes]]]:
    """Stretches of rows of one split: all columns but the segments, and the segments."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        block = batch.column("block").to_numpy()
        cut = np.concatenate(([0], np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1, [len(block)]))
        rest = batch.select([n for n in batch.schema.names if n != "value"])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield tuple(c[a].as_py() for c in rest.columns), batch.column("value").slice(a, b - a).to_pylist()


class _Json:
    """An array's objects. Depth 1 is inside the array; a record is open at depth 2 and more. The
    separator closes a bracket, so it belongs to the state."""

    separator, first_depth, separator_step = "}", 0, -1
    _kind = np.zeros(256, np.uint8)
    _kind[[ord("["), ord("{")]], _kind[[ord("]"), ord("}")]], _kind[ord('"')], _kind[ord("\\")] = 1, 2, 4, 8

    @classmethod
    def marks(cls, buf: np.ndarray):
        """Brackets and quotes of a stretch: their places, the brackets' steps (0 for quotes), and whether
        the quotes up to and with each one are odd. A quote behind an odd run of backslashes is text."""
        kind = cls._kind[buf]
        at = np.flatnonzero(kind & 7)
        if (kind == 8).any():
            place = np.arange(len(buf))
            other = np.maximum.accumulate(np.where(kind == 8, -1, place))
            slashes = place - 1 - np.concatenate(([-1], other[:-1]))
            at = at[(kind[at] != 4) | (slashes[at] % 2 == 0)]
        what = kind[at]
        return at, (what == 1).astype(np.int64) - (what == 2), (np.cumsum(what == 4) % 2).astype(bool)

    @classmethod
    def report(cls, segments: list[bytes], first: bool):
        """Per start state: ends inside, change of depth, least change; and the bytes."""
        text = b"}".join(segments) if first else b"}" + b"}".join(segments)
        at, step, odd = cls.marks(np.frombuffer(text, np.uint8))
        ends = bool(odd[-1]) if len(odd) else False
        out = []
        for inside in (False, True):
            change = np.cumsum(step[odd == inside])
            out.append((ends ^ inside, int(change[-1]) if len(change) else 0, int(change.min(initial=0))))
        return (*out, len(text))

    @classmethod
    def cut(cls, text: bytes, inside: bool, depth: int):
        """Starts of records (-1: no object) and ends of records in a stretch, and the state behind it.
        Ends that come first close what was open before."""
        buf = np.frombuffer(text, np.uint8)
        at, step, odd = cls.marks(buf)
        clear = np.flatnonzero((odd == inside) & (step != 0))
        level = depth + np.cumsum(step[clear])
        at, step = at[clear], step[clear]
        begins, ends = at[(step > 0) & (level == 2)], at[(step < 0) & (level == 1)] + 1
        return (begins, buf[begins] == ord("{"), ends, bool(odd[-1]) ^ inside if len(odd) else inside,
                int(level[-1]) if len(level) else depth)

    @staticmethod
    def has_records(head: bytes) -> bool:
        return head.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"[")

    @staticmethod
    def joined(segments: list[bytes], first: bool, closed: bool) -> bytes:
        return (b"" if first else b"}") + b"}".join(segments) + (b"}" if closed else b"")


class _Csv:
    """Lines of quoted values: depth 1 between records, 2 where a line ends inside a quoted value. A quote
    opens at the start of a value only; two quotes inside are one."""

    separator, first_depth, separator_step = "\n", 1, 0

    @staticmethod
    def has_records(head: bytes) -> bool:
        return True

    @staticmethod
    def ends_inside(line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at = 0
        while True:
            if not inside:
                if not line.startswith(b'"', at):
                    at = line.find(b",", at) + 1
                    if not at:
                        return False
                    continue
                inside, at = True, at + 1
            at = line.find(b'"', at) + 1
            if not at:
                return True
            if line.startswith(b'"', at):
                at += 1
                continue
            inside, at = False, line.find(b",", at) + 1
            if not at:
                return False

    @classmethod
    def report(cls, segments: list[bytes], first: bool):
        out = []
        for start in (False, True):
            inside, closes = start, False
            for line in segments:
                inside = cls.ends_inside(line, inside)
                closes |= not inside
            out.append((inside, int(inside) - int(start), -1 if start and closes else 0))
        return (*out, sum(map(len, segments)) + len(segments) - first)


def _reports(kind):
    def run(batches):
        state: dict[tuple, list] = {}
        for (file, block, file_size), segments in _stretches(batches):
            key = (file, block, file_size)
            a, b, size = kind.report(segments, key not in state)
            if key not in state:
                state[key] = [*a, *b, size, block > 0 or kind.has_records(segments[0])]
                continue
            s = state[key]  # what was there, then this
            for i in (0, 3):
                end, delta, least = b if s[i] else a
                s[i + 2] = min(s[i + 2], s[i + 1] + least)
                s[i], s[i + 1] = end, s[i + 1] + delta
            s[6] += size
        yield _batch([(f, b, *s, size) for (f, b, size), s in state.items()], _REPORT)

    return run


def _composed(kind):
    def run(table: pa.Table) -> pa.Table:
        """The state in which each split of one file (or of all parts of one array) starts, and the
        split where the record that is open there began."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["file"], r["block"]))
        total: dict[str, int] = {}
        for r in rows:
            total[r["file"]] = total.get(r["file"], 0) + r["size"] + 1
        inside, depth, offset, opened, out = False, kind.first_depth, 0, -1, []
        if rows and not rows[0]["records"]:
            depth = _NOWHERE
        for number, r in enumerate(rows):
            # all splits end with a separator, but for a file's last one where the file does not
            last = number + 1 == len(rows) or rows[number + 1]["file"] != r["file"]
            closed = not last or total[r["file"]] == r["file_size"]
            out.append((r["file"], r["block"], number, inside, depth, offset, opened, closed))
            k = "b" if inside else "a"
            step = kind.separator_step if closed and not r[f"{k}_inside"] else 0
            least = min(r[f"{k}_least"], r[f"{k}_delta"] + step)
            if depth < 2 or depth + least < 2:
                opened = number
            inside, depth, offset = r[f"{k}_inside"], depth + r[f"{k}_delta"] + step, offset + r["size"] + closed
        return pa.Table.from_batches([_batch(out, _STARTS)])

    return run


def _with_starts(batches):
    """Stretches with the start of their split and whether they begin and end it."""
    before = None
    for (file, block, _, number, *start), segments in _stretches(batches):
        if number is None:
            raise RuntimeError(f"{file}: the splits of the second read differ from the first")
        if before is not None:
            yield *before, before[1] != (file, block)
        fresh = before is None or before[1] != (file, block)
        before = (fresh, (file, block), number, start, segments)
    if before is not None:
        yield *before, True


def _json_records(batches):
    rows, size = [], 0
    for fresh, (file, block), number, (inside0, depth0, offset0, opened0, closed), segments, last in _with_starts(batches):
        if fresh:
            inside, depth, offset, held = inside0, depth0, offset0, []
            opened, begun, is_object = opened0, None, True  # begun: None where the record began in another split
        text = _Json.joined(segments, fresh, closed and last)
        was_open = depth >= 2
        begins, objects, ends, inside, depth = _Json.cut(text, inside, depth)
        if was_open:
            piece = text[:ends[0]] if len(ends) else text
            held.append(piece)
            if len(ends):
                if is_object:
                    rows.append((file, opened, block, begun, opened == number, b"".join(held)))
                    size += len(rows[-1][5])
                held, ends = [], ends[1:]
        whole = objects[:len(ends)]
        for a, b in zip(begins[:len(ends)][whole].tolist(), ends[:len(begins)][whole].tolist(), strict=True):
            rows.append((file, number, block, offset + a, True, text[a:b]))
            size += b - a
        if len(begins) > len(ends):
            a = int(begins[-1])
            held, opened, begun, is_object = [text[a:]], number, offset + a, bool(objects[-1])
        offset += len(text)
        if last and held and is_object:
            rows.append((file, opened, block, begun, False, b"".join(held)))
            size += len(rows[-1][5])
        if last or size > _BATCH_BYTES:
            yield _batch(rows, _RECORDS)
            rows, size = [], 0


def _csv_records(batches):
    rows, size = [], 0
    for fresh, (file, block), number, (inside0, _, offset0, opened0, _), segments, last in _with_starts(batches):
        if fresh:
            inside, offset, held = inside0, offset0, []
            opened, begun = opened0, None
            is_open = inside
        for line in segments:
            if not is_open:
                opened, begun, held = number, offset, []
            held.append(line)
            offset += len(line) + 1
            inside = _Csv.ends_inside(line, inside)
            is_open = inside
            if not is_open:
                rows.append((file, opened, block, begun, opened == number, b"\n".join(held)))
                size += len(rows[-1][5])
                held = []
        if last and held:
            rows.append((file, opened, block, begun, False, b"\n".join(held)))
            size += len(rows[-1][5])
        if last or size > _BATCH_BYTES:
            yield _batch(rows, _RECORDS)
            rows, size = [], 0


def _records(spark: SparkSession, path: str, kind, cut, glue: str, one_array: bool) -> DataFrame:
    segments = _segments(spark, path, kind.separator)
    reports = segments.select("file", "block", "value", "file_size").mapInArrow(_reports(kind), _REPORT)
    # a split is one partition's rows, so it has one report
    unit = F.lit("") if one_array else F.col("file")
    starts = reports.groupBy(unit).applyInArrow(_composed(kind), _STARTS)
    placed = segments.join(F.broadcast(starts), ["file", "block"], "left").select(
        "file", "block", "value", "file_size", "number", "inside", "depth", "offset", "opened", "closed")
    rows = placed.mapInArrow(cut, _RECORDS)
    key = F.lit("") if one_array else F.col("file")
    pieces = rows.filter("not whole").groupBy(key.alias("_unit"), "opened").agg(
        F.min_by("file", F.struct("file", "block")).alias("file"), F.min("offset").alias("offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "block", F.col("text").cast("string").alias("text")))), lambda p: p["text"]), glue).alias("text"))
    return rows.filter("whole").select("file", "offset", F.col("text").cast("string").alias("text")).unionByName(
        pieces.filter("offset is not null").select("file", "offset", "text"))


def json_records(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """``(file, offset, text)``: the objects of JSON arrays, one row each, as their JSON text. Elements of
    an array that are no objects are left out, so is a file that holds no array. With ``one_array`` the
    files, in the order of their paths, are parts of one array."""
    return _records(spark, path, _Json, _json_records, "", one_array)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, text)``: the records of comma-separated files, with their line breaks inside
    quoted values; the record at offset 0 is the header. Blank records are left out."""
    rows = _records(spark, path, _Csv, _csv_records, "\n", False)
    return rows.withColumn("text", F.regexp_replace("text", "\r$", "")).filter(F.trim("text") != "")
