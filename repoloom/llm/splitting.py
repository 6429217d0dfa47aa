"""Cut oversized items at natural boundaries (problem 2).

An item is read in ranges with a halo on either side; each range gives a table of the boundaries inside it, and the sum
of the lengths of the ranges before gives its offset. The tables of one item are stitched in range order by a planner
that carries only what lies behind the start of the open piece, and the pieces are cut out of the one or few ranges
that they lie in. In a table the ranges of an item follow each other in its task, and only the range at hand is decoded;
:func:`split_files` gives the ranges of a file to many tasks and never reads a file as a whole.

A piece has at most ``max_chars`` characters. It ends, in order of preference, at the last line end within the limit,
the last sentence end, the last word gap, or at the limit itself. The next piece begins ``chunk_lines_overlap`` lines
before that end, or fewer where more would leave no room for the next line; pieces cut inside a line share none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.session import once, spread

#: Bytes of a range in a table, and of the least halo that decides about boundaries at its edges.
RANGE_BYTES = 1 << 18
HALO = 64
DEFAULT_CONFIG = 1
#: Configurations that are attached as literals; more of them are joined.
LITERAL_CONFIGS = 10_000

_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*(?:\s+|(?<=[。！？]))|[;}]\s*")
_GAP = re.compile(r"\s+|(?<=[,)\]|])(?=\S)")
#: Marks that may stand between the mark of a sentence and the white space that ends it.
_BEHIND_MARK = "\"'”’)]"
CUTS = ("line", "sentence", "word", "limit", "end")


@dataclass
class Boundaries:
    """Offsets just behind line ends, sentence ends and word gaps, ascending; the last two only where lines are long."""

    lines: list[int] = field(default_factory=list)
    sentences: list[int] = field(default_factory=list)
    gaps: list[int] = field(default_factory=list)

    def __iter__(self) -> Iterator[list[int]]:
        return iter((self.lines, self.sentences, self.gaps))


def detect(text: str, low: int, high: int, base: int, limit: int) -> Boundaries:
    """Boundaries ``b`` with ``low < b <= high`` of a range, offset by ``base``; ``text`` has its halo around it.

    Finer boundaries are listed only in lines that are longer than ``limit`` or that an edge of the range cuts.
    """
    lines = [m.end() for m in _LINE.finditer(text) if not (m[0] == "\r" and m.end() < len(text) and text[m.end()] == "\n")]
    sentences: list[int] = []
    gaps: list[int] = []
    edges = [0, *lines, len(text)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > limit or (b - a and (a == 0 and low > 0 or b == len(text) and high < len(text))):
            sentences += [m.end() for m in _SENTENCE.finditer(text, a, b)]
            gaps += [m.end() for m in _GAP.finditer(text, a, b) if m.end() > a]
    keep = lambda xs: [x + base for x in xs if low < x <= high]
    return Boundaries(keep(lines), keep(sentences), keep(gaps))


@dataclass(frozen=True)
class Cut:
    """A piece: where it begins and ends, lines and characters that it shares with the piece before, kind of its end."""

    start: int
    end: int
    shared_lines: int
    shared_chars: int
    kind: str


class Planner:
    """Cuts of one item from its boundary tables in order; forgets what lies before the start of the open piece."""

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap = max(1, limit), max(0, overlap)
        self.found = Boundaries()
        self.starts = [0]  # of lines
        self.start = self.covered = self.shared = 0

    def feed(self, known: int, found: Boundaries, last: bool) -> Iterator[Cut]:
        """The cuts that are certain once the boundaries up to ``known`` characters are; ``last``: the item ends there."""
        self.starts += found.lines
        for mine, more in zip(self.found, found, strict=True):
            mine += more
        while self.covered < known:
            if last and known - self.start <= self.limit:
                yield Cut(self.start, known, self.shared, self.covered - self.start, "end")
                self.covered = known
            elif last or known > self.start + 2 * self.limit:
                yield self._cut(known)
            else:
                break
        for xs in (self.starts, *self.found):
            del xs[: bisect_left(xs, self.start)]

    def _cut(self, known: int) -> Cut:
        start, starts, limit = self.start, self.starts, self.limit
        top = start + limit
        for kind, ends in zip(CUTS, self.found, strict=False):
            at = bisect_right(ends, top) - 1
            if at >= 0 and ends[at] > self.covered:
                end = ends[at]
                break
        else:
            kind, end = "limit", top
        cut = Cut(start, end, self.shared, self.covered - start, kind)
        self.covered, self.shared, self.start = end, 0, end
        at = bisect_left(starts, end)
        if at < len(starts) and starts[at] == end and self.overlap:
            room = starts[at + 1] if at + 1 < len(starts) else known
            if room - end > limit:  # the next line does not fit anyhow: leave room for its first finer boundary
                finer = [xs[i] for xs in (self.found.sentences, self.found.gaps) if (i := bisect_right(xs, end)) < len(xs)]
                room = min([*finer, end + limit])
            for back in range(1, self.overlap + 1):
                first = at - back
                if first < 0 or starts[first] <= start or room - starts[first] > limit:
                    break
                self.start, self.shared = starts[first], back
        return cut


def plan(n: int, found: Boundaries, limit: int, overlap: int) -> list[Cut]:
    """All cuts of an item of ``n`` characters whose boundaries are known."""
    return list(Planner(limit, overlap).feed(n, found, True))


def _edge(data: bytes | memoryview, at: int) -> int:
    """The first byte from ``at`` on that begins a character."""
    stop = min(at + 3, len(data))
    while 0 < at < stop and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def read_range(read: Callable[[int, int], bytes], total: int, first: int, size: int, halo: int) -> tuple[str, str, str]:
    """Halo before, characters that start in the byte range, halo after.

    The halo before reaches over white space and closing marks to the mark of the sentence, however far it is.
    ``read`` gives bytes by offset and count.
    """

    def decoded(low: int, high: int) -> str:
        low = max(0, low)
        data = read(max(0, low - 3), min(total, high + 3) - max(0, low - 3))
        shift = low - max(0, low - 3)
        return bytes(data[_edge(data, shift) : _edge(data, shift + min(high, total) - low)]).decode("utf-8", "replace")

    reach = halo
    while True:
        before = decoded(first - reach, first) if first else ""
        if reach >= first or len(before.rstrip().rstrip(_BEHIND_MARK)) > 1:
            break
        reach *= 8
    end = first + size
    return before, decoded(first, end), decoded(end, end + halo) if end < total else ""


def cut_out(ranges: Iterable[tuple[str, str, str]], last: int, limit: int, overlap: int) -> Iterator[tuple[Cut, str]]:
    """The pieces of an item from its ranges (with their halos) in order; ``last`` is the number of the last range."""
    planner = Planner(limit, overlap)
    held: deque[tuple[int, str]] = deque()  # the ranges from the start of the open piece on, with their offsets
    base = 0
    for no, (before, text, after) in enumerate(ranges):
        held.append((base, text))
        found = detect(before + text + after, len(before), len(before) + len(text), base - len(before), limit)
        base += len(text)
        for cut in planner.feed(base, found, no == last):
            while held[0][0] + len(held[0][1]) <= cut.start:
                held.popleft()
            yield cut, "".join(t[max(0, cut.start - at) : cut.end - at] for at, t in held if at < cut.end)


def _bytes_of(data: memoryview, range_bytes: int, halo: int) -> tuple[Iterator[tuple[str, str, str]], int]:
    """The ranges of a text in memory and the number of the last one."""
    read = lambda at, n: data[at : at + n]
    firsts = range(0, len(data), range_bytes)
    return (read_range(read, len(data), first, min(range_bytes, len(data) - first), halo) for first in firsts), len(firsts) - 1


def _with_config(items: DataFrame, configs: DataFrame, id_col: str, text_col: str, default: int) -> DataFrame:
    """``id, text, max_chars, overlap`` of the items that are longer than their limit.

    A bounded number of configurations is attached as a literal map; more are joined. Of configurations that share an
    id the one with the smallest limit counts.
    """
    valid = configs.where("config_id is not null and max_chars is not null").groupBy(F.col("config_id").cast("bigint").alias("config_id"))
    valid = valid.agg(F.min(F.struct(F.col("max_chars").cast("int").alias("m"), F.coalesce(F.col("chunk_lines_overlap").cast("int"), F.lit(0)).alias("o"))).alias("c"))
    rows = valid.limit(LITERAL_CONFIGS + 1).collect()
    literal = lambda c: F.struct(F.lit(c.m).alias("m"), F.lit(c.o).alias("o"))
    wanted = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("config_id").cast("bigint").alias("config_id"))
    if len(rows) > LITERAL_CONFIGS:
        fallback = valid.where(F.col("config_id") == default).first() or valid.orderBy("config_id").first()
        with_config = wanted.join(valid, "config_id", "left").withColumn("c", F.coalesce("c", literal(fallback.c)))
    else:
        known = {r.config_id: literal(r.c) for r in rows}
        fallback = known.get(default, known[min(known)] if known else F.struct(F.lit(1500).alias("m"), F.lit(15).alias("o")))
        found = F.try_element_at(F.create_map(*[x for k, c in known.items() for x in (F.lit(k).cast("bigint"), c)]), F.col("config_id")) if known else fallback
        with_config = wanted.withColumn("c", F.coalesce(found, fallback))
    return with_config.where(F.length("text") > F.col("c.m")).select("id", "text", F.col("c.m").alias("max_chars"), F.col("c.o").alias("overlap"))


_PIECES = "id bigint, piece_no int, start_char int, end_char int, shared_lines int, shared_chars int, cut string"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
_NAMES = ("id", "piece_no", "start_char", "end_char", "shared_lines", "shared_chars", "cut", "text")
#: Characters of pieces that leave a task at once.
_FLUSH = 1 << 24


def _pieces(over: DataFrame, with_text: bool, range_bytes: int, halo: int) -> DataFrame:
    width = len(_NAMES) if with_text else len(_NAMES) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * width
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS[:width], strict=True)], names=_NAMES[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            ids, limits, overlaps = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for key, value, limit, overlap in zip(ids, batch.column(1), limits, overlaps, strict=True):
                for no, (c, text) in enumerate(cut_out(*_bytes_of(memoryview(value.as_buffer()), range_bytes, halo), limit, overlap)):
                    rows.append((key, no, c.start, c.end, c.shared_lines, c.shared_chars, c.kind, text)[:width])
                    size += len(text) + 64
                    if size > _FLUSH:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    return over.mapInArrow(run, _PIECES + (", text string" if with_text else ""))


def plan_pieces(items: DataFrame, configs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", default: int = DEFAULT_CONFIG, range_bytes: int = RANGE_BYTES, halo: int = HALO) -> DataFrame:
    """Where each oversized item is cut: ``id, piece_no, start_char, end_char, shared_lines, shared_chars, cut``.

    Items within their limit, null and empty texts give no row. A null or unknown ``config_id`` means ``default``, or the
    smallest one where that is unknown too. Repeated items give each piece once; items with a null id are all cut. The
    table is read once and nothing but the result is shuffled, to make it distinct.
    """
    over = spread(_with_config(items, configs, id_col, text_col, default), "id")
    return once(_pieces(over, False, range_bytes, halo), "id", "piece_no")


def pieces(items: DataFrame, configs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", default: int = DEFAULT_CONFIG, range_bytes: int = RANGE_BYTES, halo: int = HALO) -> DataFrame:
    """The pieces of every oversized item with their text: the columns of :func:`plan_pieces` and ``text``."""
    over = spread(_with_config(items, configs, id_col, text_col, default), "id")
    return once(_pieces(over, True, range_bytes, halo), "id", "piece_no").withColumnRenamed("id", id_col)


def found(items: DataFrame, configs: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Distinct ids of the items that the splitter had to cut."""
    over = spread(_with_config(items, configs, id_col, "text", DEFAULT_CONFIG), "id")
    return _pieces(over, False, RANGE_BYTES, HALO).where("piece_no = 1").select(F.col("id").alias(id_col)).distinct()


def coverage(cut: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """What holds of each item's pieces: characters that they cover, first start, longest piece, lines of overlap at most."""
    return cut.groupBy(id_col).agg(
        F.sum(F.length("text") - F.col("shared_chars")).alias("n_chars"), F.min("start_char").alias("first_start"), F.max("end_char").alias("last_end"), F.max(F.length("text")).alias("longest"), F.max("shared_lines").alias("most_shared"), F.count_if(F.length("text") != F.col("end_char") - F.col("start_char")).alias("wrong_texts"),
    )


def _open(path: str):  # noqa: ANN202 - a pyarrow file
    """A file on any file system that pyarrow knows, for reads by offset."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap: int, range_bytes: int = 1 << 24, halo: int = 1024) -> DataFrame:
    """``path, piece_no, start_char, end_char, shared_lines, cut, text`` of UTF-8 files on shared storage.

    Byte ranges are read by offset; a range begins at the first character that starts inside it, so that the ranges
    tile the file whatever its bytes. Each range gives its length in characters and its boundary table; prefix sums of
    the lengths place the tables in the file. The tables of a file pass its planner one after the other, so that no more
    than a few of them are in memory; every piece is read again by the byte ranges that it lies in. Undecodable bytes
    count as one U+FFFD each. An empty file has no pieces.
    """
    sizes = []
    for path in paths:
        with _open(path) as f:
            sizes.append((path, f.size()))
    files = spark.createDataFrame(sizes, "path string, total bigint").where("total > 0")
    ranges = files.select("path", "total", F.posexplode(F.expr(f"sequence(0L, total - 1, {range_bytes}L)")).alias("range_no", "first")).withColumn("size", F.least(F.lit(range_bytes), F.col("total") - F.col("first")))
    n = max(2 * spark.sparkContext.defaultParallelism, 1)
    ranges = ranges.repartition(n, "path", "range_no")
    ints = pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    before, text, after = read_range(lambda at, n: f.read_at(n, at), r["total"], r["first"], r["size"], halo)  # noqa: B023
                b = detect(before + text + after, len(before), len(before) + len(text), -len(before), max_chars)
                values = (r["path"], r["range_no"], r["first"], r["size"], r["total"], len(text), *b)
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ints, ints, ints)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["path", "range_no", "first", "size", "total", "chars", "lines", "sentences", "gaps"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, planner, base, no = None, None, 0, 0
        held: deque[tuple[int, int, int, int]] = deque()  # offset in characters, characters, first byte, bytes
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, planner, base, no = r["path"], Planner(max_chars, overlap), 0, 0
                    held.clear()
                held.append((base, r["chars"], r["first"], r["size"]))
                table = Boundaries(*([x + base for x in r[c]] for c in ("lines", "sentences", "gaps")))
                base += r["chars"]
                rows = []
                for c in planner.feed(base, table, r["first"] + r["size"] == r["total"]):
                    while held[0][0] + held[0][1] <= c.start:
                        held.popleft()
                    part = [h for h in held if h[0] < c.end]
                    rows.append((path, no, c.start, c.end, c.shared_lines, c.kind, c.start - part[0][0], part[0][2], sum(h[3] for h in part), r["total"]))
                    no += 1
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["path", "piece_no", "start_char", "end_char", "shared_lines", "cut", "skip", "first", "size", "total"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                if held[:3] != (r["path"], r["first"], r["size"]):
                    with _open(r["path"]) as f:
                        held = (r["path"], r["first"], r["size"], read_range(lambda at, n: f.read_at(n, at), r["total"], r["first"], r["size"], 4)[1])  # noqa: B023
                texts.append(held[3][r["skip"] : r["skip"] + r["end_char"] - r["start_char"]])
            kept = batch.select(["path", "piece_no", "start_char", "end_char", "shared_lines", "cut"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=[*kept.schema.names, "text"])

    head = "path string, piece_no bigint, start_char bigint, end_char bigint, shared_lines int, cut string"
    tables = ranges.mapInArrow(scan, "path string, range_no int, first bigint, size bigint, total bigint, chars bigint, lines array<bigint>, sentences array<bigint>, gaps array<bigint>")
    cuts = tables.repartition(n, "path").sortWithinPartitions("path", "range_no").mapInArrow(stitch, f"{head}, skip bigint, first bigint, size bigint, total bigint")
    return cuts.repartitionByRange(n, "path", "first").sortWithinPartitions("path", "first", "piece_no").mapInArrow(emit, f"{head}, text string")
