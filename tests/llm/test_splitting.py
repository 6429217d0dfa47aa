import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repoloom.llm import splitting as s

CONFIGS = "config_id int, chunk_lines int, chunk_lines_overlap int, max_chars int"


def check(text, cuts, limit):
    assert cuts[0].start == 0 and cuts[-1].end == len(text)
    for c, nxt in zip(cuts, [*cuts[1:], None], strict=True):
        assert 0 < c.end - c.start <= limit
        if nxt:
            assert c.start < nxt.start <= c.end < nxt.end and nxt.shared_chars == c.end - nxt.start


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r😀é", min_size=1, max_size=300), st.integers(1, 40), st.integers(0, 6))
def test_pieces_cover_and_stay_below_the_limit(text, limit, overlap):
    check(text, s.plan(len(text), s.detect(text, 0, len(text), 0, limit), limit, overlap), limit)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n\r😀", min_size=1, max_size=200), st.integers(1, 30), st.integers(3, 40))
def test_ranges_with_halos_find_the_same_boundaries(text, limit, size):
    halo = 8
    lines = []
    for base in range(0, len(text), size):
        before = min(base, halo)
        part = text[base - before : base + size + halo]
        chars = min(size, len(text) - base)
        lines += s.detect(part, before, before + chars, base - before, limit).lines
    assert lines == s.detect(text, 0, len(text), 0, limit).lines


def in_ranges(text, limit, overlap, size, halo=4):
    return list(s.cut_out(*s._bytes_of(memoryview(text.encode()), size, halo), limit, overlap))


PARTS = st.sampled_from(["a", "bc ", ". ", "; ", "é", "😀", "\n", "\r\n", "\r", " " * 90, ".\"" + " " * 40, "!" + ")" * 30 + " ", "x" * 50, "\u2003" * 30, "\n" * 20])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30), st.integers(1, 60), st.integers(0, 6), st.integers(1, 120))
def test_the_plan_of_ranges_is_that_of_the_whole(parts, limit, overlap, size):
    text = "".join(parts)
    whole = s.plan(len(text), s.detect(text, 0, len(text), 0, limit), limit, overlap)
    got = in_ranges(text, limit, overlap, size)
    assert [c for c, _ in got] == whole and all(t == text[c.start : c.end] for c, t in got)


def test_white_space_at_the_edge_of_a_range():
    text = "One sentence." + " " * 300 + "Another one that goes on for a while. " * 5
    for size in (10, 13, 14, 100, 312, 313, 314):
        assert [c for c, _ in in_ranges(text, 330, 2, size)] == s.plan(len(text), s.detect(text, 0, len(text), 0, 330), 330, 2)


def test_a_very_large_item(spark):
    line = "value = compute(argument) # note\n"
    big = spark.range(1).select(F.col("id").alias("chunk_id"), F.repeat(F.concat(F.lit(line), F.substring(F.col("id").cast("string"), 1, 0)), 200_000_000 // len(line)).alias("text"), F.lit(1).alias("config_id"))
    configs = spark.createDataFrame([(1, 4, 3, 1_000_000)], CONFIGS)
    got = s.coverage(s.pieces(big, configs)).first()
    n = 200_000_000 // len(line) * len(line)
    assert (got.n_chars, got.first_start, got.last_end, got.most_shared, got.wrong_texts) == (n, 0, n, 3, 0) and got.longest <= 1_000_000


def test_many_configurations_are_joined(spark, monkeypatch):
    monkeypatch.setattr(s, "LITERAL_CONFIGS", 1)
    configs = spark.createDataFrame([(1, 4, 1, 20), (2, 4, 0, 5), (2, 4, 0, 9), (3, 4, None, None)], CONFIGS)
    items = spark.createDataFrame([(1, "x" * 21, None), (2, "y" * 6, 2), (3, "z" * 20, 3), (None, "q" * 50, 1), (None, "r" * 50, 1)], "chunk_id bigint, text string, config_id int")
    assert sorted(str(r.chunk_id) for r in s.found(items, configs).collect()) == ["1", "2", "None"]
    assert s.pieces(items.where("chunk_id is null"), configs).count() == 6


def test_overlap_is_whole_lines_as_far_as_the_limit_allows():
    text = "".join(f"line {i}\n" for i in range(20))
    cuts = s.plan(len(text), s.detect(text, 0, len(text), 0, 40), 40, 2)
    assert all(c.kind in ("line", "end") for c in cuts) and all(c.shared_lines == 2 for c in cuts[1:])
    assert s.plan(len(text), s.detect(text, 0, len(text), 0, 40), 40, 99)[1].shared_lines >= 2


def test_table_nulls_defaults_repeats_and_stitching(spark):
    configs = spark.createDataFrame([(1, 4, 1, 20), (2, 4, 0, 5)], CONFIGS)
    rows = [(1, "x" * 20, None), (2, "y" * 21, None), (2, "y" * 21, None), (3, None, 1), (4, "", 1), (5, "ab\ncd\nef", 2), (6, "z" * 30, 77), (7, "word " * 100, 1), (None, "q" * 50, 1)]
    items = spark.createDataFrame(rows, "chunk_id bigint, text string, config_id int").withColumn("max_chars", F.lit("clash"))
    assert {r.chunk_id for r in s.found(items, configs).collect()} == {2, 5, 6, 7, None}
    whole = {(r.chunk_id, r.piece_no): (r.start_char, r.end_char, r.text) for r in s.pieces(items.where("chunk_id is not null"), configs).collect()}
    parts = {(r.chunk_id, r.piece_no): (r.start_char, r.end_char, r.text) for r in s.pieces(items.where("chunk_id is not null"), configs, range_bytes=7, halo=8).collect()}
    assert whole == parts and max(len(v[2]) for v in whole.values()) <= 20
    assert s.found(items.limit(0), configs).count() == 0


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_files_by_byte_ranges(spark, tmp_path, size):
    text = "Grüße 😀\r\nzwei\n" * 40 + "x" * 100
    path = tmp_path / "f.txt"
    path.write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    rows = sorted(s.split_files(spark, [str(path), str(tmp_path / "empty.txt")], 50, 1, range_bytes=size, halo=16).collect(), key=lambda r: r.piece_no)
    check(text, [s.Cut(r.start_char, r.end_char, 0, (rows[k - 1].end_char - r.start_char) if k else 0, "") for k, r in enumerate(rows)], 50)
    assert [(r.start_char, r.end_char) for r in rows] == [(c.start, c.end) for c in s.plan(len(text), s.detect(text, 0, len(text), 0, 50), 50, 1)]
    assert all(text[r.start_char : r.end_char] == r.text for r in rows)
