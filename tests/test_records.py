"""Feed files with quoted line breaks, read in small blocks, against the csv module."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.sources import feed, records


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _stops(rng, n):
    parts = ["Platz", "a,b", 'say ""so""'.replace('""', '"'), "line\nbreak", "two\n\nbreaks", "x\r\ny", "", "é", '"', "\n", 'end"\n,"']
    return [[f"S{i}", rng.choice(parts) + rng.choice(parts), str(rng.random()), "", ""] for i in range(n)]


def _write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    text = io.StringIO()
    out = csv.writer(text, lineterminator=end, quoting=quoting)
    out.writerow(["stop_id", "stop_name", "stop_lon", "stop_lat", "extra"])
    out.writerows(rows)
    path.write_bytes(text.getvalue().encode())
    return text.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_round_trip_over_block_borders(small_blocks, tmp_path, end, quoting):
    rows = _stops(random.Random(5), 70)
    _write(tmp_path / "stops.txt", rows, end, quoting)
    raw = feed.read_table(small_blocks, str(tmp_path / "stops.txt"), "stops")
    lines = records._lines(small_blocks, str(tmp_path / "stops.txt"))
    assert lines.select("block").distinct().count() > 20  # several tasks
    blocks = lines.select("path", "block", "effect").mapInPandas(records._composed, "path string, block long, effect int")
    assert records._inside(blocks).count() > 0  # and some begin inside quotes
    got = [(r.stop_id, r.stop_name or "", r.stop_lon) for r in raw.orderBy("ord").collect()]
    assert got == [(r[0], r[1], r[2]) for r in rows]


def test_one_record_over_many_blocks(small_blocks, tmp_path):
    rows = [["A", "first", "1", "2", ""], ["B", "long\n" * 80 + "end", "3", "4", ""], ["C", "last", "5", "6", ""]]
    _write(tmp_path / "stops.txt", rows)
    raw = feed.read_table(small_blocks, str(tmp_path / "stops.txt"), "stops").orderBy("ord")
    assert [(r.stop_id, r.stop_name, r.stop_lat) for r in raw.collect()] == [(r[0], r[1], r[3]) for r in rows]


def test_quotes_inside_a_field_are_text(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name\nA,5" pipe\n\nB,"q"\nC,"two\nlines"\nD,x"y"\n')
    raw = feed.read_table(spark, str(tmp_path / "stops.txt"), "stops").orderBy("ord")
    assert [(r.stop_id, r.stop_name) for r in raw.collect()] == [("A", '5" pipe'), ("B", "q"), ("C", "two\nlines"), ("D", 'x"y"')]
    assert raw.where("parent_station is not null").count() == 0


def test_empty_file_header_only_and_parts(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "head.txt").write_text("stop_id,stop_name\n")
    assert feed.read_table(spark, str(tmp_path / "none.txt"), "stops").count() == 0
    assert feed.read_table(spark, str(tmp_path / "head.txt"), "stops").count() == 0
    (tmp_path / "parts").mkdir()
    for i in range(3):
        (tmp_path / "parts" / f"p{i}.txt").write_text(f'﻿stop_id,stop_name\nS{i},"a\nb"\n')
    raw = feed.read_table(spark, str(tmp_path / "parts"), "stops")
    assert sorted((r.stop_id, r.stop_name) for r in raw.collect()) == [(f"S{i}", "a\nb") for i in range(3)]


def test_unclosed_quote(small_blocks, tmp_path, monkeypatch):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name\nA,x\nB,"open\nC,y\n')
    rows = feed.read_table(small_blocks, str(tmp_path / "stops.txt"), "stops").orderBy("ord").collect()
    assert [r.stop_id for r in rows] == ["A", "B"] and rows[1].stop_name.startswith("open\nC,y")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a,"\r', max_size=8), min_size=1, max_size=12))
def test_effects_compose(lines):
    """The composed state equals a character by character walk."""

    def walk(inside, line):
        state, i = "quoted" if inside else "start", 0
        while i < len(line):
            c = line[i]
            if state == "quoted" and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = "text"
            elif state != "quoted":
                state = "start" if c == "," else "quoted" if c == '"' and state == "start" else "text"
            i += 1
        return state == "quoted"

    import re

    import numpy as np

    opens, stays = (re.compile(p.replace("\\z", "\\Z")) for p in (records._OPENS, records._STAYS))
    for start in (False, True):
        want, state, effects = [], start, []
        for line in lines:
            state = walk(state, line)
            want.append(state)
            effects.append((1 if opens.search(line) else 0) + (2 if stays.search(line) else 0) if '"' in line else records.KEEP)
        assert records._after(np.array(effects), start).tolist() == want
