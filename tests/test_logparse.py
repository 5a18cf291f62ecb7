import json

import pytest

from tarnwork.operators import logparse
from tarnwork.operators.logparse import micros, parse_logs

SCHEMA = "log_stream string, line_no bigint, message string, message_2 string"
T0 = 1772536662000000  # 2026-03-03 11:17:42 UTC


def parse(spark, lines, stream="s"):
    rows = [(stream, i, m, "extra") for i, m in enumerate(lines, 1)]
    return [tuple(r)[1:] for r in parse_logs(spark.createDataFrame(rows, SCHEMA), least=1).orderBy("line_no").collect()]


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("2026-03-03T11:17:42.5Z  INFO db::wal: ready n=1", (T0 + 500000, "INFO", "db::wal", "ready n=1")),
        ("\x1b[2m2026-03-03T11:17:42Z\x1b[0m \x1b[33m WARN\x1b[0m \x1b[2mdb\x1b[0m\x1b[2m:\x1b[0m low \x1b[3mk\x1b[0m=1", (T0, "WARN", "db", "low k=1")),
        ("[2026-03-03T11:17:42Z DEBUG db::io] ERROR in text", (T0, "DEBUG", "db::io", "ERROR in text")),
        ("2026-03-03 11:17:42.000 UTC [77] checkpointer LOG:  done: all", (T0, "INFO", "checkpointer", "done: all")),
        ("2026-03-03 11:17:42,000 - a.b - CRITICAL - boom", (T0, "FATAL", "a.b", "boom")),
        ("2026-03-03 11:17:42,000 [root] ERROR: x - y", (T0, "ERROR", "root", "x - y")),
        ("W0303 11:17:42.000001   32067 codec.cc:46] slow", (T0 + 1, "WARN", "codec.cc", "slow")),
        (f"[{T0 // 1000}] [trace] [flusher] go", (T0, "TRACE", "flusher", "go")),
        ("Mar  3 11:17:42 node-1 db-backup[12]: debug: hi", (T0, "DEBUG", "db-backup", "hi")),
        ('time=2026-03-03T16:47:42+05:30 component=gc level=info msg="a \\"b\\"" k=1', (T0, "INFO", "gc", 'a "b"')),
        ('{"target":"db","timestamp":"2026-03-03T11:17:42Z","level":"info","fields":{"message":"a\\nb","level":"x"},"file":"cu', (T0, "INFO", "db", "a\nb")),
    ],
)
def test_layouts(spark, line, wanted):
    assert parse(spark, [line, "  more", ""]) == [(1, 3, *wanted[:3], wanted[3] + "\n  more\n")]


def test_continuations_and_objects(spark):
    head = "2026-03-03T11:17:42Z  INFO db: a"
    lines = ["lost", head, "    | 2026-03-03T11:17:42Z ERROR db: inside", '{"k": 1}', "{", '  "ts": 1772536662000,', '  "severity": "warning",', '  "logger": "l",', '  "ctx": {', '    "level": 0', "  },", '  "msg": "m"', "}", "tail", None, "{", "x"]
    got = parse(spark, lines)
    assert [(a, b, m) for a, b, _, _, _, m in got] == [(2, 4, 'a\n    | 2026-03-03T11:17:42Z ERROR db: inside\n{"k": 1}'), (5, 17, "m\ntail\n{\nx")]
    assert got[1][2:5] == (T0, "WARN", "l")


def test_chunks_give_what_one_piece_gives(spark, monkeypatch):
    lines = []
    for i in range(60):
        lines.append(f"2026-03-03T11:17:{i:02d}Z  INFO db: m{i}")
        lines += [f"more {i}"] * (i % 9)
        if i % 4 == 0:
            lines += ["{", f'  "ts": {T0 // 1000 + i},', '  "severity": "info",', '  "logger": "l",', '  "msg": "o"', "}"]
    whole = parse(spark, lines)
    monkeypatch.setattr(logparse, "CHUNK", 16)
    assert parse(spark, lines) == whole and len(whole) == 75


@pytest.mark.parametrize("offset", [1, 10, 15, 16, 17, 31, 40])
def test_long_objects_cross_pieces(spark, monkeypatch, offset):
    monkeypatch.setattr(logparse, "CHUNK", 16)
    monkeypatch.setattr(logparse, "SPAN", 8)
    thing = ["{", f'  "ts": {T0 // 1000},', '  "severity": "info",', '  "logger": "l",', *[f'  "k{i}": {i},' for i in range(700)], '  "msg": "o"', "}"]
    lines = ["2026-03-03T11:17:42Z  INFO db: a"] * offset + thing + ["tail"] + thing + ["2026-03-03T11:17:42Z  INFO db: z"]
    got = parse(spark, lines)
    assert [(a, b, m) for a, b, *_, m in got[offset:]] == [
        (offset + 1, offset + 707, "o\ntail"), (offset + 708, offset + 713 + 700, "o"), (offset + 1414, offset + 1414, "z"),
    ] and len(got) == offset + 3


def test_streams_of_objects_only(spark, monkeypatch):
    monkeypatch.setattr(logparse, "CHUNK", 16)
    monkeypatch.setattr(logparse, "SPAN", 2)
    thing = lambda i: ["{", f'  "ts": {T0 // 1000 + i},', '  "severity": "info",', '  "logger": "l",', f'  "msg": "o{i}"', "}", "x"]
    got = parse(spark, [t for i in range(40) for t in thing(i)])
    assert [(a, b, m) for a, b, *_, m in got] == [(7 * i + 1, 7 * i + 7, f"o{i}\nx") for i in range(40)]


@pytest.mark.parametrize("filler", [[json.dumps({f"k{100 * j + i}": 1 for i in range(100)}) for j in range(201)], ["{", *[f'  "k{i}": 1,' for i in range(20_001)], "}"]])
def test_types_of_any_number_of_keys(spark, filler):
    thing = lambda name: ["{", f'  "ts": {T0 // 1000},', '  "severity": "info",', f'  "logger": "{name}",', '  "msg": "m"', "}"]
    got = parse(spark, [*thing("a"), *thing("b"), *thing("c"), *filler, *thing("10")])
    assert [r[4] for r in got] == ["a", "b", "c", "10"] and [r[5] for r in got][-1] == "m"


def test_keys_of_a_line():
    assert {"aA", "c", "d"} <= set(logparse.names('  "a\\u0041": "b", "c" : 1, "d"'))
    assert logparse.names('"a": 1') == [] and logparse.names("") == []


def test_the_dictionary_decides(spark, monkeypatch):
    lines = [f"2026-03-03T11:17:{i:02d}Z  INFO db: m" for i in range(9)] + ["2026-03-03 11:17:42,000 [once] ERROR: seen once"]
    rows = spark.createDataFrame([("s", i, m, "") for i, m in enumerate(lines)], SCHEMA)
    assert [r.last_line_no for r in parse_logs(rows, least=3).orderBy("line_no").collect()] == [*range(8), 9]
    assert parse_logs(rows, least=11).collect() == []
    monkeypatch.setattr(logparse, "dictionary", lambda lines, least, ws: (spark.createDataFrame([], "head bigint, time int, level int, part int, last int"), spark.createDataFrame([], "key string, kind string")))
    assert parse_logs(rows, least=1).collect() == []


def test_constant_words_are_no_components(spark):
    lines = [f"2026-03-03T11:17:{i:02d}Z INFO worker {n} [pid {i}]: m" for i, n in enumerate(["alpha", "beta", "gamma", "delta"])]
    assert [r[4] for r in parse(spark, lines)] == ["alpha", "beta", "gamma", "delta"]


def test_long_keys_and_roles_by_type(spark):
    lines = [f"a_first_key_that_is_far_longer_than_forty_characters_are={i} when=2026-03-03T11:17:42Z weight=info unit=gc text=\"a b {i}\"" for i in range(3)]
    assert [r[2:] for r in parse(spark, lines)] == [(T0, "INFO", "gc", f"a b {i}") for i in range(3)]


def test_empty_repeats_and_nulls(spark):
    rows = [(None, 1, "x", ""), ("s", None, "x", ""), ("s", 1, None, ""), ("s", 2, "2026-03-03T11:17:42Z  INFO db: a", ""), ("s", 2, "2026-03-03T11:17:42Z  INFO db: a", "")]
    assert [r.line_no for r in parse_logs(spark.createDataFrame(rows, SCHEMA), least=1).collect()] == [2]
    assert parse_logs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_times():
    assert micros("2026-02-30T00:00:00Z") is None and micros("2026-03-03 06:17:42-05:00") == T0
    assert json.loads(json.dumps(micros("1772536662000"))) == T0
