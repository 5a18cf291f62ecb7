"""Log lines of mixed layouts into records (p2).

Every line is cut once into typed tokens. Its head is what runs up to the mark behind a time, a level and a word; a line of
named fields (an object or key=value pairs) is its keys with the types of their values. Distributed counts of the bigrams and
trigrams of all heads make the dictionary: an n-gram seen often enough makes a layout known, a word that fills at least half of
its place is constant, any other variable, and a key has the type that most of its values have. Each distinct head then gets its field
roles by type, and lines take the roles of their head by join. Lines without roles continue the entry before them.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import Workspace, spread, width

CHUNK, SPAN, SMALL = 4096, 16, 200_000
YEAR = 2026

# Level words and their letters.
LEVELS = {
    "trace": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "debug1": "DEBUG", "debug2": "DEBUG", "debug3": "DEBUG", "debug4": "DEBUG", "debug5": "DEBUG", "dbg": "DEBUG",
    "info": "INFO", "information": "INFO", "informational": "INFO", "log": "INFO", "notice": "INFO",
    "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "panic": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL",
}
LETTERS = {"T": "TRACE", "V": "TRACE", "D": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
TIME_KEYS = {"timestamp", "time", "ts", "@timestamp", "datetime", "date", "t"}
LEVEL_KEYS = {"level", "severity", "lvl", "loglevel", "levelname", "sev"}
PART_KEYS = {"target", "component", "logger", "module", "name", "source", "program", "app"}
TEXT_KEYS = {"message", "msg"}

COLOUR = re.compile("\x1b\\[[0-9;]*[A-Za-z]")
ZONE = r"(?:Z|z| ?UTC| ?GMT|[+-]\d\d:?\d\d)?"
TOKEN = re.compile(
    rf"(?P<TIME>\d{{4}}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{{1,9}})?{ZONE}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d\d:\d\d:\d\d(?:\.\d{1,9})?"
    r"|[TVDINWEFC](?:0[1-9]|1[0-2])[0-3]\d \d\d:\d\d:\d\d(?:\.\d{1,9})?(?!\S)"
    r"|(?<![\w.-])\d{13}(?![\w.-])|(?<![\w.-])\d{10}(?:\.\d{1,9})?(?![\w.-]))"
    r"|(?P<TEXT>\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<FILE>[\w./-]*[\w-]\.[A-Za-z]{1,4}:\d+)"
    r"|(?P<NUMBER>(?<![\w.:-])-?\d+(?:\.\d+)?(?![\w.:-]))"
    r"|(?P<WORD>\w(?:[\w.$/@-]|::)*)"
    r"|(?P<GAP>\s+)|(?P<MARK>.)"
)
PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$)')
BODY_FIELD = re.compile(r'\s+"((?:[^"\\]|\\.)*)"\s*:\s*(.*?),?\s*$')
OBJECT_OPEN, OBJECT_CLOSE = re.compile(r"\{\s*$"), re.compile(r"\}\s*,?\s*$")
OBJECT_BODY = re.compile(r'\s+(?:"(?:[^"\\]|\\.)*"\s*:\s*\S.*|[\]}]\s*,?\s*)$|\s+.*,\s*$')


def micros(text: str) -> int | None:
    """Microseconds since 1970 of any time the tokenizer accepts; without zone UTC, without year YEAR."""
    if not 10 <= len(text) <= 48 or not text[-1].isalnum() or " " not in text and not text[:4].isdigit():
        return None
    try:
        if text.isdigit() and len(text) == 13:
            return int(text) * 1000
        if re.fullmatch(r"\d{10}(\.\d+)?", text):
            whole, _, part = text.partition(".")
            return int(whole) * 1_000_000 + int(part[:6].ljust(6, "0") or 0)
        m = re.fullmatch(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?\s*(Z|z|UTC|GMT|[+-]\d\d:?\d\d)?", text)
        if m:
            y, mo, d, h, mi, s = map(int, m.groups()[:6])
            fine, zone = m[7] or "", m[8]
        elif m := re.fullmatch(r"([A-Z][a-z]{2}) +(\d{1,2}) (\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?", text):
            y, mo, d, h, mi, s, fine, zone = YEAR, MONTHS[m[1]], int(m[2]), int(m[3]), int(m[4]), int(m[5]), m[6] or "", None
        elif m := re.fullmatch(r"[A-Z](\d\d)(\d\d) (\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?", text):
            y, mo, d, h, mi, s, fine, zone = YEAR, int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), m[6] or "", None
        else:
            return None
        at = datetime(y, mo, d, h, mi, min(s, 59), tzinfo=timezone.utc) + timedelta(seconds=max(0, s - 59))
        shift = 0
        if zone and zone[0] in "+-":
            shift = (int(zone[1:3]) * 60 + int(zone[-2:])) * (60 if zone[0] == "+" else -60)
        return (int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) - shift) * 1_000_000 + int(fine[:6].ljust(6, "0") or 0)
    except (ValueError, OverflowError):
        return None


def level_of(text: str) -> str | None:
    return LEVELS.get(text.lower())


def head(line: str) -> tuple[list[str], list[str], list[int]] | None:
    """Types, texts and ends of the tokens up to the mark behind a time, a level and a word; None where the line lacks one of them.

    A time that begins with a level's letter counts as that level and the time.
    """
    kinds, texts, ends, pos = [], [], [], 0
    times = levels = words = 0
    while pos < len(line):
        m = TOKEN.match(line, pos)
        kind, text = m.lastgroup, m[0]
        pos = m.end()
        if kind == "WORD" and level_of(text):
            kind = "LEVEL"
        if kind == "TIME" and text[0] in LETTERS and text[1].isdigit():
            kinds.append("LEVEL")
            texts.append(text[0])
            ends.append(pos - len(text) + 1)
            levels += 1
        kinds.append(kind)
        texts.append(text)
        ends.append(pos)
        times += kind == "TIME"
        levels += kind == "LEVEL"
        words += kind in ("WORD", "FILE")
        if times and levels and words and kind == "MARK" and text in ":]-":
            while pos < len(line) and line[pos] in "]:)":
                kinds.append("MARK")
                texts.append(line[pos])
                pos += 1
                ends.append(pos)
            return kinds, texts, ends
        if not times and words > 1:
            return None
    return None


def terms(kinds: list[str], texts: list[str]) -> list[str]:
    """Tokens as dictionary terms: typed ones by their type, words and marks as they stand."""
    return [t if k in ("WORD", "MARK") else " " if k == "GAP" else k for k, t in zip(kinds, texts)]


def value_type(text: str) -> str:
    """The type of a field's value."""
    if micros(text) is not None:
        return "TIME"
    if level_of(text):
        return "LEVEL"
    if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null", text):
        return "NUMBER"
    return "TEXT" if not text or any(c.isspace() for c in text) else "WORD"


def code(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def scan_pairs(line: str) -> dict[tuple[str, ...], str]:
    """key=value pairs of a line, as far as it is made of them; the first value of a key counts."""
    out, pos = {}, 0
    while m := PAIR.match(line, pos):
        value = m[2]
        if value[:1] == '"':
            try:
                value = json.loads(value, strict=False)
            except ValueError:
                value = value[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        out.setdefault((m[1],), value)
        pos = m.end()
    return out


def first_pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """A decoded object in which the first value of a key counts."""
    out: dict[str, object] = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


DECODER = json.JSONDecoder(object_pairs_hook=first_pairs, parse_float=str, parse_int=str, parse_constant=str, strict=False)
WORDS = {True: "true", False: "false", None: "null"}


def flat(value: dict, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], str]:
    """Scalar fields of a decoded object by path, without those inside lists."""
    out: dict[tuple[str, ...], str] = {}
    for k, v in value.items():
        if isinstance(v, dict):
            for p, x in flat(v, (*path, k)).items():
                out.setdefault(p, x)
        elif not isinstance(v, list):
            out.setdefault((*path, k), v if isinstance(v, str) else WORDS[v])
    return out


STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
SCALAR = re.compile(r"[^\s,{}\[\]\"]+")


def scan_object(text: str) -> dict[tuple[str, ...], str]:
    """Scalar fields of a JSON object by path, up to where the text stops being one. Complete values only."""
    out: dict[tuple[str, ...], str] = {}
    path: list[str | None] = []
    key, expect, pos, n = None, "value", 0, len(text)
    while pos < n:
        c = text[pos]
        if c.isspace() or c == ",":
            if c == ",":
                expect = "key" if path and path[-1] is not None else "value"
            pos += 1
        elif c == "{":
            path.append(key if key is not None else "")
            key, expect = None, "key"
            pos += 1
        elif c == "[":
            path.append(None)
            expect = "value"
            pos += 1
        elif c in "}]":
            if not path:
                break
            path.pop()
            key, expect = None, "key"
            pos += 1
            if not path:
                break
        elif c == '"':
            m = STRING.match(text, pos)
            if not m:
                break
            try:
                value = json.loads(m[0], strict=False)
            except ValueError:
                break
            pos = m.end()
            if expect == "key":
                key, expect = value, "colon"
            else:
                if None not in path and key is not None:
                    out.setdefault((*[p for p in path[1:]], key), value)
                expect = "next"
        elif c == ":" and expect == "colon":
            expect = "value"
            pos += 1
        else:
            m = SCALAR.match(text, pos)
            if not m or expect != "value":
                break
            pos = m.end()
            if None not in path and key is not None and (pos < n or path == []):
                out.setdefault((*[p for p in path[1:]], key), m[0])
            expect = "next"
    return out



def named_fields(line: str) -> dict[tuple[str, ...], str] | None:
    """The fields of a line made of named fields, at least three; None for any other line."""
    if line[0] == "{":
        try:
            found = flat(DECODER.raw_decode(line)[0])
        except (ValueError, RecursionError):
            found = scan_object(line)
    else:
        found = scan_pairs(line) if PAIR.match(line) else {}
    return found if len(found) > 2 else None


def rank(paths: list[tuple[str, ...]], types: dict[str, str]) -> tuple[int, int, int, int] | None:
    """Positions of time, level, component and message among named fields, by the type each key has in the dictionary.

    Of several keys with the right type one whose name is usual for the role comes first, then the outermost, then the first.
    """
    roles = []
    for wanted, names in ((("TIME",), TIME_KEYS), (("LEVEL",), LEVEL_KEYS), (("WORD",), PART_KEYS), (("TEXT", "WORD", "NUMBER"), TEXT_KEYS)):
        fit = []
        for i, p in enumerate(paths):
            if len(p) <= 2 and i not in roles and (kind := types.get("/".join(p))) in wanted:
                usual = p[-1].lower() in names and (len(p) == 1 or p[0] == "fields")
                if usual or kind == wanted[0]:
                    fit.append((not usual, len(p), i))
        if not fit:
            return None
        roles.append(min(fit)[2])
    return tuple(roles)


def roles(kinds: list[str], texts: list[str], constant: list[bool]) -> tuple[int, int, int, int] | None:
    """Positions of time, level and component in a head, and of the token that ends the header.

    Before the time only marks, the level and constant words may stand. The component is the word or file nearest to the level that
    doesn't name what follows it: a constant word is passed over unless a mark stands right behind it.
    """
    time, level = kinds.index("TIME"), kinds.index("LEVEL")
    if any(k in ("WORD", "FILE", "TEXT", "NUMBER") and not constant[i] for i, k in enumerate(kinds[:time])):
        return None
    if any(t not in "[(<" for k, t in zip(kinds[:time], texts) if k == "MARK"):
        return None
    closed = lambda i: i + 1 < len(kinds) and kinds[i + 1] == "MARK"
    words = [i for i in range(len(kinds)) if kinds[i] in ("WORD", "FILE") and i > min(time, level) and not (constant[i] and not closed(i) and kinds[i] == "WORD")]
    words = words or [i for i in range(len(kinds)) if kinds[i] in ("WORD", "FILE") and i > min(time, level)]
    before, after = [i for i in words if i < level], [i for i in words if i > level]
    if not words or len(before) > 2:
        return None
    part = before[-1] if before and time < level else after[0] if after else before[-1]
    low, high = min(time, level, part), max(time, level, part)
    if any(t not in "[]:-()" for k, t in zip(kinds[low:high], texts[low:high]) if k == "MARK"):
        return None
    end = high
    while end + 1 < len(texts) and kinds[end + 1] == "MARK" and texts[end + 1] in "]:)":
        end += 1
    if end == high:
        if kinds[-1] != "MARK" or any(kinds[i] not in ("GAP", "MARK", "NUMBER") and not constant[i] for i in range(high + 1, len(kinds))):
            return None
        end = len(kinds) - 1
    return time, level, part, end


CUT = "log_stream string, line_no bigint, message string, head bigint, kinds array<string>, cells array<string>, stamps array<bigint>, ends array<int>, keys array<string>"
CUT_ARROW = pa.schema([
    ("log_stream", pa.string()), ("line_no", pa.int64()), ("message", pa.string()), ("head", pa.int64()), ("kinds", pa.list_(pa.string())), ("cells", pa.list_(pa.string())),
    ("stamps", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())),
])


def cut_line(raw: str) -> tuple:
    """(head, kinds, cells, stamps, ends, keys) of a line.

    Plain heads have ends, lines of named fields have keys (paths joined by ``/``); ``head`` numbers what must agree for two lines to have
    the same roles. A field of an object over several lines has its key, behind a ``~``, and type only. All are null for other lines.
    """
    nothing = (None,) * 6
    if not raw:
        return nothing
    if raw[0].isspace():
        m = BODY_FIELD.match(raw)
        if not m or not m[2] or m[2][0] in "{[":
            return nothing
        value = m[2][1:-1] if m[2][0] == '"' and m[2][-1] == '"' else m[2]
        return None, [value_type(value)], None, None, None, ["~" + m[1]]
    line = COLOUR.sub("", raw) if "\x1b" in raw else raw
    if not line or line[0].isspace():
        return nothing
    if fields := named_fields(line):
        keys = ["/".join(p) for p in fields]
        kinds = [value_type(v) for v in fields.values()]
        stamps = [micros(v) if k == "TIME" else None for k, v in zip(kinds, fields.values())]
        cells = [level_of(v) if k == "LEVEL" else v for k, v in zip(kinds, fields.values())]
        return code("named", *keys), kinds, cells, stamps, None, keys
    found = head(line)
    if found is None:
        return nothing
    kinds, texts, ends = found
    stamps = [micros(t) if k == "TIME" else None for k, t in zip(kinds, texts)]
    cells = [LETTERS.get(t) or level_of(t) if k == "LEVEL" else t for k, t in zip(kinds, texts)]
    return code("plain", *terms(kinds, texts)), kinds, cells, stamps, ends, None


def grams(words: list[str]):
    """(first position, bigram or trigram) of terms behind a start mark, which has position -1."""
    pad = ["^", *words]
    for n in (2, 3):
        for i in range(len(pad) - n + 1):
            yield i - 1, pad[i : i + n]


def masked(kinds: list[str], words: list[str]) -> list[str]:
    return ["WORD" if k == "WORD" else w for k, w in zip(kinds, words)]


def dictionary(lines: DataFrame, least: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Roles of heads, (head, time, level, part, last), and types of keys, (key, kind).

    Heads and keys are counted where they lie; n-grams, their counts and the verdicts are tables throughout. A plain head counts if each of
    its n-grams, words masked, is seen ``least`` times; a named one if it's made of keys seen as often.
    """
    plain = lines.where("ends is not null").groupBy("head").agg(F.count("*").alias("n"), F.first("kinds").alias("kinds"), F.first("cells").alias("cells"))
    plain = ws.save(plain, "heads")

    def explode(batches):
        for batch in batches:
            rows = []
            for h, n, kinds, cells in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = terms(kinds, cells)
                for (at, u), (_, m) in zip(grams(words), grams(masked(kinds, words))):
                    rows.append((h, n, at, len(u), code(*u), code("masked", *m)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], ["head", "n", "at", "size", "own", "mask"])

    spread_ = plain.select("head", "n", "kinds", "cells").mapInArrow(explode, "head bigint, n bigint, at int, size int, own bigint, mask bigint")
    found = ws.save(spread_, "grams")
    counts = found.select(F.col("own").alias("gram"), "n").union(found.select("mask", "n")).groupBy("gram").agg(F.sum("n").alias("count"))
    counts = ws.save(counts, "counts")
    near = found.join(counts.select(F.col("gram").alias("own"), F.col("count").alias("seen")), "own").join(counts.select(F.col("gram").alias("mask"), F.col("count").alias("room")), "mask")
    seen = near.groupBy("head").agg(F.collect_list(F.struct("at", "size", "seen", "room")).alias("counts"))

    def judge(batches):
        for batch in batches:
            rows = []
            for h, kinds, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                constant = [False] * len(kinds)
                for c in counts:
                    if 2 * c["seen"] >= c["room"]:
                        for i in range(max(0, c["at"]), c["at"] + c["size"]):
                            constant[i] = True
                if all(c["room"] >= least for c in counts) and (found := roles(kinds, cells, constant)):
                    rows.append((h, *found))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.int32()] * 4)], ["head", "time", "level", "part", "last"])

    verdicts = plain.join(seen, "head").select("head", "kinds", "cells", "counts").mapInArrow(judge, "head bigint, time int, level int, part int, last int")

    pairs = lines.where("keys is not null").select(F.explode(F.arrays_zip("keys", "kinds")).alias("p")).groupBy("p.keys", "p.kinds").agg(F.count("*").alias("n"))
    types = pairs.groupBy(F.col("keys").alias("key")).agg(F.max_by("kinds", F.struct("n", "kinds")).alias("kind"), F.sum("n").alias("n"), F.sum(F.when(F.col("kinds") == "TEXT", F.col("n"))).alias("long"))
    # a key that often holds phrases is text even where most of its values are single words
    kind = F.when((F.col("kind") == "WORD") & (F.col("long") * 4 >= F.col("n")), "TEXT").otherwise(F.col("kind"))
    types = ws.save(types.where(F.col("n") >= least).select("key", kind.alias("kind")), "types")
    layouts = lines.where("keys is not null and head is not null").groupBy("head").agg(F.first("keys").alias("keys"))
    known = layouts.select("head", "keys", F.posexplode("keys").alias("at", "key")).join(types, "key").groupBy("head").agg(F.first("keys").alias("keys"), F.collect_list(F.struct("key", "kind")).alias("types"))

    def settle(batches):
        for batch in batches:
            rows = []
            for h, keys, types in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if found := rank([tuple(k.split("/")) for k in keys], {t["key"]: t["kind"] for t in types}):
                    rows.append((h, *found))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.int32()] * 4)], ["head", "time", "level", "part", "last"])

    verdicts = verdicts.union(known.select("head", "keys", "types").mapInArrow(settle, "head bigint, time int, level int, part int, last int"))
    return ws.save(verdicts, "verdicts"), types


FIELDS = "log_stream string, line_no bigint, last_line_no bigint, ts_us bigint, log_level string, component string, message string"
RECORD = pa.schema([("log_stream", pa.string()), ("line_no", pa.int64()), ("last_line_no", pa.int64()), ("ts_us", pa.int64()), ("log_level", pa.string()), ("component", pa.string()), ("message", pa.string())])


def object_end(lines: list[str], i: int) -> int:
    """Index behind the multi-line object that opens at i: indented body lines and a closing brace at the margin."""
    j = i + 1
    while j < len(lines) and OBJECT_BODY.match(lines[j]):
        j += 1
    return j + (j < len(lines) and bool(OBJECT_CLOSE.fullmatch(lines[j])))


def names(line: str) -> list[str]:
    """What may be a key on a line of an object over several lines, wherever a string is taken to begin."""
    out, at = {}, line.find('"') if line[:1].isspace() else -1
    while at >= 0:
        if (m := STRING.match(line, at)) and line[m.end():].lstrip()[:1] in ("", ":"):
            try:
                out[json.loads(m[0], strict=False)] = None
            except ValueError:
                pass
        at = line.find('"', at + 1)
    return list(out)


def object_fields(lines: list[str], i: int, types: dict[str, str] | None, known: list):
    """(end, (ts_us, level, component, message)) of the entry whose object opens at line i; None where it's none.

    ``types`` are the frequent keys' types, or None where each line has those of its own keys in ``known``; a key without stands
    for what its own value looks like.
    """
    end = object_end(lines, i)
    if types is None:
        types = {k: t for pairs in known[i:end] for k, t in pairs or ()}
    fields = scan_object("\n".join(lines[i:end]))
    if len(fields) < 3:
        return None
    paths, values = list(fields), list(fields.values())
    own = {"/".join(p): types.get("~" + p[-1]) or value_type(v) for p, v in fields.items()}
    found = rank(paths, own)
    if found is None:
        return None
    ts, level = micros(values[found[0]]), level_of(values[found[1]])
    return (end, (ts, level, values[found[2]], values[found[3]])) if ts is not None and level else None


def parse_logs(logs: DataFrame, least: int = 3) -> DataFrame:
    """One row for each log entry: log_stream, line_no, last_line_no, ts_us, log_level, component, message.

    * Null messages, streams and line numbers are skipped; repeated lines (log_stream, line_no) count once, with the smallest
      message should they differ. Blank lines continue the entry before them. An empty table gives an empty result.
    * A layout counts once it is seen ``least`` times among all lines; fewer lines of it than that are continuation lines.
    * A stream is cut into pieces of CHUNK line numbers, each moved to where an entry surely begins: at its first line with a header, or
      in a piece without any at the first object that makes an entry. What lies before goes with the piece before. So no
      entry is ever cut and no task holds more than a piece and the entry that runs on behind it.
    """
    ws = Workspace(logs.sparkSession, "logs")
    clean = logs.where("log_stream is not null and line_no is not null and message is not null")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cols = list(zip(*map(cut_line, part.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, f.type) for c, f in zip(cols, list(CUT_ARROW)[3:])]], schema=CUT_ARROW)

    slim = clean.select("log_stream", F.col("line_no").cast("bigint").alias("line_no"), F.col("message").cast("string").alias("message"))
    lines = ws.save(spread(slim).mapInArrow(cut, CUT), "lines")
    verdicts, types = dictionary(lines, least, ws)
    n = verdicts.count()
    verdicts = F.broadcast(verdicts) if n <= SMALL else verdicts
    named = F.col("keys").isNotNull()
    cell = lambda c, i: F.get(c, F.col(i))
    bare = F.when(F.col("message").contains("\x1b"), F.regexp_replace("message", COLOUR.pattern, "")).otherwise(F.col("message"))
    part = F.when(cell("kinds", "part") == "FILE", F.regexp_extract(cell("cells", "part"), "^(.*):", 1)).otherwise(F.regexp_replace(cell("cells", "part"), ":+$", ""))
    rest = F.ltrim(F.substring(bare, cell("ends", "last") + 1, F.length(bare)))
    opens = F.col("message").rlike(r"^\{\s*$")
    heads = lines.where("head is not null").join(verdicts, "head", "left").select(
        "log_stream", "line_no", "message", cell("stamps", "time").alias("ts_us"), F.when(cell("kinds", "level") == "LEVEL", cell("cells", "level")).alias("log_level"),
        F.when(named, cell("cells", "part")).otherwise(part).alias("component"), F.when(named, cell("cells", "last")).otherwise(rest).alias("text"), opens.alias("opens"),
    )
    full = "ts_us is not null and log_level is not null and component is not null and component <> '' and text is not null"
    keep = lambda c: F.when(F.expr(full), F.col(c)).alias(c)
    heads = heads.select("log_stream", "line_no", "message", *[keep(c) for c in ("ts_us", "log_level", "component", "text")], "opens")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ts_us", "bigint"), ("log_level", "string"), ("component", "string"), ("text", "string"))]
    read = heads.union(lines.where("head is null").select("log_stream", "line_no", "message", *none, opens.alias("opens")))
    read = ws.save(read.withColumn("piece", F.floor(F.col("line_no") / CHUNK)), "read")
    frequent = _frequent(types)
    read = read.withColumn("known", F.lit(None).cast("map<string,string>")) if frequent is not None else _known(read, types, ws)

    def starts(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("line_no", "message", "known"))), key=lambda r: r[:2])
        nos, texts, known = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        first = next((nos[i] for i, t in enumerate(texts) if OBJECT_OPEN.fullmatch(t) and (got := object_fields(texts, i, frequent, known)) and got[0] < len(texts)), None)
        return pa.table({"log_stream": [key[0].as_py()], "piece": [nos[0] // CHUNK if first is None else first // CHUNK], "start": pa.array([first], pa.int64())})

    pieces = read.groupBy("log_stream", "piece").agg(F.min(F.when(F.col("ts_us").isNotNull(), F.col("line_no"))).alias("start"), F.bool_or("opens").alias("opens"))
    pieces = ws.save(pieces, "pieces")
    bare_pieces = pieces.where("start is null")
    if bare_pieces.where("opens").limit(1).count():
        headless = read.join(bare_pieces.select("log_stream", "piece"), ["log_stream", "piece"], "left_semi")
        wide = headless.select("log_stream", "line_no", "message", "known", F.floor(F.col("piece") / SPAN).alias("wide")).dropDuplicates(["log_stream", "line_no"])
        more = wide.repartition(width(logs.sparkSession), "log_stream", "wide").groupBy("log_stream", "wide").applyInArrow(starts, "log_stream string, piece bigint, start bigint")
        more = more.where("start is not null").withColumnRenamed("start", "more")
        pieces = ws.save(pieces.join(more, ["log_stream", "piece"], "left").select("log_stream", "piece", F.coalesce("start", "more").alias("start")), "pieces")
    order = Window.partitionBy("log_stream").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    homes = pieces.select("log_stream", "piece", "start", F.last(F.when(F.col("start").isNotNull(), F.col("piece")), True).over(order).alias("before"))
    homed = read.join(homes, ["log_stream", "piece"]).withColumn("home", F.when(F.col("line_no") >= F.col("start"), F.col("piece")).otherwise(F.coalesce("before", F.lit(-1))))

    def assemble(key, table):
        stream, rows = key[0].as_py(), {}
        for row in zip(*(table.column(c).to_pylist() for c in ("line_no", "message", "ts_us", "log_level", "component", "text", "known"))):
            if row[0] not in rows or row[1] < rows[row[0]][1]:
                rows[row[0]] = row
        ordered = [rows[k] for k in sorted(rows)]
        texts, known, out, i = [r[1] for r in ordered], [r[6] for r in ordered], [], 0
        while i < len(ordered):
            no, text, *found = ordered[i][:6]
            end = i + 1
            if OBJECT_OPEN.fullmatch(text) and (got := object_fields(texts, i, frequent, known)):
                end, found = got
            if found[0] is not None:
                out.append([stream, no, ordered[end - 1][0], *found[:3], [found[3]]])
            elif out:
                out[-1][2] = no
                out[-1][6].append(text)
            i = end
        cols = list(zip(*([*r[:6], "\n".join(r[6])] for r in out))) if out else [[]] * len(RECORD)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, RECORD)], schema=RECORD)

    homed = homed.select("log_stream", "home", "line_no", "message", "ts_us", "log_level", "component", "text", "known")
    return homed.repartition(width(logs.sparkSession), "log_stream", "home").groupBy("log_stream", "home").applyInArrow(assemble, FIELDS)


def _frequent(types: DataFrame, most: int = 20_000) -> dict[str, str] | None:
    """Types of keys for objects over several lines; None where there are more than ``most``: lines then take theirs by join."""
    found = types.where(F.startswith("key", F.lit("~"))).limit(most + 1).collect()
    return {r.key: r.kind for r in found} if len(found) <= most else None


def _known(read: DataFrame, types: DataFrame, ws: Workspace) -> DataFrame:
    """Lines with the types of the keys that they may hold."""
    line = ["log_stream", "line_no", "message"]

    def held(batches):
        for batch in batches:
            found = [names(m) for m in batch.column(2).to_pylist()]
            at = pa.array([i for i, keys in enumerate(found) for _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(["~" + k for keys in found for k in keys], pa.string())], [*line, "key"])

    pairs = read.select(*line).mapInArrow(held, "log_stream string, line_no bigint, message string, key string").join(types, "key")
    known = pairs.groupBy(*line).agg(F.map_from_entries(F.collect_set(F.struct("key", "kind"))).alias("known"))
    return ws.save(read.join(known, line, "left"), "known")
