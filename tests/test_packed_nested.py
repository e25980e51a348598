import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import packed as P
from tagloom.operators.nested import flatten_batch, flatten_records

ROSTER = ["Chimney, Mirror & Promise", "FE/WE", "Fenken and the Ferrys", "Plain Name"]
GENRES = ["Soul, Funk & Brass", "Drum/Step", "Hymnody", "Slowcore"]


def items(spark, values, f, names):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"), names)).collect()]


def test_artists(spark):
    cases = {
        "A B;C D": ["A B", "C D"],
        "A & B feat. C": ["A", "B", "C"],
        "Chimney, Mirror & Promise; FE/WE / X": ["Chimney, Mirror & Promise", "FE/WE", "X"],
        "ＦＥ／ＷＥ": ["ＦＥ／ＷＥ"],
        "chimney,  mirror & prom​ise feat. Y": ["chimney,  mirror & prom​ise", "Y"],
        '"A; B", C': ["A; B", "C"],
        '"He said ""x""";Z': ['He said "x"', "Z"],
        'X \\"q\\"; Y': ['X "q"', "Y"],
        "A (with B & C)": ["A", "B", "C"],
        "Fenken and the Ferrys": ["Fenken and the Ferrys"],
        "A;;B; ": ["A", "B"],
        "A": ["A"],
        "A;A": ["A", "A"],
        "": [],
        "T\0h\0e\0": ["T\0h\0e\0"],
        'odd "quote; B': ['odd "quote', "B"],
    }
    assert items(spark, list(cases), P.artist_items, ROSTER) == list(cases.values())
    assert items(spark, [None], P.artist_items, ROSTER) == [None]


def test_genres(spark):
    cases = {
        '["Hymnody", "Soul, Funk & Brass"]': ["Hymnody", "Soul, Funk & Brass"],
        "[Hymnody, Slowcore]": ["Hymnody", "Slowcore"],
        "(27)Soul, Funk & Brass": ["(27)Soul, Funk & Brass"],
        "Drum/Stpe": ["Drum/Stpe"],
        "n/a 5": ["n/a 5"],
        "Hymnody\nSoul, Funk & Brass": ["Hymnody", "Soul, Funk & Brass"],
        "Hymnody\\\\Slowcore": ["Hymnody", "Slowcore"],
    }
    assert items(spark, list(cases), P.genre_items, GENRES) == list(cases.values())


def test_packed_rows(spark):
    tags = spark.createDataFrame([(1, "A;B", "Hymnody", "x"), (2, None, None, "y"), (3, "A" * 50000 + ";B", " ", "z")], "rec_id long, artist string, genre string, items string")
    roster, genres = spark.createDataFrame([(n,) for n in ROSTER], "artist_name string"), spark.createDataFrame([(g,) for g in GENRES], "genre_name string")
    got = P.packed_rows(tags, roster, genres).collect()
    assert sorted((r["rec_id"], r["pos"]) for r in got) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert P.packed_rows(tags.limit(0), roster, genres.limit(0)).count() == 0


def refuse(name):
    raise ValueError(name)


def decode(text):
    try:
        return json.loads((text or "").lstrip("\ufeff"), parse_constant=refuse, parse_int=str, parse_float=str)
    except ValueError:
        return None


def find_record(value):
    """Outermost object with a member of a record; only then those in strings."""
    queue, strings = [value], []
    for v in queue:
        if isinstance(v, str):
            strings.append(v)
        elif isinstance(v, dict):
            if {"native", "format", "common", "quality"} & v.keys():
                return v
            queue.extend(v.values())
        elif isinstance(v, list):
            queue.extend(v)
    for v in strings:
        if v.strip()[:1] in ("{", "[", '"') and v.strip() and (r := find_record(decode(v))) is not None:
            return r
    return None


def brute(payload):
    """Recursive walk of one payload."""
    r = find_record(decode(payload))
    out = []
    if r is None:
        return out

    def objs(v):
        return [v] if isinstance(v, dict) else [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []

    def text(v):
        return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "J"

    native, formats = r.get("native"), {}
    if isinstance(native, dict) and isinstance(native.get("type"), str) and "tags" in native:
        native = [native]
    for e in [native] if isinstance(native, dict) else native if isinstance(native, list) else []:
        if not isinstance(e, dict):
            continue
        if isinstance(e.get("type"), str) and not e is native:
            formats.setdefault(e["type"], []).extend(objs(e.get("tags")))
        elif e is native or "type" not in e and "tags" not in e:
            for name, tags in e.items():
                formats.setdefault(name, []).extend(objs(tags))
    out += [("tag", name, i, text(t.get("id"))) for name, tags in formats.items() for i, t in enumerate(tags)]

    def chap(v, path):
        for i, c in enumerate(objs(v)):
            out.append(("chapter", ".".join(path), i, text(c.get("title"))))
            chap(c.get("chapters"), [*path, str(i)])

    chap(r["format"].get("chapters") if isinstance(r.get("format"), dict) else None, [])
    return out


def any_value(rng, depth):
    k = rng.random()
    if depth <= 0 or k < 0.3:
        return rng.choice([None, True, 1, -2.5, 1e30, "", "x", 'a"b\\c\n\t', "é\u0301😀", "{", "[1,", "null", json.dumps({"native": {"z": [{"id": "q"}]}}), json.dumps(json.dumps({"format": {"chapters": [{"title": "t"}]}}))])
    names = ["native", "format", "chapters", "id", "title", "type", "tags", "record", 'com"mon']
    if k < 0.75:
        return {rng.choice(names): any_value(rng, depth - 1) for _ in range(rng.randint(0, 5))}
    return [any_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_any_shape_and_damage():
    """Random nesting, spacing, escapes and damage against the recursive walk."""
    rng, payloads = random.Random(1), []
    for _ in range(4000):
        p = json.dumps(any_value(rng, 7), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]), separators=rng.choice([None, (",", ":")]))
        if rng.random() < 0.4:
            k = rng.randint(0, len(p))
            p = rng.choice([p[:k], p[:k] + rng.choice('{}[]",:\\x0 ') + p[k:], p[:k] + p[k + 1 :], "\ufeff" + p, p + " ", p + p])
        payloads.append(p)
    payloads += ["{", "]", "1 2", "tru", '"\\ud83d"', '{"nat\\u0069ve": {"A": [{"\\u0069d": "\\ud83d\\ude00\\/"}]}}', '{"native": {"A": [{"id": "a\x01"}]}}', '{"native": {"A": [{"id": 01}]}}', '{"native": {"A": {"id": "x"}},}']
    got = [[] for _ in payloads]
    for b in flatten_batch(pa.array(range(len(payloads)), pa.int64()), pa.array(payloads, pa.string())):
        for i, kind, key, pos, name in zip(*[c.to_pylist() for c in b.columns]):
            got[i].append((kind, key, pos, "J" if name[:1] in ("{", "[") and name not in ("{", "[1,") and "native" not in name and "format" not in name or name[:1].isdigit() or name[:1] == "-" else name))
    want = [[(*r[:3], "J") if r[3][:1].isdigit() or r[3][:1] == "-" else r for r in brute(p)] for p in payloads]
    differ = [p for p, g, w in zip(payloads, got, want) if sorted((r[:3] for r in g)) != sorted((r[:3] for r in w)) or {r for r in w if r[3] != "J"} - set(g)]
    assert not differ, differ[:3]


def test_nested(spark):
    rec = {"format": {"chapters": [{"title": "a", "chapters": {"title": "b", "chapters": [{"title": None}, {}]}}, {"title": "c"}]}, "native": {"ID3v1": [{"id": "t", "value": 1}, {"value": {"x": []}}], "x": {"id": "one"}}}
    listed = {"native": [{"type": "vorbis", "tags": [{"id": "T"}]}, {"type": "asf", "tags": None}], "format": None}
    payloads = [json.dumps(rec), json.dumps({"result": {"items": [listed]}}), json.dumps(json.dumps({"record": rec})), json.dumps({"native": ["ID3v1"]}), json.dumps(rec)[:-3], json.dumps(rec) + "x", "", None, " ", "[]", "3", '"', '{"native": {"a": [NaN]}}', json.dumps(None)]
    df = spark.createDataFrame([(i, p, "k") for i, p in enumerate(payloads)], "raw_id long, payload string, kind string")
    got = sorted(tuple(r) for r in flatten_records(df).collect())
    assert got == sorted((i, *x) for i, p in enumerate(payloads) for x in brute(p))
    assert (0, "chapter", "0.0", 1, "") in got and (1, "tag", "vorbis", 0, "T") in got
    assert flatten_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 50])
def test_deep_chapters(spark, depth):
    c = None
    for i in range(depth):
        c = [{"title": str(i), "chapters": c}]
    df = spark.createDataFrame([(1, json.dumps({"format": {"chapters": c}}))], "raw_id long, payload string")
    assert flatten_records(df).count() == depth
