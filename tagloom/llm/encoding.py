"""Garbled text from wrong character encodings: affected values and, where it can be had, the text as it was.

Method: a table of garbled forms. Every distinct clean word of the corpus is
passed through all encoding chains (written in one encoding, read in another,
once or twice, or with characters lost), and the tokens of the texts are
hash-joined with that table; the most credible original is substituted. Words
that the corpus holds only in garbled form enter the table through their own
inverse: a candidate is admitted if it is built of letter pairs that clean words
use, and then passes the same join. A check of each joined pair follows.

All work is on distinct tokens; only tokens that can be garbled at all (with a
character outside printable ASCII, or '?') take part, so the frequent plain
words never become hot keys.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.textfold import BLANKS, INVISIBLE, LOOKALIKE_CYRILLIC, LOOKALIKE_GREEK
from tagloom.session import cut, small_rows

# Fixed values: (written in, read in).
MULTIBYTE = ["utf-8", "shift_jis", "euc_jp", "euc_kr", "gbk", "big5"]
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_7"]
SINGLE = {
    "cp1252": ["cp1251", "cp1253", "cp1250", "cp437", "cp850", "mac_roman", "koi8_r", "iso8859_7", "iso8859_5", "cp866", "cp1254"],
    "cp1250": ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"],
    "iso8859_2": ["cp1252", "latin-1", "cp1251"],
    "cp1254": ["cp1252", "latin-1", "cp1251"],
    "cp1251": ["cp1252", "latin-1", "koi8_r", "mac_roman", "cp437", "cp866", "cp1253", "iso8859_5"],
    "koi8_r": ["cp1251", "cp1252", "latin-1", "cp866"],
    "cp866": ["cp1251", "cp1252", "latin-1", "koi8_r"],
    "iso8859_5": ["cp1252", "latin-1", "cp1251"],
    "cp1253": ["cp1252", "latin-1", "cp1251", "cp437"],
    "iso8859_7": ["cp1252", "latin-1", "cp1251"],
    "cp737": ["cp1253", "cp1252"],
    "mac_roman": ["cp1252", "latin-1", "cp437", "cp1251"],
    "cp437": ["cp1252", "latin-1", "mac_roman"],
    "cp850": ["cp1252", "latin-1", "mac_roman"],
    "mac_cyrillic": ["cp1251", "cp1252"],
}
TWICE = ["latin-1", "cp1252", "cp1251", "mac_roman"]

#: Pairs of letters that clean words use; an alphabet has no more.
MAX_PAIRS = 400_000
#: A pair counts as used when this many distinct words have it.
PAIR_WORDS = 3
#: At most this many lost characters are tried in all combinations; words with more lose all or one.
LOST = 4

#: Token separators: the blank, and the blank of byte-swapped UTF-16.
SEPARATOR = "[ \u2000]+"
#: Marks of writing systems that may stand around a word.
_MARKS = "\u00bf\u00a1\u00ab\u00bb\u201c\u201d\u2018\u2019\u201e\u2026"
_POSSIBLE = r"[^\x01-\x7e]|\?"
_WIDE = r"(?s)(?:[^\x00]\x00){3}|(?:\x00[^\x00]){3}"
_EDGE = "()[]{}\"'.,;:!/&|+*-"


@cache
def _high(encoding: str) -> str:
    """Characters of bytes 0x80..0xFF; bytes without one stay control characters, as lenient readers have it."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256))


@cache
def _to_byte(encoding: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_high(encoding), 128)}


def _read(data: bytes, encoding: str) -> str:
    high = _high(encoding)
    return "".join(chr(b) if b < 128 else high[b - 128] for b in data)


def _unread(text: str, encoding: str) -> bytes | None:
    table = _to_byte(encoding)
    out = bytearray()
    for ch in text:
        b = ord(ch) if ord(ch) < 128 else table.get(ch)
        if b is None:
            return None
        out.append(b)
    return bytes(out)


def _write(word: str, encoding: str) -> bytes | None:
    try:
        return word.encode(encoding)
    except UnicodeEncodeError:
        return None


def garbled_forms(word: str) -> dict[str, str]:
    """form -> kind for all chains. Kinds: 'multi' (multi-byte text read bytewise), 'wide' (UTF-16), 'single', 'lost'."""
    forms: dict[str, str] = {}
    swapped = "".join(chr((ord(c) & 0xFF) << 8 | ord(c) >> 8) for c in word if ord(c) < 0x10000)
    if len(swapped) == len(word):
        if not any(0xD800 <= ord(c) < 0xE000 for c in swapped):
            forms[swapped] = "wide"
        wide = _read(word.encode("utf-16-le"), "latin-1").strip("\x00")
        forms[wide] = "wide"
        forms[_read(word.encode("utf-16-be"), "latin-1").strip("\x00")] = "wide"
    high = [i for i, c in enumerate(word) if ord(c) > 127]
    if high:
        for enc, readers in SINGLE.items():
            data = _write(word, enc)
            if data is not None:
                for r in readers:
                    forms[_read(data, r)] = "single"
        for enc in MULTIBYTE:
            data = _write(word, enc)
            if data is None:
                continue
            for r in READ_AS:
                once = _read(data, r)
                forms[once] = "multi"
                if enc == "utf-8" and r in TWICE:
                    again = once.encode("utf-8", "ignore")
                    for r2 in TWICE:
                        forms[_read(again, r2)] = "multi"
        sets = [c for k in range(1, len(high) + 1) for c in itertools.combinations(high, k)] if len(high) <= LOST else [tuple(high), *[(i,) for i in high]]
        for mark in "?�":
            for gone in sets:
                forms["".join(mark if i in gone else c for i, c in enumerate(word))] = "lost"
            for enc in MULTIBYTE[:1]:
                forms["".join(mark * len(c.encode(enc)) if ord(c) > 127 else c for c in word)] = "lost"
    forms.pop(word, None)
    forms.pop("", None)
    return forms


def originals(token: str) -> dict[str, str]:
    """word -> kind for every chain that could have produced the token."""
    found: dict[str, str] = {}
    if len(token) > 2 and (set(token[1::2]) == {"\x00"} or set(token[0::2]) == {"\x00"}):
        try:
            found[(token.strip("\x00") + "\x00").encode("latin-1").decode("utf-16-le")] = "wide"
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    if all(0 < ord(c) < 0x10000 for c in token):
        back = [(ord(c) & 0xFF) << 8 | ord(c) >> 8 for c in token]
        if not any(0xD800 <= x < 0xE000 for x in back) and all(x < 0x250 or 0x370 <= x < 0x460 for x in back) and any(ord(c) > 0x500 for c in token):
            found["".join(map(chr, back))] = "wide"
    for r in READ_AS:
        data = _unread(token, r)
        if data is None:
            continue
        for enc in MULTIBYTE:
            try:
                w = data.decode(enc)
            except UnicodeDecodeError:
                continue
            found[w] = "multi"
            if enc == "utf-8":
                for r2 in TWICE:
                    inner = _unread(w, r2)
                    if inner is not None and any(b > 127 for b in inner):
                        try:
                            found[inner.decode("utf-8")] = "multi"
                        except UnicodeDecodeError:
                            pass
        for enc, readers in SINGLE.items():
            if r in readers:
                w = _read(data, enc)
                if not any(0x80 <= ord(c) < 0xA0 for c in w):
                    found.setdefault(w, "single")
    found.pop(token, None)
    return found


@cache
def _script(ch: str) -> str:
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "?").split()[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH") else name


def sound(word: str) -> bool:
    """Does the token look like a word: letters of one script in ordinary case, with plain marks only."""
    word = word.strip(_MARKS)
    letters = [c for c in word if c.isalpha()]
    if not letters or any(not (c.isalnum() or c in "'\u2019-.\u30fc") or 0x80 <= ord(c) < 0xA0 for c in word):
        return False
    scripts = {_script(c) for c in letters}
    if len(scripts) > 1 or not scripts <= {"LATIN", "CYRILLIC", "GREEK", "HANGUL", "EAST"}:
        return False
    if any(c in "\u00aa\u00ba\u2044\u207f" or 0xFF00 <= ord(c) or 0x1D400 <= ord(c) for c in word):
        return False
    if scripts == {"EAST"} and any(0x3400 <= ord(c) < 0x4E00 for c in word):
        return False
    text = "".join(letters)
    return text.islower() or text.isupper() or (text[0].isupper() and text[1:].islower()) or text.lower() == text.upper() or all(p.islower() or p.isupper() or p.istitle() for p in word.replace("-", "'").split("'") if p)


def pairs(word: str) -> list[str]:
    w = f"^{word.lower()}$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


def bare(token: Column) -> Column:
    """Token without byte order marks, NULs and marks of punctuation around it."""
    t = F.regexp_replace(token, r"^(?:\u00ff\u00fe|\u00fe\u00ff|\ufffe)", "")
    t = F.regexp_replace(t, r"^\x00+|\x00+$", "")
    edge = F.regexp_replace(t, r"""^[()\[\]{}"'.,;:!/&|+*\-]+|[()\[\]{}"'.,;:!/&|+*\-]+$""", "")
    return F.when(edge == "", t).otherwise(edge)


def tokens(values: DataFrame, value: str) -> DataFrame:
    """Adds ``token``, one row per token that can be garbled. Raw tokens stand beside the ones without outer marks."""
    parts = F.filter(F.split(value, SEPARATOR), lambda x: x.rlike(_POSSIBLE))
    both = F.array_distinct(F.flatten(F.transform(parts, lambda x: F.array(x, bare(x)))))
    return values.withColumn("token", F.explode(both)).where("token <> ''")


def _settle(token: str) -> str:
    """The token with Latin look-alikes turned into the Cyrillic or Greek script that its other letters have."""
    scripts = {_script(c) for c in token} - {"", "LATIN"}
    for looks, name in ((LOOKALIKE_CYRILLIC, "CYRILLIC"), (LOOKALIKE_GREEK, "GREEK")):
        if scripts == {name}:
            back = {b: a for a, b in looks.items()}
            return "".join(back.get(c, c) if _script(c) == "LATIN" else c for c in token)
    return token


def _compat(token: str) -> str:
    """The token without invisible characters, composed and in ordinary width; raised and other special letters stay."""
    width = "".join(c if unicodedata.decomposition(c)[:5] in ("<supe", "<sub>", "<frac") else unicodedata.normalize("NFKC", c) for c in token if c not in INVISIBLE)
    return unicodedata.normalize("NFC", width)


def _unmask(token: str) -> str:
    """The token with look-alike letters as Latin ones and without invisible characters."""
    looks = LOOKALIKE_CYRILLIC | LOOKALIKE_GREEK
    return "".join(looks.get(c, c) for c in _compat(token))


def credible(word: str, known: dict[str, int]) -> float:
    """Mean log count of the letter pairs of a word; minus infinity where one is unknown."""
    counts = [known.get(p, 0) for p in pairs(word.strip(_MARKS))]
    return sum(map(math.log, counts)) / len(counts) if all(counts) else -math.inf


def symbol(token: str) -> bool:
    return len(token) == 1 and unicodedata.category(token) in ("Sc", "Pd") and ord(token) > 127


def _table_rows(words: Iterator[tuple[str, int]], known: dict[str, int]) -> Iterator[tuple[str, str, int, str]]:
    """(form, word, n, kind): garbled forms of clean words, and inverse candidates of the others (n = 0)."""
    for word, n in words:
        good = sound(word.strip(_EDGE) or word)
        likely = good and credible(word, known) > -math.inf
        if good and "?" not in word and (n > 1 or likely) or symbol(word) and n > 1:
            variants = {word, word.upper(), word.lower(), word[:1].upper() + word[1:].lower()}
            for v in variants:
                for form, kind in garbled_forms(v).items():
                    yield form, v, n, kind
        if not likely:
            for w, kind in originals(word).items():
                core = w.strip(_EDGE)
                if not core or core.strip(_MARKS) != core or not sound(core) or not (kind == "wide" or any(ord(c) > 127 for c in core)):
                    continue
                east = all(_script(c) in ("EAST", "HANGUL", "") for c in core)
                if kind == "wide" or credible(core, known) > -math.inf or kind == "multi" and not good and (east or len(core) < len(word)):
                    yield word, w, 0, kind


def judge(token: str, n: int, word: str, n_word: int, kind: str, known: dict[str, int]) -> int:
    """Credit of the pair (token, original); 0 rejects it. The check that follows the join."""
    if token.strip(_EDGE) != token and sound(token.strip(_EDGE)):
        return 0  # its bare form is judged by itself
    odd = not sound(token) and not symbol(token)
    in_corpus = 10 if n_word else 0
    if kind == "wide":
        return (30 if word.isascii() else 5) if not sound(token) or _script(token[0]) == "EAST" else 0
    if kind == "lost":
        inside = "?" in token.rstrip("?")
        return in_corpus + 3 if "\ufffd" in token or inside or n_word >= 2 and token.count("?") == 1 else 0
    if odd:
        clear = _compat(token).strip()
        plains = [x for x in {clear, _unmask(token).strip(), _settle(clear)} if x != token and all(sound(w.strip(_EDGE)) or w.isascii() for w in x.split())]
        if plains and not n_word:
            return 0  # odd blanks, invisible characters, widths or look-alike letters explain it
        if plains and kind != "multi" and credible(word, known) <= max(credible(x, known) for x in plains):
            return 0
        return in_corpus + (6 if kind == "multi" else 4)
    # the token reads like a word: the original must be far more usual
    if len(token) < 3 or n_word and n_word < 3 * n or all(_script(c) == "EAST" for c in word) and not n_word:
        return 0
    usual = credible(word, known)
    if usual == -math.inf and n_word >= 5:
        usual = 0.0  # an unusual word that the corpus holds often
    better = usual - credible(token, known) if usual > -math.inf else -math.inf
    if _script(word[0]) in ("EAST", "HANGUL"):
        better = math.log(12) if n_word else -math.inf
    if n_word and (better > math.log(3) or n_word > 10 * n and better > 0):
        return in_corpus + 2
    apart = _script(word[0]) != _script(token[0])
    return 1 if not n_word and apart and better > math.log(10) and _settle(_unmask(token)) == token else 0


def spread(df: DataFrame, col: str, rows: int) -> DataFrame:
    """``df`` in so many partitions as its rows are worth; a number that is stated is not merged again at run time."""
    tasks = min(max(df.sparkSession.sparkContext.defaultParallelism, rows // 50_000), max(1, rows // 500))
    return df.repartition(tasks, F.col(col))


def _clean_words(distinct: DataFrame) -> DataFrame:
    """(token, n): the tokens that look like words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([sound(t) for t in b.column(0).to_pylist()], pa.bool_()))

    return distinct.select("token", "n").mapInArrow(run, "token string, n long")


def garbled_tokens(distinct: DataFrame, ascii_words: DataFrame) -> DataFrame:
    """(token, original, in_corpus): tokens of ``distinct`` (token, n) that are garbled.

    ``original`` is null where characters are lost for good. ``in_corpus`` is false where the original is no word of
    the corpus but the token's own inverse. ``ascii_words`` (token, n) are the words whose only garbled forms are wide.
    """
    rows = distinct.count()
    clean = _clean_words(spread(distinct, "token", rows)).select("token", "n", F.concat(F.lit("^"), F.lower("token"), F.lit("$")).alias("w"))
    used = (
        clean.where(~F.col("w").rlike("[\\u2e80-\\ud7ff]"))
        .select(F.explode(F.expr("array_distinct(transform(sequence(1, length(w) - 1), i -> substring(w, i, 2)))")).alias("p"), "n")
        .groupBy("p")
        .agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        .where(F.col("words") >= PAIR_WORDS)
        .select("p", "n")
    )
    known = {r[0]: r[1] for r in small_rows(used, MAX_PAIRS)}

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = _table_rows(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), known)
            while chunk := list(itertools.islice(made, 50_000)):
                form, word, n, kind = zip(*chunk)
                yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(kind, pa.string())], ["form", "word", "n_word", "kind"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            credit = [judge(*row, known) for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(credit, pa.int32())], ["token", "word", "n_word", "credit"])

    # the words may be few and the forms many: they are spread before the table is made
    forms = spread(distinct, "token", rows).mapInArrow(table, "form string, word string, n_word long, kind string").unionByName(_wide_forms(ascii_words))
    pairs_ = distinct.join(forms, distinct["token"] == forms["form"]).groupBy("token", "n", "word", "kind").agg(F.max("n_word").alias("n_word")).select("token", "n", "word", "n_word", "kind")
    judged = pairs_.mapInArrow(check, "token string, word string, n_word long, credit int").where("credit > 0")
    best = judged.groupBy("token").agg(F.max(F.struct("credit", "n_word", "word")).alias("best")).select("token", F.col("best.word").alias("original"), (F.col("best.n_word") > 0).alias("in_corpus"))
    gone = distinct.where(F.col("token").contains("�") | F.col("token").rlike(r"\p{L}\?+\p{L}|^\?+\p{L}")).select("token", F.lit(None).cast("string").alias("original"), F.lit(False).alias("in_corpus"))
    # the exchange is stated: after a union of inputs that are partitioned alike, Spark 4.1 may leave it out and group them apart
    return best.unionByName(gone).repartition("token").groupBy("token").agg(F.max("original").alias("original"), F.max("in_corpus").alias("in_corpus"))


def _wide_forms(words: DataFrame) -> DataFrame:
    """(form, word, n_word, kind): ASCII words written as UTF-16 and read bytewise, or with their bytes swapped."""
    letters = F.split("token", "")
    interleaved = F.array_join(letters, "\x00")
    swapped = F.decode(F.encode("token", "UTF-16LE"), "UTF-16BE")
    return words.where(F.length("token") > 1).select(F.explode(F.array(interleaved, swapped)).alias("form"), F.col("token").alias("word"), F.col("n").alias("n_word"), F.lit("wide").alias("kind"))


def _ascii_words(values: DataFrame, value: str) -> DataFrame:
    """(token, n): the distinct words without a character outside ASCII, where the table holds texts read as UTF-16 at all."""
    words = values.select(F.explode(F.split(value, "[ \\x00]+")).alias("token")).where(F.col("token").rlike("^[\\x21-\\x7e]+$"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


FIELDS = ["title", "artist", "album"]


def long_fields(tags: DataFrame, fields: list[str]) -> DataFrame:
    """(rec_id, fieldname, value) of the non-null fields; other columns are not read."""
    structs = [F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("value")) for f in fields]
    return tags.select("rec_id", F.inline(F.array(*structs))).where("value IS NOT NULL")


def garbled_values(tags: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(rec_id, fieldname, value, repaired, in_corpus): values with at least one garbled word.

    ``repaired`` has the originals in place of the garbled words; words whose
    characters are lost stay as they are. ``in_corpus`` is true where every
    original is a clean word of the corpus, false where one was had only by
    decoding the garbled word itself, or is lost. Null and empty values, values without
    words and empty tables give no rows; repeated rows give their case once.
    """
    values = long_fields(tags, fields).where(F.col("value").rlike(_POSSIBLE))
    found = tokens(values, "value")
    distinct = cut(found.groupBy("token").agg(F.count("*").alias("n")))
    bad = cut(garbled_tokens(distinct, _ascii_words(long_fields(tags, fields), "value")))
    hits = found.join(bad, "token").groupBy("rec_id", "fieldname", "value").agg(F.collect_list(F.struct("token", "original")).alias("w"), F.min("in_corpus").alias("in_corpus"))
    known = F.map_from_entries(F.array_distinct(F.filter("w", lambda x: x["original"].isNotNull())))
    word = F.transform(F.split("value", SEPARATOR), lambda x: F.coalesce(F.try_element_at(known, x), F.when(F.try_element_at(known, bare(x)).isNotNull(), F.replace(x, bare(x), F.try_element_at(known, bare(x)))), x))
    return hits.select("rec_id", "fieldname", "value", F.when(F.col("value").rlike(_WIDE), F.replace(F.array_join(word, " "), F.lit("\x00"), F.lit(""))).otherwise(F.array_join(word, " ")).alias("repaired"), "in_corpus")
