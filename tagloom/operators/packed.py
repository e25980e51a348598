"""Several values packed in one field: one row per value, position kept.

Method: the field is split on quote characters; odd pieces are literals, even
pieces are split on delimiters; SQL array folds put protected names together
again and number the values. The whole operator is a projection: it needs no
shuffle, so skewed values cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.textfold import JAVA_BLANK, fold_key, fold_key_py, strip_blanks
from tagloom.session import small_rows

_CUT, _LIT, _QUOTE = "\ue001", "\ue002", "\ue003"
_B = f"[{JAVA_BLANK}]"

#: Marks that separate values in any field.
MARKS = r"(?:\\\\|//|\|\||[;；/／|｜,，\x00\n\r\t])"
#: Words and signs that join names of people, blanks on both sides; the bracketed form may open with one.
JOINERS = r"(?:featuring|feat\.?|ft\.?|versus|vs\.?|with|and|[&＆]|[+＋]|x|×)"
_OPENERS = r"(?:featuring|feat\.?|ft\.?|with)"

MARKS_ONLY = f"{_B}*{MARKS}{_B}*"
MARKS_AND_JOINERS = f"(?i){_B}*[(（]{_OPENERS}{_B}+|{_B}+{JOINERS}{_B}+|{_B}*{MARKS}{_B}*"

#: A text whose bytes were UTF-16: every other character is NUL, which then separates nothing.
_WIDE = r"(?s)(?:[^\x00]\x00){3}|(?:\x00[^\x00]){3}"

#: What may stand around one genre in the key of a field: a number in brackets, a label, a remark.
_GENRE_TRIM = r"^(?:\(\d+\)|genre:|pure)+|(?:music|[!*.?]|\(\w*\)|\[\w*\]|-misc)+$"

#: A free text that holds a mark and still names no list.
_NOTHING = r"(?i)^\s*n\s*/\s*a(?:\s+\d+)?\s*$"

#: Dimension tables with more rows than this are refused rather than sent to every task.
MAX_PROTECTED = 200_000


def protected_keys(names: list[str], delimiter: str) -> tuple[list[str], int]:
    """Keys of the names that a split by ``delimiter`` would cut, and the most pieces one falls into."""
    import re

    py = re.compile(delimiter.replace("(?i)", ""), re.I)
    keys, most = set(), 1
    for name in names:
        pieces = len(py.split(name))
        if pieces > 1:
            keys.add(fold_key_py(name))
            most = max(most, pieces)
    return sorted(keys), most


def _clean(token: Column) -> Column:
    """A value as it stands, without outer blanks, quotes and brackets."""
    literal = F.contains(token, F.lit(_LIT))
    bare = strip_blanks(F.translate(F.replace(token, F.lit(_QUOTE), F.lit('"')), _LIT, ""))
    opened = F.regexp_replace(bare, rf"^[(\[{{]+{_B}*(.*?){_B}*[)\]}}]+$", "$1")
    closed = F.when(~F.contains(opened, F.lit("(")), F.regexp_replace(opened, rf"{_B}*\)+$", "")).otherwise(opened)
    opened_only = F.when(~F.contains(closed, F.lit(")")), F.regexp_replace(closed, rf"^\(+{_B}*", "")).otherwise(closed)
    return F.when(literal, bare).otherwise(strip_blanks(opened_only))


def packed_values(value: Column, delimiter: str, keys: list[str], most: int, near: list[str] | None = None) -> Column:
    """ARRAY<STRING> of the values packed in ``value``.

    ``keys``: fold keys of names that are one value whatever marks they contain,
    also behind a number in brackets; ``most``: the most pieces such a name falls
    into. ``near``: keys of names that make the whole field one value where it
    holds nothing but the name and a remark, or is within two edits of it (one
    edit for keys under nine characters).
    Null gives null; an empty or blank text gives an empty array; repeated values
    are kept, empty pieces are left out.
    """
    text = F.replace(value, F.lit('\\"'), F.lit(_QUOTE))
    inner = F.regexp_extract(text, rf"(?s)^{_B}*\[(.*)\]{_B}*$", 1)
    text = F.when(inner != "", inner).otherwise(text)
    raw = F.split(text, '"', -1)
    # an odd number of quotes: the last one is an ordinary character
    n = F.size(raw)
    odd = F.concat(F.slice(raw, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.element_at(raw, -2), F.lit(_QUOTE), F.element_at(raw, -1))))
    raw = F.when(n % 2 == 0, odd).otherwise(raw)

    def mark(piece: Column, i: Column) -> Column:
        doubled = (piece == "") & (i > 0) & (i < F.size(raw) - 1)
        return (
            F.when(i % 2 == 1, F.concat(F.lit(_LIT), piece, F.lit(_LIT)))
            .when(doubled, F.lit(_QUOTE))
            .otherwise(F.regexp_replace(piece, delimiter, f"{_CUT}$0{_CUT}"))
        )

    tokens = F.split(F.array_join(F.transform(raw, mark), ""), _CUT, -1)
    known = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")

    def span(parts: Column, i: Column, length: Column) -> Column:
        return F.array_join(F.slice(parts, i * 2 + 1, length * 2 - 1), "")

    def fold(acc: Column, i: Column) -> Column:
        parts = acc["parts"]
        left = F.floor((F.size(parts) + 1) / 2).cast("int") - i
        length = F.lit(1)
        for k in range(2, most + 1):
            key = F.regexp_replace(fold_key(F.translate(span(parts, i, F.lit(k)), _LIT, "")), r"^\(\d+\)", "")
            length = F.when((left >= k) & F.array_contains(known, key), F.lit(k)).otherwise(length)
        return F.when(i < acc["next"], acc).otherwise(
            F.struct(parts.alias("parts"), F.concat(acc["items"], F.array(_clean(span(parts, i, length)))).alias("items"), (i + length).cast("int").alias("next"))
        )

    start = F.struct(tokens.alias("parts"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("next"))
    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.size(tokens) + 1) / 2).cast("int") - 1, F.lit(0)))
    items = F.filter(F.aggregate(steps, start, fold, lambda acc: acc["items"]), lambda x: x != "")

    whole = F.array(strip_blanks(value))
    single = value.rlike(_WIDE)
    if near:
        key = F.regexp_replace(fold_key(F.translate(value, "\n\r\t", ";;;")), _GENRE_TRIM, "")
        single = single | value.rlike(_NOTHING)
        for k in near:
            beside = ~F.replace(key, F.lit(k), F.lit("")).rlike(MARKS)
            single = single | (F.contains(key, F.lit(k)) & beside) | (F.levenshtein(key, F.lit(k), 2 if len(k) >= 9 else 1) >= 0)
    plain = ~value.rlike(delimiter + '|"')
    return F.when(value.isNull(), F.lit(None)).when(plain | single, F.filter(whole, lambda x: x != "")).otherwise(items)


def artist_items(value: Column, roster: list[str]) -> Column:
    keys, most = protected_keys(roster, MARKS_AND_JOINERS)
    return packed_values(value, MARKS_AND_JOINERS, keys, most)


def genre_items(value: Column, genres: list[str]) -> Column:
    keys, most = protected_keys(genres, MARKS_ONLY)
    near, _ = protected_keys(genres, MARKS_ONLY)
    return packed_values(value, MARKS_ONLY, keys, most, near)


def known_names(df: DataFrame, column: str) -> list[str]:
    """Distinct names of a dimension table of bounded size."""
    return [r[0] for r in small_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), MAX_PROTECTED)]


def packed_rows(tags: DataFrame, roster: DataFrame, genres: DataFrame) -> DataFrame:
    """rec_id, fieldname, pos, item: one row per name of each value that holds two or more.

    Null or empty fields give no rows; records with the same rec_id are treated
    alike and give their rows once; other columns of ``tags`` are not read.
    """
    artists, names = known_names(roster, "artist_name"), known_names(genres, "genre_name")
    fields = F.array(
        F.struct(F.lit("artist").alias("fieldname"), artist_items(F.col("artist"), artists).alias("items")),
        F.struct(F.lit("genre").alias("fieldname"), genre_items(F.col("genre"), names).alias("items")),
    )
    candidates = F.col("artist").rlike(MARKS_AND_JOINERS) | F.col("genre").rlike(MARKS_ONLY)
    return (
        tags.select("rec_id", "artist", "genre")
        .where(candidates)
        .select("rec_id", F.explode(fields).alias("f"))
        .where(F.size("f.items") > 1)
        .select("rec_id", F.col("f.fieldname").alias("fieldname"), F.posexplode("f.items").alias("pos", "item"))
    )
