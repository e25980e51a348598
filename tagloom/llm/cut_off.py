"""Text cut off by field limits: cut values, and how often each feed cuts.

Method: word trigrams inside texts against trigrams at their ends, in pure SQL (on the plain, repaired texts).
A text whose final trigram goes on in many other texts but hardly ever ends one
was cut. A cut inside a word leaves a fragment, so a trigram also counts as
going on where its last word is the beginning of a longer one. The trigram decides
where it is frequent; rare ones fall back to the last two words, and these to the
last word. Values whose last word has a kana or
CJK character are no fragments: cuts in these scripts are not found.

Counts run over all texts. They are taken per distinct trigram before beginnings
are formed, and beginnings after two words only for the ends in question, so
frequent texts and words are gone before anything is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.textfold import plain_words
from tagloom.llm.encoding import garbled_values, long_fields
from tagloom.llm.plain import plain_text
from tagloom.session import cut

FIELDS = ["title", "album"]

#: A word inside texts this many times as often as at their end doesn't end one.
INSIDE = 10
#: ... and a trigram so many times as often where its last word does end texts.
FAR = 100
#: A fragment begins this many times as many words as texts end with it, ...
BEGINS = 3
#: ... and is itself a word inside texts less often than one in this many.
RARELY = 20
#: A text read this often, whose last words go on nowhere, is whole.
WHOLE = 3
#: A trigram, or the last two words, is frequent when it goes on, or ends a text, so often.
ENOUGH = 4
#: A mark that so many sources read at the same place belongs to the text, unless a word is broken off before it.
SOURCES = 2
#: Marks of a cut.
MARK = r"\s*(?:\.{2,}|…)$"
_EAST = r"[぀-ヿ㐀-鿿]"


_COUNTS = ("i", "t", "l", "i_n", "t_n", "l_n")
#: A bracket that is not closed.
_OPEN = r"\([^)]*$"


def _trigram_counts(texts: DataFrame) -> DataFrame:
    """(a, b, x, i, t, i_n, t_n, open) per distinct trigram of the texts (norm, n): texts that hold it inside and at the end, and their readings."""
    t = texts.withColumn("w", F.concat(F.array(F.lit("^"), F.lit("^")), F.split("norm", " ")))
    each = t.select("n", F.col("norm").rlike(_OPEN).alias("open"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    last = F.col("k") == F.size("w") - 1
    g = each.select(F.get("w", F.col("k") - 2).alias("a"), F.get("w", F.col("k") - 1).alias("b"), F.get("w", F.col("k")).alias("x"), last.alias("last"), (F.col("open") & last).alias("open"), "n")
    zero = F.lit(0).cast("long")
    return g.groupBy("a", "b", "x").agg(
        F.count_if(~F.col("last")).alias("i"), F.count_if("last").alias("t"), F.coalesce(F.sum(F.when(~F.col("last"), F.col("n"))), zero).alias("i_n"), F.coalesce(F.sum(F.when(F.col("last"), F.col("n"))), zero).alias("t_n"), F.bool_or("open").alias("open")
    )


def _with_beginnings(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, counts): each row, and one for each beginning of its last word, in which its counts are those of a longer word."""
    own = F.struct(F.col("x"), *[F.col(c) if c in ("i", "t", "i_n", "t_n") else F.lit(0).cast("long").alias(c) for c in _COUNTS])
    longer = lambda k: F.struct(F.substring("x", F.lit(1), k).alias("x"), *[(F.col("i") + F.col("t")).alias(c) if c == "l" else (F.col("i_n") + F.col("t_n")).alias(c) if c == "l_n" else F.lit(0).cast("long").alias(c) for c in _COUNTS])
    beginnings = F.when(F.length("x") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length("x") - 1, F.lit(1))), longer))
    return counts.select(*keys, F.inline(F.concat(F.array(own), F.coalesce(beginnings, F.array().cast(f"array<struct<x:string,{','.join(c + ':bigint' for c in _COUNTS)}>>")))))


def _total(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    return rows.groupBy(*keys, "x").agg(*[F.sum(c).alias(c + level) for c in _COUNTS])


def _normal(value: Column) -> tuple[Column, Column]:
    """Words of a value as it stands, and without a mark of a cut."""
    text = plain_words(value)
    return text, F.regexp_replace(text, MARK, "")


def judged_trigrams(texts: DataFrame) -> DataFrame:
    """(a, b, x, level, cut, torn): final trigrams of the distinct texts (norm, n) that may be cut ends.

    ``level`` says what decided: 3 the trigram, 2 the last two words, 1 the last word. ``torn`` is true for the
    beginning of a longer word. An end that no level calls cut can still be cut where a bracket is open.
    """
    grams = cut(_trigram_counts(texts))
    words = _total(_with_beginnings(grams.groupBy("x").agg(*[F.sum(c).alias(c) for c in ("i", "t", "i_n", "t_n")]), []), [], "0")
    letters = F.col("x").rlike(r"\p{L}") & ~F.col("x").rlike(_EAST + "|\ufffd")
    torn = letters & ((F.col("i0") * RARELY < F.col("l0")) & (F.col("l0") >= BEGINS * F.col("t0")) | (F.col("i0") == 0) & (F.col("l0") > 0))
    inner = F.col("i0") >= INSIDE * F.col("t0")
    finals = grams.where("t > 0").select("a", "b", "x", F.col("i").alias("i3"), F.col("t").alias("t3"), "open").join(words.where("t0 > 0"), "x")
    # a word that does end texts is cut only where the trigram never ends one but by a cut
    goes_on = (F.col("a") != "^") & (F.col("i3") >= FAR * F.col("t3"))
    near = cut(finals.where(torn | inner | goes_on | F.col("open") & (F.col("l0") > 0)).select("a", "b", "x", "open", torn.alias("torn"), inner.alias("inner"), "i0", "t0", "l0"))
    # beginnings of the words after two others are formed only where such an end is asked for
    asked = _with_beginnings(grams, ["a", "b"]).join(near.select("x").distinct(), "x", "left_semi")
    three = _total(asked, ["a", "b"], "3")
    two = three.groupBy("b", "x").agg(*[F.sum(c + "3").alias(c + "2") for c in _COUNTS])
    known = near.join(two, ["b", "x"]).join(three, ["a", "b", "x"])
    # the trigram decides where it is frequent: it goes on, as it stands or in a longer word, and hardly ever ends a text
    onward = lambda k: F.col("i" + k) + F.when(F.col("torn"), F.col("l" + k)).otherwise(0)
    full = {"3": F.col("a") != "^", "2": F.col("b") != "^"}  # as many words stand in the text
    says = lambda k: F.when(~full[k], None).when((onward(k) >= F.when(F.col("torn"), BEGINS).when(F.col("inner"), INSIDE).otherwise(FAR) * F.col("t" + k)) & (onward(k) >= ENOUGH), True).when((F.col("t" + k) >= ENOUGH) & (onward(k) * INSIDE < F.col("t" + k)), False)
    nowhere = (F.col("i2") + F.col("l2") == 0) & (F.col("i_n3") + F.col("l_n3") == 0)
    by_word = (F.col("torn") & ((F.col("l0") >= BEGINS * F.col("t0")) | (F.col("l_n3") >= 5 * F.col("t_n3"))) | F.col("inner")) & ~((F.col("t_n3") >= WHOLE) & nowhere)
    level = F.when(says("3").isNotNull(), 3).when(says("2").isNotNull(), 2).otherwise(1)
    whole = (F.col("t_n3") >= WHOLE) & nowhere
    return known.select("a", "b", "x", level.alias("level"), F.coalesce(says("3"), says("2"), by_word).alias("cut"), "torn", ((F.col("l0") > 0) & ~whole).alias("closes"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """(norm, broken, level): those of the distinct texts (norm, n) that were cut; whether inside a word or a bracket; what decided."""
    t = F.concat(F.array(F.lit("^"), F.lit("^")), F.split("norm", " "))
    ends = texts.select("norm", F.element_at(t, -3).alias("a"), F.element_at(t, -2).alias("b"), F.element_at(t, -1).alias("x"))
    # an opened bracket that only a longer word closes
    opened = F.col("norm").rlike(_OPEN) & F.col("closes")
    return ends.join(judged_trigrams(texts), ["a", "b", "x"]).where(F.col("cut") | opened).select("norm", (F.col("cut") & F.col("torn") | opened).alias("broken"), "level")


def cut_values(tags: DataFrame, fields: list[str] = FIELDS, source: str = "feed") -> DataFrame:
    """(rec_id, fieldname, value): values that stop inside a word or phrase.

    Words whose encoding is wrong count as the words that were meant, and widths
    and look-alike letters don't matter. Null, empty and blank values are none; repeated rows give their case once; an
    empty table gives an empty result. A marked value counts when the text
    before the mark was cut, however often it is read; where several sources read
    the mark, it counts only when a word or bracket is broken off before it.
    """
    text, bare = _normal(plain_text(F.coalesce("repaired", "value")))
    repaired = garbled_values(tags, fields).select("rec_id", "fieldname", "value", "repaired")
    read = long_fields(tags, fields).distinct().join(repaired, ["rec_id", "fieldname", "value"], "left")
    values = cut(read.select("rec_id", "fieldname", "value", text.alias("text"), bare.alias("bare"))).where("bare <> ''")  # behind the table: before it, the filter would compute the words once more
    # a field limit is one source's; a title that ends so is marked in several
    sources = tags.select("rec_id", F.struct(source).alias("source")).distinct()
    marked = values.where("text <> bare").join(sources, "rec_id").groupBy("text").agg(F.countDistinct("source").alias("k")).where(F.col("k") >= SOURCES).select("text", F.lit(True).alias("own"))
    texts = cut(values.groupBy(F.col("bare").alias("norm")).agg(F.count("*").alias("n")))
    cases = values.join(cut_texts(texts), values["bare"] == F.col("norm")).join(marked, "text", "left")
    return cases.where(F.col("broken") | F.col("own").isNull()).select("rec_id", "fieldname", "value").distinct()


def cut_rates(tags: DataFrame, fields: list[str] = FIELDS, source: str = "feed") -> DataFrame:
    """(source, fieldname, n_values, n_cut, share): how often each source cuts; a null source is a source."""
    cases = cut_values(tags, fields, source).select("rec_id", "fieldname").distinct().withColumn("cut", F.lit(1))
    structs = [F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("value")) for f in fields]
    each = tags.select("rec_id", source, F.inline(F.array(*structs))).where("trim(value) <> ''")
    counted = each.join(cases, ["rec_id", "fieldname"], "left").groupBy(source, "fieldname").agg(F.count("*").alias("n_values"), F.count("cut").alias("n_cut"))
    return counted.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 4))
