"""Near-duplicate line removal by a deletion-neighbourhood join (DataFrame functions only).

Two lines match when they are equal, or when one edit (a character put in, left out or replaced) turns one into the other
and that is at most ``share`` of the longer line; so short lines match only when equal. A line is dropped when an earlier
line matches it, earlier by (doc_id, line number); so the earliest of every pair stays. Empty lines are left alone.

Equal lines meet under a 128-bit hash, counted before the shuffle. Near ones meet in a deletion neighbourhood: of a pair
whose longer line has n characters, a line's key at place p is the hash of what stands before p and what stands after it,
n - 1 characters in all. A line of n characters leaves out its p-th one, a line of n - 1 characters nothing. Lines that
share a key at a place all match one another, so each needs comparing with the key's earliest line only. The places are
found level by level: a line's halves are left out first, then ``PARTS`` pieces of it, then pieces of those pieces, down
to single characters, and what has a key of its own at one level leaves the join before the next. So the work of a line
grows with its length times the number of levels, not with the square of its length.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

SHARE = 0.05
PARTS = 32
#: A line that makes up more than one in ``SPLIT`` of all lines meets its owner in several tasks.
SPLIT = 1000
BREAK = "\n"


def _lines(keyed: DataFrame) -> DataFrame:
    """One row for each line that isn't empty: its document, place, text and 128-bit hash."""
    some = keyed.select("doc_id", "th", F.posexplode(F.split("text", BREAK)).alias("pos", "line")).where("line <> ''")
    return some.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def _place() -> Column:
    return F.struct(F.col("doc_id"), F.col("th"), F.col("pos"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


#: Left-out stretches (n, s, e): of a line, or the place for it, where the longer line has n characters.
_FRAMES = "transform(filter(array(length(line), length(line) + 1), n -> n >= {least}), n -> struct(n as n, 0 as s, n as e))"
_CUT = "transform(sequence(0, least({parts}, x.e - x.s) - 1), i -> struct(x.n as n, cast(x.s + i * (x.e - x.s) div least({parts}, x.e - x.s) as int) as s, cast(x.s + (i + 1) * (x.e - x.s) div least({parts}, x.e - x.s) as int) as e))"
#: The hash of a line without a stretch.
_KEY = "xxhash64(x.n, x.s, x.e, left(line, x.s), right(line, x.n - x.e))"


def _near_pairs(near: DataFrame, least: int) -> DataFrame:
    """(h, g, oh, og, s): lines, the earliest line that shares a deletion key with each, and the first place where it does."""
    stretches = near.select("h", "g", "first", "line", F.explode(F.expr(_FRAMES.format(least=least))).alias("x"))
    found = []
    while True:
        pieces = stretches.select("h", "g", "first", "line", F.explode(F.expr(_CUT.format(parts=PARTS))).alias("x"))
        keys = pieces.select("h", "g", "first", "x", F.expr(_KEY).alias("key"))
        tops = keys.groupBy("key").agg(F.min(F.struct("first", "h", "g")).alias("top"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key", "top")
        hit = materialise(keys.join(tops, "key").select("h", "g", "x", F.col("top.h").alias("oh"), F.col("top.g").alias("og")), "stretches")
        found.append(hit.where("x.e - x.s = 1 and (h <> oh or g <> og)").select("h", "g", "oh", "og", "x.s"))
        open_ = hit.where("x.e - x.s > 1").select("h", "g", "x")
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, found).groupBy("h", "g", "oh", "og").agg(F.min("s").alias("s"))
        stretches = open_.join(near, ["h", "g"]).select("h", "g", "first", "line", "x")


def owners(lines: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(h, g, n, owner): for each line text that repeats or has a near twin, the earliest place of a matching line.

    ``texts`` has each line text once: its hash, its earliest place and its number of copies.
    """
    least = max(2, math.ceil(round(1 / share, 9)))
    # texts travel only for lines that pass the first level: a hash stands for a line until then
    long = lines.where(F.length("line") >= least - 1)
    halves = F.expr(f"flatten(transform({_FRAMES.format(least=least)}, x -> transform({_CUT.format(parts=2)}, x -> {_KEY})))")
    keys = long.select("h", F.explode(halves).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    sieved = keys.join(shared, "key").select("h").distinct()
    # a text is read at its earliest place, so that a line's many copies don't meet in one task
    firsts = texts.join(sieved, "h").select("h", "g", "first", *[F.col(f"first.{c}").alias(f"f_{c}") for c in ("doc_id", "th", "pos")])
    at_first = (F.col("th") == F.col("f_th")) & (F.col("pos") == F.col("f_pos")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
    words = long.select("doc_id", "th", "pos", "line").join(firsts, at_first).groupBy("h", "g").agg(F.first("first").alias("first"), F.first("line").alias("line"))
    near = materialise(words, "near")
    a = near.select("h", "g", F.col("line").alias("a"))
    b = near.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("line").alias("b"), F.col("first").alias("seen"))
    # one edit, at the place of the key: all before it and all after it is equal (an edit distance in time of the length)
    one_edit = "left(a, s) = left(b, s) and right(a, greatest(length(a), length(b)) - s - 1) = right(b, greatest(length(a), length(b)) - s - 1) and abs(length(a) - length(b)) <= 1"
    checked = _near_pairs(near, least).join(a, ["h", "g"]).join(b, ["oh", "og"]).where(one_edit).groupBy("h", "g").agg(F.min("seen").alias("seen"))
    return texts.select("h", "g", "n", "first").join(checked, ["h", "g"], "left").where("n > 1 or seen < first").select("h", "g", "n", F.least("first", F.coalesce("seen", "first")).alias("owner"))


def dropped_lines(keyed: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, th, drop): the numbers of the lines to drop in each document that loses any; ``keyed`` from ``_keyed``."""
    lines = _lines(keyed)
    texts = materialise(lines.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "lines")
    total = texts.agg(F.sum("n")).first()[0] or 1
    parts = F.ceil(F.col("n") * SPLIT / F.lit(total)).cast("int")
    # fewer than SPLIT texts have more than one part, and all parts of theirs are fewer than 2 * SPLIT
    hot = F.broadcast(texts.select("h", "g", parts.alias("parts")).where("parts > 1"))
    dealt = lines.select("h", "g", _place().alias("at")).join(hot, ["h", "g"], "left").withColumn("part", F.expr("cast(pmod(xxhash64(at), coalesce(parts, 1)) as int)"))
    owned = owners(lines, texts, share).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    found = dealt.join(owned, ["h", "g", "part"]).where("owner < at")
    return found.groupBy("at.doc_id", "at.th").agg(F.collect_set("at.pos").alias("drop"))


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of ``docs`` as one struct, its text without the dropped lines, and counts.

    The struct keeps the columns of ``docs`` apart from those made here, whatever their names.
    """
    drop = dropped_lines(_keyed(docs, doc_id, text), share).select(F.col("doc_id").alias("di"), F.col("th").alias("dt"), "drop")
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    left = F.expr("transform(array(split(t, '\n')), a -> array_join(transform(array_except(sequence(0, size(a) - 1), drop), i -> a[i]), '\n'))[0]")
    joined = own.join(drop, F.col("i").eqNullSafe(F.col("di")) & (F.col("h") == F.col("dt")), "left")
    n_lines = F.coalesce(F.length("t") - F.length(F.replace("t", F.lit(BREAK), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select("row", F.when(F.col("drop").isNull(), F.col("t")).otherwise(left).alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and two columns more: n_lines and n_dropped (long).

    ``share`` is the part of a line that one edit may be (0.05: near lines have 20 characters or more); equal lines match
    from one character on. A null text stays null with 0 lines; an empty one has one empty line. Rows with equal doc_id
    and text are one document that is returned as often as it came; among equal doc_ids the text's hash decides which is
    earlier; a null doc_id comes before all others. Other columns pass through whatever their names, but columns called
    n_lines or n_dropped give way to those made here. Lines may have any length; an empty table gives no rows.
    """
    made = kept_lines(docs, doc_id, text, share)
    keep = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return made.select(*keep, "n_lines", "n_dropped")
