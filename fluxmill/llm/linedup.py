"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .texts import free_name


@dataclass(frozen=True)
class LineParams:
    """Lines of ``min_chars`` characters or more match within one edit, shorter ones if equal.

    ``zones``: parts of a line, one of which holds the edit; variants are
    emitted for a zone only where the rest of the line is equal elsewhere.
    """

    min_chars: int = 16
    zones: int = 8


DEFAULT = LineParams()


def _name(*columns) -> Column:
    return F.xxhash64(*columns)


def _outside(line: Column, n: Column, zone: int, zones: int) -> tuple[Column, Column, Column, Column]:
    """Of a line, read as one of n characters: where a zone begins and ends before the line's end, and names of what is before and after."""
    begin = F.floor(n * zone / zones).cast("int")
    after = (n - F.floor(n * (zone + 1) / zones)).cast("int")
    before = F.substring(line, F.lit(1), begin)
    behind = F.when(after > 0, F.substring(line, -after, after)).otherwise("")
    return begin, after, before, behind


def _keys(line: Column, n: Column, zones: int) -> Column:
    """Names of a line outside each zone, for partners as long and one longer, and for partners one shorter."""
    out = []
    for short in (0, 1):
        m = n - short
        for zone in range(zones):
            _, _, before, behind = _outside(line, m, zone, zones)
            out.append(_name(F.lit(zone), m, before, behind))
    return F.array(*out)


def line_decisions(docs: DataFrame, params: LineParams = DEFAULT, scratch: Scratch | None = None, by_text: bool = False) -> DataFrame:
    """(doc_id, line_no, kept, first_doc, first_line): one row per line of ``docs(doc_id, text)``.

    A line is kept unless an earlier one, by doc_id and line number, is equal or
    (from ``min_chars`` characters) within one inserted, deleted or replaced
    character; first_doc and first_line name the line's first equal copy. Blank
    lines are always kept.

    1. Equal lines fall together by a 128-bit name; copies are never paired.
    2. One edit leaves the first or the second half of a line as it is: lines
       without a partner that shares a half leave the search. Lines are then
       compared outside each of ``zones`` zones in the same way.
    3. What is left emits its zone's deletion variants as hashed keys. Lines
       that lack the same place are one replacement apart; a line equal to a
       variant is one deletion apart. Each key gives its earliest line, by an
       aggregate, so a frequent variant is never expanded into pairs; the edit
       distance to it is verified, and the earliest stays.

    Null texts have no lines; an empty text has one blank line. Rows with a null
    doc_id come last. Rows that repeat a doc_id count as one document in which
    equal (doc_id, line_no) lines share one decision. Other columns are not read. With
    ``by_text``, the hash of a line's whole text stands beside its decision.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    text = F.col("text").cast("string")
    whole = [F.xxhash64(text).alias("text_hash")] * by_text
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *whole, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", *["text_hash"] * by_text, F.col("line_no").cast("long").alias("line_no"), "line", F.length("line").alias("n"))
    blank = F.trim(F.regexp_replace("line", r"\s", " ")) == ""
    k1, k2 = _name("line").alias("k1"), _name(F.lit(7), "line").alias("k2")
    # an absent doc_id sorts behind all others
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("line_no"))
    half = F.when(F.col("n") >= params.min_chars, _keys(F.col("line"), F.col("n"), 2))
    named = lines.filter(~blank).select(k1, k2, half.alias("half"), rank.alias("at"))
    first = named.groupBy("k1", "k2").agg(F.min(F.struct("at", "half")).alias("m"))
    first = scratch.save(first.select("k1", "k2", "m.at", "m.half"), "first")

    halves = first.filter("half is not null").select("k1", "k2", F.explode(F.array_distinct("half")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    maybe = halves.join(shared, "key", "left_semi").select("k1", "k2").distinct()
    maybe = scratch.save(first.join(maybe, ["k1", "k2"], "left_semi").select("k1", "k2", "at.doc_id", "at.line_no"), "maybe")
    texts = (
        lines.filter(~blank & (F.col("n") >= params.min_chars))
        # always a shuffle: the number of these lines grows with the input
        .join(maybe.hint("merge").select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "k1", "k2"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l")) & (F.col("k1") == _name("line")) & (F.col("k2") == _name(F.lit(7), "line")))
        .select("k1", "k2", rank.alias("at"), "line", "n").dropDuplicates(["k1", "k2"])
    )
    texts = scratch.save(texts, "texts")
    scratch.drop("maybe")
    scratch.settle()

    zoned = texts.select("k1", "k2", F.posexplode(_keys(F.col("line"), F.col("n"), params.zones)).alias("slot", "key"))
    again = zoned.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).filter("a <> b").select("key")
    open_ = zoned.join(again, "key", "left_semi").groupBy("k1", "k2").agg(F.collect_set("slot").alias("slots"))
    zone = F.pmod("slot", F.lit(params.zones))
    m = F.col("n") - F.floor(F.col("slot") / params.zones).cast("int")
    begin = F.floor(m * zone / params.zones).cast("int")
    after = (m - F.floor(m * (zone + 1) / params.zones)).cast("int")
    inner = F.col("n") - F.col("begin") - F.col("after")
    parts = (
        texts.join(open_, ["k1", "k2"]).withColumn("slot", F.explode("slots"))
        .select("k1", "k2", "at", "line", "n", "slot", zone.alias("zone"), m.alias("m"), begin.alias("begin"), after.alias("after"))
        .withColumn("part", F.expr("substring(line, begin + 1, n - begin - after)"))
        .withColumn("key", _name("zone", "m", F.expr("substring(line, 1, begin)"), F.expr("if(after > 0, substring(line, -after, after), '')")))
        .withColumn("size", inner)
        .select("k1", "k2", "at", "slot", "key", "part", "size")
    )
    parts = scratch.save(parts, "parts")
    scratch.drop("texts")
    scratch.settle()
    long_ = F.col("slot") >= params.zones
    places = F.when(F.col("size") > 0, F.sequence(F.lit(1), F.col("size"))).otherwise(F.array().cast("array<int>"))
    holed = parts.select("k1", "k2", "at", "key", "part", long_.alias("long"), F.explode(places).alias("i"))
    holed = holed.withColumn("rest", F.expr("concat(substring(part, 1, i - 1), substring(part, i + 1))"))
    same = holed.filter("not long").select("k1", "k2", "at", "part", _name(F.lit("r"), "key", "i", "rest").alias("key"), F.lit(0).alias("side"))
    less = holed.filter("long").select("k1", "k2", "at", "part", _name(F.lit("d"), "key", "rest").alias("key"), F.lit(1).alias("side"))
    whole = parts.filter(~long_).select("k1", "k2", "at", "part", _name(F.lit("d"), "key", "part").alias("key"), F.lit(2).alias("side"))
    keyed = same.union(less).union(whole)
    # replacements meet among themselves (side 0); deletions (1) meet whole lines (2)
    partner = F.when(F.col("side") == 0, 0).otherwise(3 - F.col("side"))
    heads = keyed.groupBy("key", partner.alias("side")).agg(F.min(F.struct("at", "part")).alias("head"))
    near = (
        keyed.join(heads, ["key", "side"])
        .filter("head.at < at").filter(F.levenshtein("part", "head.part", 1) >= 0)
        .select("k1", "k2").distinct().withColumn("near", F.lit(True))
    )
    near = scratch.save(near, "near")
    scratch.drop("parts")
    scratch.settle()

    known = first.select("k1", "k2", F.col("at").alias("first")).join(near, ["k1", "k2"], "left")
    decided = (
        lines.select("doc_id", "line_no", *["text_hash"] * by_text, blank.alias("blank"), k1, k2)
        .join(known, ["k1", "k2"], "left")
        .select(
            "doc_id", "line_no", *["text_hash"] * by_text,
            F.when(F.col("blank"), True).otherwise(F.coalesce("near", F.lit(False)) == False).alias("fresh"),  # noqa: E712
            F.col("blank"), F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
        )
    )
    same_place = F.col("first_doc").eqNullSafe(F.col("doc_id")) & (F.col("first_line") == F.col("line_no"))
    kept = F.col("blank") | (F.col("fresh") & F.coalesce(same_place, F.lit(False)))
    out = scratch.save(decided.select("doc_id", "line_no", *["text_hash"] * by_text, kept.alias("kept"), "first_doc", "first_line"), "decisions")
    scratch.drop("first", "near")
    return out


def without_repeated_lines(docs: DataFrame, params: LineParams = DEFAULT) -> DataFrame:
    """``docs`` with the lines that ``line_decisions`` drops cut from text, and n_lines_dropped.

    All rows and columns stay; a text all of whose lines go becomes empty. Lines
    are cut by doc_id and the whole text's hash, so rows that share a doc_id or
    have none lose their own repeated lines only, and no group is larger than a
    text. The time to cut is in proportion to a text's lines.
    """
    doc, hash_, gone = (free_name(docs.columns, x) for x in ("_doc", "_hash", "_gone"))
    drops = (
        line_decisions(docs, params, by_text=True).filter("not kept").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(hash_))
        .agg(F.array_sort(F.collect_set(F.col("line_no").cast("int"))).alias(gone))
    )
    whole = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(whole) == F.col(hash_))

    def left(lines: Column) -> Column:
        """The runs of lines between dropped ones, joined."""
        edges = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))
        run = lambda at, r: F.slice(lines, at[r] + 2, at[r + 1] - at[r] - 1)
        runs = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda r: run(at, r))
        return F.array_join(F.flatten(F.transform(F.array(edges), runs)[0]), "\n")

    # an array of one binds its element, so that a text is split once and not for every run
    cut = F.transform(F.array(F.split(whole, "\n")), left)[0]
    joined = docs.join(drops, same, "left")
    columns = [F.when(F.col(gone).isNotNull(), cut).otherwise(F.col("text")).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_lines_dropped"))
