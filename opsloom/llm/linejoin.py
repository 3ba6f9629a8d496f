"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Equal lines are one class, named by their first occurrence.  If two lines are within
``threshold`` edits and one of them is cut into threshold + 1 segments, at least one segment
occurs in the other unchanged, near its own place.  So each class is entered under its length
and segments, and looked up with those of its substrings that can be a segment of a line up to
``threshold`` shorter, at the places that the number of segments before and after allow.
What meets, and whose counts of some frequent signs are near enough, is verified by a bit-parallel edit distance in a band of 2 * threshold + 1 diagonals.

A line goes if it is not the first occurrence of its class, or if its class is within the
threshold of a class that occurs first.  Lines of up to ``threshold`` characters, which cannot
be cut into segments, are compared by equality only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage, shared_path

#: Signs whose counts tell lines apart before their edit distance is taken; any set is right, frequent ones tell more.
COUNTED = " etaoinsrhldu"


def segments(length: Column, count: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and size of each segment of a line of that length; the longer ones come last."""
    small = F.floor(length / count).cast("int")
    longer = length - small * count
    sizes = [small + (F.lit(count - i) <= longer).cast("int") for i in range(count)]
    starts = [reduce(lambda a, b: a + b, sizes[:i], F.lit(1)) for i in range(count)]
    return list(zip(starts, sizes))


def signs_of(line: Column) -> Column:
    """The characters of a line in four bytes each, so that a piece is cut without a walk from the line's start."""
    return F.encode(line, "UTF-32")


def _key(signs: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(signs, start * 4 - 3, size * 4))


def entries(signs: Column, length: Column, threshold: int) -> list[Column]:
    """The keys under which a line is entered, and which it looks up for lines as long as itself."""
    return [_key(signs, length, i, start, size) for i, (start, size) in enumerate(segments(length, threshold + 1))]


def lookups(signs: Column, length: Column, threshold: int) -> list[Column]:
    """The other keys that a line looks up: every substring that can be a segment of a line that is as long or up to ``threshold`` shorter."""
    keys = []
    for shorter in range(threshold + 1):
        other = length - shorter
        for i, (start, size) in enumerate(segments(other, threshold + 1)):
            # i edits at most lie before a first unchanged segment, threshold - i behind a last one
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1):
                if shorter or shift:
                    keys.append(_key(signs, other, i, start + shift, size))
    return keys


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines are at most ``threshold`` edits apart.

    For each number of errors a word holds one bit per diagonal of the band: whether the
    cell of that diagonal in the current column can be reached.  A column keeps the cells
    of equal characters, and hands cells on with one error more to the same, the next and
    the previous diagonal.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1

    start = [1 << threshold]
    for _ in range(threshold):
        start.append((start[-1] | start[-1] << 1) & mask)
    names = [f"e{e}" for e in range(threshold + 1)]

    def equal(left: Column, right: Column, j: Column) -> Column:
        same = (F.when(F.get(left, j + (d - threshold)) == F.get(right, j), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width))
        return reduce(lambda x, y: x.bitwiseOR(y), same)

    def column(state: Column, same: Column) -> Column:
        old = [state[name] for name in names]
        new = [old[0].bitwiseAND(same)]
        for e in range(1, threshold + 1):
            new.append(old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(mask))))
        return F.struct(*(word.alias(name) for word, name in zip(new, names)))

    places = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
    # the characters of both lines are cut once per pair, as the element of a list of one
    pair = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    columns = F.transform(pair, lambda p: F.transform(places, lambda j: equal(p["x"], p["y"], j)))[0]
    last = F.aggregate(columns, F.struct(*(F.lit(w).alias(name) for w, name in zip(start, names))), column, lambda state: state[names[-1]])
    apart = F.length(a) - F.length(b)
    reached = F.transform(F.array(last), lambda word: F.element_at(F.array(*(word.bitwiseAND(F.lit(1 << d)) != 0 for d in range(width))), apart + (threshold + 1)))[0]
    return F.when(F.abs(apart) <= threshold, reached).otherwise(F.lit(False))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, line_no, line``: the lines of each text from 0; a null text has none."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.split(docs[text_col].cast("string"), "\n").alias("lines"))
    return rows.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


def _packed(df: DataFrame) -> DataFrame:
    """Written and read again like other steps; it holds the texts of all lines, and its codec needs no memory outside the heap."""
    path = shared_path(df.sparkSession, "lines")
    df.write.option("compression", "lz4_raw").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def classes(lines: DataFrame, threshold: int, least_chars: int) -> DataFrame:
    """``digest, first, links, earlier`` per distinct line of at least ``least_chars``: its first occurrence, the number of other lines within the threshold, and whether one of those occurs first; lines of up to ``threshold`` characters have no links."""
    long = lines.where(F.length("line") >= least_chars)
    first = F.min(F.struct("doc_id", "line_no", "line"))
    kinds = long.groupBy(F.unhex(F.md5("line")).alias("digest")).agg(first.alias("first"))
    kinds = _packed(kinds.select(F.monotonically_increasing_id().alias("kind"), "digest", F.struct("first.doc_id", "first.line_no").alias("first"), F.col("first.line").alias("line")))
    size = F.length("line")
    # the explode evaluates what it is given once per key, so length and signs are columns before it
    cuttable = kinds.where(size > threshold).select("kind", size.alias("size"), signs_of(F.col("line")).alias("signs"))
    own = [F.struct(key.alias("key"), F.lit(True).alias("entry")) for key in entries(F.col("signs"), F.col("size"), threshold)]
    sought = [F.struct(key.alias("key"), F.lit(False).alias("entry")) for key in lookups(F.col("signs"), F.col("size"), threshold)]
    # one exchange of all keys, and only those under which an entry meets another line go on; an entry is looked up too
    every = cuttable.select("kind", F.explode(F.array(*own, *sought)).alias("k")).select("kind", "k.*")
    under = Window.partitionBy("key")
    flags = {"_first": F.min("kind"), "_last": F.max("kind"), "_entered": F.max("entry")}
    met = every.withColumns({name: value.over(under) for name, value in flags.items()})
    met = cut_lineage(met.where("_first != _last and _entered").select("key", "kind", "entry").distinct())
    # a line's keys, three entries and nine others at two edits: a pair is met under the least that both have
    of_line = met.groupBy("kind").agg(F.collect_set(F.when(F.col("entry"), F.col("key"))).alias("entries"), F.collect_set("key").alias("lookups"))
    counts = [(F.length("line") - F.length(F.replace("line", F.lit(c)))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    counted = cut_lineage(kinds.join(of_line, "kind").select("kind", "entries", "lookups", size.alias("size"), *counts))
    met = cut_lineage(met.join(counted, "kind"))
    names = [f"c{i}" for i in range(len(COUNTED))]
    left = met.where("entry").select("key", "kind", "entries", "size", *names)
    right = met.select("key", F.col("kind").alias("other"), "lookups", F.col("size").alias("o_size"), *(F.col(c).alias(f"o_{c}") for c in names))
    # an edit changes the counts of its signs by two at most
    moved = reduce(lambda x, y: x + y, (F.abs(F.col(c) - F.col(f"o_{c}")) for c in names))
    # of two lines of one length either finds the other, and one of them is enough
    once = (F.col("size") < F.col("o_size")) | (F.col("kind") < F.col("other"))
    least = F.array_min(F.array_intersect("entries", "lookups")) == F.col("key")
    pairs = left.join(right, "key").where((F.col("kind") != F.col("other")) & once & (moved <= 2 * threshold) & least)
    pairs = cut_lineage(pairs.select(F.least("kind", "other").alias("a"), F.greatest("kind", "other").alias("b")).distinct())
    side = lambda name: kinds.select(F.col("kind").alias(name), F.col("line").alias(f"line_{name}"), F.col("first").alias(f"first_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(within(F.col("line_a"), F.col("line_b"), threshold))
    near = cut_lineage(near.select("a", "b", (F.col("first_a") < F.col("first_b")).alias("a_first")))
    linked = near.select(F.col("a").alias("kind"), (~F.col("a_first")).alias("later")).union(near.select("b", "a_first"))
    linked = cut_lineage(linked.groupBy("kind").agg(F.count("*").alias("links"), F.max("later").alias("earlier")))
    return cut_lineage(kinds.join(linked, "kind", "left").select("digest", "first", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier")))


def repeated_lines(docs: DataFrame, threshold: int = 2, least_chars: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line: ``doc_id, line_no, class_doc_id, class_line_no, links, kept``.

    The class is the first occurrence of the line's text, in the order of id and line;
    ``links`` counts the other texts within ``threshold`` edits; a line of up to ``threshold``
    characters has a class but no link.  If ``least_chars`` is given, shorter lines are classes
    of their own without links, and stay.  Null texts have no line, an empty text has one; null
    ids come first; rows that repeat an id with equal text all stay.  An empty table gives no
    row; other columns are ignored.
    """
    lines = lines_of(docs, id_col, text_col)
    known = classes(lines, threshold, least_chars)
    marked = lines.select("doc_id", "line_no", F.length("line").alias("n_chars"), (~F.col("line").rlike(r"\S")).alias("blank"), F.when(F.length("line") >= least_chars, F.unhex(F.md5("line"))).alias("digest"))
    own = F.struct("doc_id", "line_no")
    first = F.coalesce("first", own)
    return marked.join(known, "digest", "left").select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        first["doc_id"].alias("class_doc_id"),
        first["line_no"].cast("bigint").alias("class_line_no"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
        (first.eqNullSafe(own) & ~F.coalesce("earlier", F.lit(False))).alias("kept"),
        "digest",
        "n_chars",
        "blank",
    )


def without_repeats(docs: DataFrame, threshold: int = 2, least_chars: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay; lines shorter than ``least_chars`` are not cut.

    A text that loses no line is unchanged.  A row that loses lines goes only if what is left of
    it is blank, or if each line left occurs first in another document, which keeps it.
    """
    decided = repeated_lines(docs, threshold, 0, id_col, text_col)
    cut = ~F.col("kept") & (F.col("n_chars") >= least_chars)
    place = F.concat_ws(":", "line_no", F.hex("digest"))
    own = ~cut & ~F.col("blank") & F.col("class_doc_id").eqNullSafe(F.col("doc_id"))
    # a list per document, no longer than its lines
    lost = decided.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.when(cut, place)).alias("_lost"), F.max(own).alias("_own"))
    lost = cut_lineage(lost.where(F.size("_lost") > 0))
    stays = F.filter(F.split(docs[text_col], "\n"), lambda line, i: ~F.array_contains(F.col("_lost"), F.concat_ws(":", i, F.upper(F.md5(line)))))
    rest = docs.join(lost, docs[id_col].eqNullSafe(lost["_id"]), "left").withColumn("_rest", F.when(F.col("_lost").isNotNull(), stays))
    rest = rest.where(F.col("_rest").isNull() | (F.col("_own") & F.exists("_rest", lambda line: line.rlike(r"\S"))))
    return rest.select(*(F.coalesce(F.array_join("_rest", "\n"), docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns))
