"""Line dedup: an edit-distance join of lines by segment partition, with DataFrame functions only.

A line of L characters is cut into threshold + 1 even segments.  Two lines within the
threshold share at least one of them unchanged, so each line is looked up by the
substrings of itself that could be a segment of a line of nearly its length, at
starts that the edits before and behind allow.  Keys that two different lines use
are kept; lines under such a key are paired if counts of letters allow so few
edits, and verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import shared
from tabloom.llm.shared import LAST

#: Letters whose counts, which an edit changes by one at most, rule out pairs early.
LETTERS = "etnaihors "
#: A line of nothing else is blank.
BLANK = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line: d, th, pos (from 0), line, h1, h2, size."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.ltrim(F.col("line"), F.lit(BLANK)) != "")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _places(threshold: int) -> Column:
    """Fixed values (segment, by how much the other line is shorter, shift) of all that a line is looked up by."""
    parts = threshold + 1
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift"))
        for less in range(parts) for i in range(parts) for shift in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1)
    ])


def _probes(lines: DataFrame, threshold: int) -> DataFrame:
    """(line, h1, key, probe): the segments of each line, and with probe the substrings that could be a segment of another.

    A key holds the segment's number and its line's length.  Lines of one byte a
    character are cut as bytes, without a walk to the place.
    """
    parts = threshold + 1
    rows = lines.select("line", "size", F.col("line").cast("binary").alias("raw"), F.xxhash64("line").alias("h1"), F.explode(_places(threshold)).alias("c"))
    size, i = F.col("size") - F.col("c.less"), F.col("c.i")
    rows = rows.select("*", size.alias("s"), (F.expr(f"(size - c.less) * c.i div {parts}").cast("int") + F.col("c.shift")).alias("at"), F.expr(f"(size - c.less) * (c.i + 1) div {parts} - (size - c.less) * c.i div {parts}").cast("int").alias("long"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("long") <= F.col("size")))
    part = F.when(F.octet_length("line") == F.col("size"), F.xxhash64(F.substring("raw", F.col("at") + 1, F.col("long")))).otherwise(F.xxhash64(F.substring("line", F.col("at") + 1, F.col("long"))))
    return rows.select("line", "h1", F.xxhash64("c.i", "s", part).alias("key"), ((F.col("c.less") > 0) | (F.col("c.shift") != 0)).alias("probe"))


def _signature() -> Column:
    """Six bits for the count of each of the letters, modulo 64."""
    total = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = (F.length("line") - F.length(F.replace("line", F.lit(letter)))).cast("long")
        total = total.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(63)), 6 * k))
    return total


def _apart(a: str, b: str) -> Column:
    """A sum of the letters' differences: each edit adds two at most."""
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        x = (F.shiftright(a, 6 * k) - F.shiftright(b, 6 * k)).bitwiseAND(F.lit(63))
        total = total + F.least(x, 64 - x)
    return total


def edit_distance(left: Column, right: Column, threshold: int) -> Column:
    """Edit distance of two lines of at least ``threshold`` characters, or threshold + 1 if it is more.

    Only the band of 2 * threshold + 1 rows around the diagonal is kept, as the bits of
    two numbers for steps up and steps down; a character moves the band down by one and
    costs a few bit operations.  Where the band has passed the last row, the distance is
    followed along that row.
    """
    width = 2 * threshold + 1
    full, bottom = F.lit((1 << width) - 1), width - 1
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(full)

    def banded(t: Column) -> Column:
        rows, size = t["p"], F.size(t["p"])

        def equal(c: Column, j: Column) -> Column:
            """The bits of the band's rows that have the character."""
            found = F.lit(0)
            for b in range(width):
                found = found + F.when(F.get(rows, j + (b - threshold)) == c, F.lit(1 << b)).otherwise(F.lit(0))
            return found

        def step(s: Column, same: Column) -> Column:
            up, down = s["up"], s["down"]

            def moved(flat: Column) -> Column:
                """flat: where the diagonal step costs nothing."""
                rise, fall = down.bitwiseOR(inverse(flat.bitwiseOR(up))), flat.bitwiseAND(up)
                before = F.shiftrightunsigned(flat, 1)
                last = F.lit(bottom) - (s["j"] + threshold - size)
                cost = F.when(s["j"] + threshold <= size, 1 - F.getbit(flat, F.lit(bottom)).cast("int")).otherwise(F.getbit(rise, last).cast("int") - F.getbit(fall, last).cast("int"))
                return F.struct(fall.bitwiseOR(inverse(before.bitwiseOR(rise))).alias("up"), before.bitwiseAND(rise).alias("down"), (s["cost"] + cost).alias("cost"), (s["j"] + 1).alias("j"))

            flat = (same.bitwiseAND(up) + up).bitwiseAND(full).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down)
            return F.get(F.transform(F.array(flat), moved), F.lit(0))

        start = F.struct(F.lit(((1 << threshold + 1) - 1) << threshold).alias("up"), F.lit(0).alias("down"), F.lit(threshold).alias("cost"), F.lit(1).alias("j"))
        end = F.aggregate(F.transform(t["x"], equal), start, step, lambda s: s["cost"])
        return F.when(F.abs(size - F.size(t["x"])) > threshold, threshold + 1).otherwise(F.least(end, F.lit(threshold + 1)))

    # bound as one value, so that the lines are cut into characters once
    both = F.array(F.struct(F.split(left, "").alias("p"), F.split(right, "").alias("x")))
    return F.get(F.transform(both, banded), F.lit(0))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of names whose lines are within the edit distance."""
    named = lambda name, line: texts.select(F.col("name").alias(name), F.col("line").alias(line))
    both = pairs.join(named("a", "left"), "a").join(named("b", "right"), "b")
    return both.where(edit_distance(F.col("left"), F.col("right"), threshold) <= threshold).select("a", "b")


def line_links(docs: DataFrame, threshold: int = 2, shortest: int = 20) -> DataFrame:
    """(a, b): links of different lines of at least ``shortest`` characters within the edit distance, enough to join all that any links join.

    Lines are named by 32 hexadecimal digits of their hashes; a < b.  Under each key all
    lines are first compared with one of them.  Lines that these links have joined need
    no link among themselves, so that a crowd of near copies costs a comparison each;
    then lines under a key that are still apart are compared in pairs.
    """
    lines = _lines(docs).withColumn("size", F.length("line")).where(F.col("size") >= shortest)
    probes = _probes(lines, threshold)
    used = probes.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("probe").alias("probe"))
    keys = shared.table(used.where("low <> high and not probe").select("key"))
    # each task gives a line once for each key, however often it has the line
    rows = shared.sifted(probes, keys, ["key"]).select("line", "key", "probe").distinct()
    rows = _hashed(rows.join(shared.small(keys), "key", "left_semi"))
    rows = shared.table(rows.select("key", "probe", "line", F.concat(*[F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")]).alias("name"), _signature().alias("sign")))
    texts = shared.table(rows.groupBy("name", "line").agg(F.first("sign").alias("sign")))
    members = rows.select("key", "probe", "name", "sign")

    centre = members.where("not probe").groupBy("key").agg(F.min(F.struct("name", "sign")).alias("c"))
    near = members.join(centre, "key").where((F.col("name") != F.col("c.name")) & (_apart("sign", "c.sign") <= 2 * threshold))
    near = near.select(F.least("name", "c.name").alias("a"), F.greatest("name", "c.name").alias("b")).distinct()
    first = shared.table(_verified(near, texts, threshold))

    joined = shared.components(first)
    placed = members.join(joined.select(F.col("a").alias("name"), F.col("b").alias("class")), "name", "left").join(centre, "key").where(F.col("name") != F.col("c.name"))
    placed = placed.select("key", "probe", "name", "sign", F.coalesce("class", "name").alias("class"))
    apart = shared.table(placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("probe").alias("probe")).where("low <> high and not probe").select("key"))
    left = placed.join(apart, "key")
    a, b = left.where("not probe").alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") != F.col("b.class")) & (_apart("a.sign", "b.sign") <= 2 * threshold) & (F.col("b.probe") | (F.col("a.name") < F.col("b.name"))))
    pairs = pairs.select(F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b")).distinct()
    return first.unionByName(_verified(pairs, texts, threshold))


def repeats(docs: DataFrame, threshold: int, shortest: int) -> DataFrame:
    """(d, th, removed): the numbers of the lines that go, for each document that has one.

    Texts are cut into lines once; after that only hashes and places are read, and of
    these only those of classes with several lines are sorted for the first of each.
    """
    lines = shared.table(_hashed(_lines(docs)).select("d", "th", "pos", "h1", "h2"))
    stars = shared.components(line_links(docs, threshold, shortest))
    half = lambda c, k: F.conv(F.substring(c, 1 + 16 * k, 16), 16, -10).cast("long")
    members = shared.table(stars.select(half("a", 0).alias("h1"), half("a", 1).alias("h2"), half("b", 0).alias("r1"), half("b", 1).alias("r2")))
    classed = lines.join(shared.small(members), ["h1", "h2"], "left").select("d", "th", "pos", F.coalesce("r1", "h1").alias("c1"), F.coalesce("r2", "h2").alias("c2"))
    several = shared.table(classed.groupBy("c1", "c2").count().where("count > 1").select("c1", "c2"))
    places = shared.table(classed.join(shared.small(several), ["c1", "c2"], "left_semi"))
    # written, so that the join of a class that very many lines are in can be split
    least = shared.table(places.groupBy("c1", "c2").agg(F.min(F.struct("d", "pos", "th")).alias("least")))
    gone = places.join(least, ["c1", "c2"]).where(F.struct("d", "pos", "th") != F.col("least"))
    return gone.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def cut(docs: DataFrame, threshold: int, shortest: int) -> DataFrame:
    """(row, kept, n_lines, removed): the documents' columns, the kept text, and the removed line numbers."""
    lists = repeats(docs, threshold, shortest)
    joined = shared.keyed(docs).join(lists, ["d", "th"], "left").select("row", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    parts = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.slice("all", F.get("cuts", i) + 2, F.get("cuts", i + 1) - F.get("cuts", i) - 1))
    split = joined.withColumn("all", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    split = split.withColumn("cuts", F.concat(F.array(F.lit(-1)), "removed", F.array(F.size("all"))))
    kept = F.when(F.size("removed") == 0, F.col("row.text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return split.select("row", kept.alias("kept"), F.size("all").cast("long").alias("n_lines"), "removed")


def line_dedup(docs: DataFrame, threshold: int = 2, shortest: int = 20) -> DataFrame:
    """Keep the first line of each class of lines; classes are joined by links within the edit distance.

    Returns doc_id, text (kept lines), n_lines, n_removed and removed (line numbers
    from 0).  First is the least doc_id, then line number.  Lines under ``shortest``
    characters are the same only if equal, as two edits make another word of most of them;
    blank lines (white space alone) stay, as does a text's order.

    A null text stays null and has one blank line; a null doc_id comes after all ids;
    rows that agree in doc_id and text keep the same lines; very long texts and lines
    are read whole; an empty table gives no rows; other columns are not read.
    """
    found = cut(docs.select("doc_id", "text"), threshold, shortest)
    return found.select("row.doc_id", F.col("kept").alias("text"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeated_lines(docs: DataFrame, threshold: int = 2, shortest: int = 20) -> DataFrame:
    """All columns of docs, with the kept lines as text; n_chars, where there is one, is the new length."""
    found = cut(docs, threshold, shortest)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
