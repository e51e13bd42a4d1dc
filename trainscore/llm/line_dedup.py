"""Recurring lines: a log-template tree of fixed depth, in DataFrame functions alone.

A line's tokens lie between white space; a token with a digit is a variable field and
becomes ``<*>``. The tree's first level is the number of tokens, the next ones are the
``LEADING`` first tokens. A leaf holds as many templates as its lines ask for. A template is a line
with places left open, at most ``1 - ALIKE`` of them: the places behind the leading tokens are cut
into blocks of half as many as may be open (at least one place), and one block, or two where
two may be open, is open. Each line goes to the template that most documents have, summed over
its different lines (of equals, the one with the first open blocks); a line that shares no
template with another one is a template of its own.

A template that at least ``MIN_DOCS`` documents have recurs: its lines stay in the first of
these documents (least id; nulls last) and are dropped in all others. Lines of variable fields
alone (numbers, addresses, digests) have no constant place to tell templates by: they count as they
are written. Blank lines always stay.

Only hashes of 128 bits are grouped and joined; the text of lines is masked once and met again only where a leaf has several.
The hot template of many documents is counted by pre-aggregated sums, and its lines meet the
verdict in joins that adaptive execution can split; the open blocks of a line are at most 136 pairs, whatever its length.

A null text stays null and has no lines. Rows with the same id and text are one document, and
treated alike. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

LEADING = 3
ALIKE = 0.8
MIN_DOCS = 5
FIELD = "<*>"
# Bits of the filter in front of the join with texts, and bits in one of Spark's bitmaps.
SPOTS = 1 << 26
PART = 8 * 4096


def masked(line: Column, constant: Column) -> Column:
    """The line with single spaces and, if it has a constant token, its variable fields masked.

    Most lines have neither fields nor odd spaces: plain searches spare them the replacements.
    """
    spaced = reduce(lambda a, b: a | b, [F.contains(line, F.lit(s)) for s in ("  ", "\t", "\r", "\x0b", "\x0c")])
    line = F.trim(F.when(spaced, F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")).otherwise(line))
    fields = F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    return F.when(constant & F.rlike(line, F.lit("[0-9]")), fields).otherwise(line)


def key(*columns: Column) -> Column:
    """128 bits that tell the columns' values apart."""
    return F.struct(F.xxhash64(F.lit(0), *columns).alias("u"), F.xxhash64(F.lit(1), *columns).alias("v"))


def lines(docs: DataFrame) -> DataFrame:
    """``id, same, place, leaf, line, masked`` of the lines of rows ``id, text`` that can be dropped.

    ``line`` is a key, ``leaf`` a hash, null where the line has no constant token.
    """
    each = docs.select("id", F.xxhash64("text").alias("same"), F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    each = each.filter(F.rlike("raw", F.lit(r"[^ \t\r\x0B\f]")))
    each = each.withColumn("constant", F.rlike("raw", F.lit(r"(?<![^ \t\r\x0B\f])[^ \t\r\x0B\f0-9]++(?![^ \t\r\x0B\f])")))
    each = each.select("id", "same", "place", "constant", masked(F.col("raw"), F.col("constant")).alias("masked"))
    tokens = F.length("masked") - F.length(F.translate("masked", " ", ""))
    leaf = F.when(F.col("constant"), F.xxhash64(tokens, F.substring_index("masked", " ", LEADING))).alias("leaf")
    return each.select("id", "same", "place", leaf, key(F.col("masked")).alias("line"), "masked")


def open_blocks(texts: DataFrame, alike: float) -> DataFrame:
    """``line, n, first, last, template``: the templates of lines ``line, n, masked``, by their open blocks."""
    size, spare, half = F.col("size"), F.col("spare"), F.col("half")
    rows = texts.select("line", "n", F.split("masked", " ").alias("tokens")).withColumn("size", F.size("tokens"))
    rows = rows.withColumn("spare", F.floor(size * round(100 * (1 - alike)) / 100).cast("int"))
    rows = rows.filter((spare > 0) & (size > LEADING)).withColumn("half", F.greatest(F.lit(1), F.floor(spare / 2).cast("int")))
    rows = rows.withColumn("end", F.ceil((size - LEADING) / half).cast("int") - 1)
    block = lambda b: F.slice("tokens", b * half + LEADING + 1, half)
    each = lambda salt: F.transform(F.sequence(F.lit(0), "end"), lambda b: F.xxhash64(F.lit(salt), block(b)))
    rows = rows.select("line", "n", "spare", "end", key(size, F.slice("tokens", 1, LEADING)).alias("head"), each(0).alias("u"), each(1).alias("v"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), "end")))
    rows = rows.withColumn("last", F.explode(F.sequence("first", F.when(spare > 1, F.col("end")).otherwise(F.col("first")))))
    fixed = lambda name: F.transform(name, lambda x, b: F.when((b == F.col("first")) | (b == F.col("last")), 0).otherwise(x))
    template = F.struct(*[F.xxhash64(f"head.{c}", "first", "last", fixed(c)).alias(c) for c in ("u", "v")])
    return rows.select("line", "n", "first", "last", template.alias("template"))


def possible(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``found`` without most lines that ``shared`` does not have: a bit for each hash of a line, 8 MB whatever the corpus."""
    spot = F.pmod(F.col("line.u"), F.lit(SPOTS))
    part, place = F.floor(spot / PART), (spot % PART).cast("long")
    bits = shared.select(part.alias("part"), place.alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn("part", part).join(F.broadcast(bits), "part").filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("part", "bits")


def templates(scratch: Scratch, rows: DataFrame, min_docs: int, alike: float) -> tuple[DataFrame, DataFrame]:
    """The lines of documents without their texts, and ``line, template`` for generalised lines.

    What fewer than ``min_docs`` documents share cannot recur and keeps its lines apart. Its tables grow
    with the corpus, so the lines meet them in sorted merges, at every size;
    a filter of fixed size spares most texts the shuffle.
    """
    found = scratch.keep(lines(rows), "lines")
    counts = found.filter("leaf IS NOT NULL").select("id", "same", "leaf", "line").distinct()
    counts = scratch.keep(counts.groupBy("leaf", "line").agg(F.count("*").alias("n")), "counts")
    several = counts.groupBy("leaf").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    several = several.filter((F.col("m") > 1) & (F.col("total") >= min_docs)).select("leaf")
    shared = scratch.keep(counts.join(several, "leaf").select("line", "n"), "shared")
    texts = possible(found.select("line", "masked"), shared).hint("merge").join(shared, "line").groupBy("line", "n").agg(F.first("masked").alias("masked"))
    each = open_blocks(scratch.keep(texts, "leaves"), alike)
    votes = each.groupBy("template").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    votes = votes.filter((F.col("m") > 1) & (F.col("total") >= min_docs)).select("template", "total")
    best = F.max(F.struct("total", -F.col("first"), -F.col("last"), "template")).alias("best")
    member = each.hint("merge").join(votes, "template").groupBy("line").agg(best).select("line", "best.template")
    member = scratch.keep(member, "templates")
    scratch.drop(counts, shared)
    return found.drop("masked"), member


def without_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE, text: str = "text", id_column: str = "doc_id") -> tuple[DataFrame, str, str]:
    """All rows with two more columns, and their names: the number of lines dropped, and the text without them."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kept, member = templates(scratch, rows, min_docs, alike)
    kept = kept.hint("merge").join(member, "line", "left").select("id", "same", "place", F.coalesce("template", "line").alias("template"))
    owners = kept.select("template", "id", "same").distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("first")
    recurring = owners.groupBy("template").agg(F.count("*").alias("n"), first).filter(F.col("n") >= min_docs).select("template", "first")
    gone = kept.join(recurring, "template").filter(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.same") == F.col("same"))))
    # For each document that loses lines, a mark for each place up to its last dropped line.
    gone = gone.select("id", "same", "place").distinct().groupBy("id", "same").agg(F.array_sort(F.collect_list("place")).alias("places"))
    before = F.slice(F.concat(F.array(F.lit(-1)), "places"), 1, F.size("places"))
    marks = F.flatten(F.zip_with("places", before, lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))))
    gone = scratch.keep(gone.select("id", "same", F.size("places").cast("long").alias("n"), marks.alias("marks")), "dropped")
    scratch.drop(member)
    # Names that the table's own cannot clash with.
    free = "_" * (1 + max([len(c) for c in docs.columns], default=0))
    own, same, marks, count, left = (free + n for n in ("id", "same", "marks", "dropped", "text"))
    verdict = gone.select(F.col("id").alias(own), F.col("same").alias(same), F.col("marks").alias(marks), F.col("n").alias(count))
    meets = F.col(id_column).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text).cast("string")) == F.col(same))
    joined = docs.join(verdict, meets, "left")
    rebuilt = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.coalesce(F.get(F.col(marks), i), F.lit(False))), "\n")
    result = joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(count, F.lit(0)).alias(count),
        F.when(F.col(marks).isNull(), F.col(text)).otherwise(rebuilt).alias(left),
    )
    return result, count, left
