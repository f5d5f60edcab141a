"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass one hashes every normalised text, counts the filter's slots over all rows
and keeps, as bitmaps, the slots that were hit more than once.  Pass two probes
each row: a row with a slot that nobody else hit is alone and passes straight
through; only possibly repeated rows are shuffled and compared by their whole
digest.  A repeated text always hits its slots at least twice, so no copy is
lost; a filter that is too full only lets more rows into the shuffle.

The filter has 16 to 32 slots a row up to ``MOST_BITS``, so what is broadcast
never exceeds 32 MB.  Beyond 16 million rows it fills up gradually: with ten
times as many about two thirds of the single rows are shuffled too, as
(digest, id), never as texts.

Hot groups: slots and groups are counted with partial aggregation.  A group
larger than one in ``HEAVY`` of all rows joins by broadcast (there are fewer
than ``HEAVY`` of them), any other by a shuffle on its digest.

Defined cases: null counts as empty text; repeated rows of one id and text are
copies of each other, and one of them stays; a null id ranks behind every other
one; an empty table gives an empty table; other columns, whatever their names,
travel in one struct (``carry``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SLOTS_PER_ROW = 16
BLOCK_BITS = 15  # a bitmap of the built-in functions has 32,768 bits
MOST_BITS = 1 << 28
HEAVY = 2000
#: Groups up to this many rows are never treated as hot.
LIGHT_ROWS = 64


def digest(text: Column) -> Column:
    """32 bytes that stand for a text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def blocks_for(rows: int, most_bits: int = MOST_BITS) -> int:
    """How many bitmaps the filter has: a power of two."""
    bits = min(max(rows * SLOTS_PER_ROW, 1 << BLOCK_BITS), most_bits)
    return 1 << max(0, (bits - 1).bit_length() - BLOCK_BITS)


def _places(blocks: int) -> tuple[Column, Column, Column]:
    """Bitmap number and two bit numbers of a row, from different bits of one hash of its digest."""
    h = F.xxhash64("digest")
    low = (1 << BLOCK_BITS) - 1
    at = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(low)).cast("int") for k in (20, 20 + BLOCK_BITS)]
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int"), at[0], at[1]


def repeated_slots(digests: DataFrame, blocks: int) -> DataFrame:
    """Pass one: (block, bits) with a bit set where more than one row hit the slot."""
    block, first, second = _places(blocks)
    slot = F.explode(F.array(*[F.shiftleft(block, BLOCK_BITS).bitwiseOR(p) for p in (first, second)]))
    counted = digests.select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("hits")).where("hits > 1")
    at = F.col("slot").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("long")
    return counted.groupBy(F.shiftright("slot", BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(at).alias("bits"))


def _is_set(at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1


def probed(rows: DataFrame, slots: DataFrame, blocks: int) -> DataFrame:
    """Pass two: ``rows`` with ``possible``, false only where the digest occurs once."""
    block, first, second = _places(blocks)
    placed = rows.withColumns({"block": block, "first": first, "second": second})
    hit = placed.join(F.broadcast(slots), "block", "left")  # at most MOST_BITS / 8 bytes
    possible = F.coalesce(_is_set(F.col("first")) & _is_set(F.col("second")), F.lit(False))
    return hit.withColumn("possible", possible).drop("block", "first", "second", "bits")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, folder: str | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; ``carry`` adds a struct of all its columns.

    Texts are read once for their digests, and once more if whole rows are carried.
    """
    folder = folder or shared.shared_folder(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest(F.col(f"`{text_col}`")).alias("digest"), *([F.struct("*").alias(carry)] if carry else []))
    number = F.monotonically_increasing_id().alias("_number")  # fixed once written
    digests = shared.stored(named.select("doc_id", "digest", number), folder, "digests")
    n = digests.count()
    blocks = blocks_for(n, most_bits)
    slots = shared.stored(repeated_slots(digests, blocks), folder, "slots")
    rows = probed(named if carry else digests, slots, blocks)
    alone = rows.where("not possible")
    several = rows.where("possible").drop("possible")
    if carry:
        several = shared.stored(several.withColumn("_number", F.monotonically_increasing_id()), folder, "several")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_number")).alias("first")
    groups = several.groupBy("digest").agg(F.count("*").alias("group_size"), first).where("group_size > 1")
    groups = shared.stored(groups.select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first._number").alias("keep_number")), folder, "groups")
    most = max(LIGHT_ROWS, n // HEAVY)
    heavy, light = F.broadcast(groups.where(F.col("group_size") > most)), groups.where(F.col("group_size") <= most)
    grouped = several.join(heavy, "digest").unionByName(several.join(heavy, "digest", "left_anti").join(light, "digest", "left"), allowMissingColumns=True)
    out = {
        "doc_id": F.col("doc_id"),
        "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1)).cast("long"),
        "kept": F.coalesce(F.col("_number") == F.col("keep_number"), F.lit(True)),
        "text_sha256": F.lower(F.hex("digest")),
    } | ({carry: F.col(f"`{carry}`")} if carry else {})
    single = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    passed = alone.select(*[single.get(k, v).alias(k) for k, v in out.items()])
    return passed.unionByName(grouped.select(*[v.alias(k) for k, v in out.items()]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return dedup(docs, id_col, text_col, carry="_row", folder=folder).where("kept").select("_row.*")
