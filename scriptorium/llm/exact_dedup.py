"""Exact duplicates by two passes over a Bloom filter, in Spark expressions only.

The first pass sets ``HASHES`` bits for the digest of each text and keeps the bits that more than one row sets: a
blocked Bloom filter of repeated digests. Its bits travel as counted positions, combined before the shuffle, so a
group of copies is one position per task. The second pass holds each digest against the filter, which is
broadcast: rows with a bit that is not set cannot have a twin and pass straight through; only the others
shuffle, to be grouped by the whole digest. A false alarm costs a shuffled row and changes no result.

The filter grows with the table (``BITS_PER_ROW``), its broadcast does not: digests beyond ``FILTER_BLOCKS``
blocks are dealt to slices by their hash, and each slice has its own filter and its own pass over its digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed
from scriptorium.llm.native import lower_ascii
from scriptorium.session import broadcast_if_small

#: Bits that a digest sets, both in one block.
HASHES = 2
#: Bits of the filter per row of the table: about one row in twenty without a twin is taken for one with a twin.
BITS_PER_ROW = 8
#: Bits of a block; the size that Spark's bitmap functions work with.
BLOCK_BITS = 32768
#: Blocks of 4 KB in one broadcast filter: 64 MB.
FILTER_BLOCKS = 16384
#: Groups that hold more than this share of the rows meet their rows by a broadcast; there are no more than its inverse.
HOT_SHARE = 1000
#: Repeated digests that are broadcast to whole rows, 100 bytes each; more meet them in a shuffle.
BROADCAST_DIGESTS = 500_000


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, lowercase hex; null is the empty text."""
    return F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "utf-8"), 256)


def _places(sha: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest, and its bits in there."""
    hashed = F.xxhash64(sha)
    bits = [F.shiftrightunsigned(hashed, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]
    return F.pmod(F.shiftrightunsigned(hashed, 15 * HASHES), F.lit(blocks)), bits


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """``(block, bitmap)``: the bits that more than one row sets. Blocks without such a bit are left out."""
    block, bits = _places(F.col("sha"), blocks)
    set_bits = digests.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    twice = set_bits.groupBy("block", "bit").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftrightunsigned(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


def flagged(digests: DataFrame, blocks: int) -> DataFrame:
    """``digests (sha, ...)`` with ``_maybe``: false for rows whose digest surely occurs once."""
    found = repeated_filter(digests, blocks)
    block, bits = _places(F.col("sha"), blocks)
    # At most ``blocks`` rows of 4 KB, a bound that the caller keeps.
    joined = digests.withColumn("block", block).join(F.broadcast(found), "block", "left")
    maybe = reduce(Column.__and__, [_is_set(F.col("bitmap"), bit) for bit in bits])
    return joined.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("block", "bitmap")


def _filter_sizes(rows: int, filter_blocks: int) -> tuple[int, int]:
    """Slices of the digests, and blocks of the filter of each."""
    blocks = -(-rows * BITS_PER_ROW // BLOCK_BITS)
    slices = max(1, -(-blocks // filter_blocks))
    return slices, max(1, -(-blocks // slices))


def _marked(digests: DataFrame, filter_blocks: int) -> DataFrame:
    """The checkpointed digests with ``_maybe``, slice by slice."""
    slices, blocks = _filter_sizes(digests.count(), filter_blocks)
    if slices == 1:
        return checkpointed(flagged(digests, blocks))
    slice_of = F.pmod(F.xxhash64("sha", F.lit("slice")), F.lit(slices))
    return reduce(DataFrame.unionByName, [checkpointed(flagged(digests.filter(slice_of == i), blocks)) for i in range(slices)])


def duplicate_groups(docs: DataFrame, key: str, text: str = "text", filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal when they are after A-Z are lower-cased; null counts as the empty text. Of equal texts the row with
    the largest key stays. Null keys are smaller than all others, so such a row stays only where all of its group's keys are null.
    Of rows with equal key and text one stays. No rows give no rows; other columns are not read.
    """
    numbered = docs.select(docs[key].alias("id"), digest(docs[text]).alias("sha")).withColumn("row", F.monotonically_increasing_id())
    marked = _marked(checkpointed(numbered), filter_blocks)
    alone = marked.filter("NOT _maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = marked.filter("_maybe").drop("_maybe")
    # Partial aggregation makes a group of copies one row per task before anything moves.
    groups = checkpointed(maybe.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")))
    limit = F.lit(max(1, marked.count() // HOT_SHARE))
    hot = groups.filter(F.col("group_size") > limit)
    by_hot = maybe.join(F.broadcast(hot), "sha")
    rest = maybe.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(groups.filter(F.col("group_size") <= limit), "sha")
    found = by_hot.unionByName(rest).select("id", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "sha")
    return alone.unionByName(found).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str, text: str = "text", filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in no fixed order.

    Rows whose digest the filter shows to be alone are not moved; of the others, whole rows are reduced to one per text, before and
    after the shuffle. Which rows stay is as in ``duplicate_groups``; of rows with equal key and text any one stays.
    """
    marked = _marked(checkpointed(docs.select(digest(docs[text]).alias("sha"))), filter_blocks)
    repeated = checkpointed(marked.filter("_maybe").groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha"))
    repeated = broadcast_if_small(repeated, BROADCAST_DIGESTS)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[key].alias("_key"), digest(docs[text]).alias("sha"))
    alone = whole.join(repeated, "sha", "left_anti")
    stays = whole.join(repeated, "sha", "left_semi").groupBy("sha").agg(F.max_by("_row", F.struct("_key")).alias("_row"))
    return alone.select("_row.*").unionByName(stays.select("_row.*"))
