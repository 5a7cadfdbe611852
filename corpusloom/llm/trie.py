"""The prefix trie of conversations, with subtree totals by depth bands.

Conversations that begin alike share a path of nodes. A node is known by the XOR of 120-bit digests of its turns
with their places (so two different beginnings meet by accident with a probability of about 2^-120 only), which is a
running aggregate: prefixes of a conversation of any length are found by cells of 1,024 turns and the cells' XORs, and
no task has to hold a conversation. Nodes are the groups of equal digests, combined in each task first, so a turn
that a third of all conversations begin with is no hot group.

Subtree totals come by bands of ``BAND`` levels. Each node is exploded to its ancestors inside its band only, and
summed up there. What a band's root has then is added to the root's ancestors in the band above, once it is complete;
and it is completed by the same step, applied to the tree of band roots alone, which is lower by a factor of
``BAND``. So a node makes ``BAND`` rows at most, and a trie of depth D takes log D rounds (base ``BAND``).

Rows: a null role or text is empty. Null turns come first; rows of equal turns come in the order of their digests,
and repeated rows are turns each. Rows without a conv_id belong to no conversation and are left out. Texts of any
length are digested where they are read and not shuffled. Other columns are not read. An empty table has no node, not
even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Win

from corpusloom.llm.components import stored
from corpusloom.operators.order import sum_before

#: Levels of a band.
BAND = 16
#: Turns of a cell (1,024), and cells of a cell above, where prefixes and numbers are summed up.
CELLS = (10, 16)
#: Ids of 2^12 consecutive numbers are joined to one string before they are digested.
CHUNK_BITS = 12
#: A conversation takes over the first turns of the first one of its block of ids.
BLOCK, MOST_HEAD = 100, 5


def digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, chars``: one narrow row per turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length keeps role and text apart
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("place"),
        F.concat(F.col("turn").isNotNull().cast("int").cast("string"), F.sha2(whole, 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, i, n, digest, chars``: turns numbered from 1, and how many there are."""
    placed = sum_before(
        turns.withColumn("one", F.lit(1)), "place", "one", "before", ["conv_id"], ["digest"], "n", CELLS
    )
    return placed.select("conv_id", (F.col("before") + 1).alias("i"), "n", F.substring("digest", 2, 64).alias("digest"), "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, d, digest, chars, length``: every conversation with the first h turns of its block's first one
    for its own first h; row d = 0 is its start."""
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    own = turns.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)})
    # five rows of one conversation at most
    heads = (
        own.filter((F.col("conv_id") == F.col("base")) & (F.col("i") <= MOST_HEAD))
        .groupBy(F.col("conv_id").alias("of"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "digest", "chars"))).alias("head"))
    )
    joined = own.join(heads, F.col("base") == F.col("of"), "left").withColumn(
        "taken", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    ).withColumn("k", F.size("taken").cast("long"))

    def row(d: Column, digest: Column, chars: Column) -> Column:
        return F.struct(d.alias("d"), digest.alias("digest"), chars.alias("chars"))

    start = F.array(row(F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(0).cast("long")))
    taken = F.transform("taken", lambda x: row(x["i"], x["digest"], x["chars"]))
    mine = F.array(row(F.col("k") + F.col("i") - F.col("h"), F.col("digest"), F.col("chars")))
    none = F.array().cast("array<struct<d:bigint,digest:string,chars:bigint>>")
    made = F.concat(
        F.when(F.col("i") == 1, F.concat(start, taken)).otherwise(none), F.when(F.col("i") > F.col("h"), mine).otherwise(none)
    )
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return joined.select("conv_id", length.alias("length"), F.inline(made))


def running_xor(
    rows: DataFrame, lanes: Sequence[str], place: str = "d", length: str = "length", shifts: Sequence[int] = CELLS
) -> DataFrame:
    """Replace ``lanes`` by their XOR over the rows of ``conv_id`` up to this one."""
    if not shifts:
        inside = Win.partitionBy("conv_id").orderBy(place).rowsBetween(Win.unboundedPreceding, Win.currentRow)
        return rows.withColumns({c: F.bit_xor(c).over(inside) for c in lanes})
    cell, rest = f"cell{len(shifts)}", f"rest{len(shifts)}"
    celled = rows.withColumn(cell, F.shiftright(place, shifts[0]))
    inside = Win.partitionBy("conv_id", cell).orderBy(place).rowsBetween(Win.unboundedPreceding, Win.currentRow)
    # conversations of one cell have nothing before it
    longer = celled.filter(F.col(length) >= 1 << shifts[0]).groupBy("conv_id", cell)
    totals = longer.agg(*[F.bit_xor(c).alias(c) for c in lanes], F.shiftright(F.max(length), shifts[0]).alias(rest))
    before = running_xor(totals, lanes, cell, rest, shifts[1:]).select(
        "conv_id", (F.col(cell) + 1).alias(cell), *[F.col(c).alias(f"{c}_before") for c in lanes]
    )
    joined = celled.withColumns({c: F.bit_xor(c).over(inside) for c in lanes}).join(before, ["conv_id", cell], "left")
    return joined.withColumns(
        {c: F.col(c).bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0).cast("long"))) for c in lanes}
    ).drop(cell, *[f"{c}_before" for c in lanes])


def members(conversations: DataFrame) -> DataFrame:
    """``conv_id, node, parent, chars, ends``: one row per conversation and prefix; a node is ``d, k1, k2``."""
    rows = rebuilt(stored(numbered(digests(conversations)), "turns"))
    placed = F.sha2(F.concat_ws(":", F.col("d").cast("string"), F.col("digest")), 256)
    lanes = {
        f"e{j + 1}": F.when(F.col("d") == 0, 0).otherwise(F.conv(F.substring(placed, 15 * j + 1, 15), 16, 10).cast("long"))
        for j in range(2)
    }
    rows = rows.withColumns(lanes).select("conv_id", "d", "length", "chars", "e1", "e2")
    rows = stored(rows.withColumns({"k1": F.col("e1"), "k2": F.col("e2")}), "prefixes")
    known = running_xor(rows, ["k1", "k2"])

    def node(d: Column, *keys: Column) -> Column:
        return F.struct(d.cast("int").alias("d"), *[k.alias(f"k{j + 1}") for j, k in enumerate(keys)])

    d = F.col("d")
    above = node(d - 1, F.col("k1").bitwiseXOR(F.col("e1")), F.col("k2").bitwiseXOR(F.col("e2")))
    return stored(
        known.select(
            "conv_id", node(d, F.col("k1"), F.col("k2")).alias("node"), F.when(d > 0, above).alias("parent"),
            "chars", (d == F.col("length")).alias("ends"),
        ), "members",
    )


def band_paths(paths: DataFrame, step: int) -> DataFrame:
    """``node, visits, up``: nodes at every ``step``-th depth with their ancestors at such depths, inside a band.

    ``up`` ends with the node itself. The root of a band also visits the band above: there ``up`` is that band's
    whole path down to it, without itself.
    """
    d, height = F.col("node.d"), step * BAND
    band = F.floor(d / height)
    visit = F.when((d > 0) & (d % height == 0), F.array(F.struct((band - 1).alias("band"), F.lit(True).alias("visits"))))
    own = F.array(F.struct(band.alias("band"), F.lit(False).alias("visits")))
    rows = paths.filter(d % step == 0).select("conv_id", "node", F.inline(F.concat(own, F.coalesce(visit, F.slice(own, 1, 0)))))
    inside = Win.partitionBy("conv_id", "band").orderBy("node.d").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    # a band's levels and one more at most
    up = rows.withColumn("up", F.collect_list("node").over(inside))
    up = up.withColumn("up", F.when(F.col("visits"), F.slice("up", 1, BAND)).otherwise(F.col("up")))
    return stored(up.groupBy("node", "visits").agg(F.any_value("up").alias("up")), "bands")


def subtree_sums(paths: DataFrame, values: DataFrame, columns: Sequence[str], depth: int, step: int = 1) -> DataFrame:
    """``node`` and the sums of ``columns`` over its subtree, itself included.

    ``paths`` has ``conv_id, node`` for every prefix of every conversation, ``values`` one row per node at every
    ``step``-th depth; ``depth`` is the largest depth.
    """
    bands = band_paths(paths, step)
    sums = [F.sum(c).alias(c) for c in columns]

    def upwards(from_: DataFrame, visits: bool) -> DataFrame:
        ways = bands.filter(F.col("visits") == visits).select("node", "up")
        return from_.join(ways, "node").select(F.explode("up").alias("node"), *columns)

    inside = upwards(values, False).groupBy("node").agg(*sums)
    if depth < step * BAND:
        return inside
    inside = stored(inside, "inside")
    roots = inside.filter(F.col("node.d") % (step * BAND) == 0)
    complete = subtree_sums(paths, roots, columns, depth, step * BAND)
    return inside.unionByName(upwards(complete, True)).groupBy("node").agg(*sums)


def end_digests(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256``: of the conversations that end at a node, their ascending ids joined by commas.

    Ids are sorted and joined in chunks; a node's chunks then pass through one digest, in order, one at a time,
    as a digest of one string has to.
    """
    ended = paths.filter("ends").select("node", "conv_id", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ended.groupBy("node", "chunk").agg(F.array_join(ids, ",").alias("ids"))
    chunks = chunks.select("node.*", "chunk", "ids").repartition("d", "k1", "k2")
    chunks = chunks.sortWithinPartitions("d", "k1", "k2", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done):
            columns = list(zip(*done)) if done else [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              names=["d", "k1", "k2", "ends_sha256"])

        now, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "k1", "k2", "ids"))):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            yield rows(done)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    found = chunks.mapInArrow(run, "d int, k1 long, k2 long, ends_sha256 string")
    return found.select(F.struct("d", "k1", "k2").alias("node"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    paths = members(conversations)
    nodes = stored(
        paths.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.max("chars").alias("chars"), F.max("parent").alias("parent"),
        ), "nodes",
    )
    depth = nodes.agg(F.max("node.d")).first()[0] or 0
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"))
    counted = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), "node", "left").fillna(0, ["n_children"])
    values = counted.select(
        "node", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_sums(paths.select("conv_id", "node"), values, ["n_leaves", "saved_tokens"], depth)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        counted.join(totals, "node")
        .join(end_digests(paths), "node", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id", F.col("node.d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
