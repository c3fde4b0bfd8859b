"""A prefix trie of conversations by fixed-length block hashing.

Turns are hashed once and from then on go as a digest and a length. A conversation is cut into blocks of a few turns; the
digests of its first blocks name where it stands after each of them. Conversations are grouped by these names first. Only
where more than one block follows the same blocks (siblings that diverge) are turn boundaries inside them looked at one
by one; elsewhere the turns of a block have the block's members.

Sums over subtrees need no walk up the trie: a node belongs to its smallest member, the nodes of one conversation form the
lower part of its path, and so the sum over a subtree is that over its members' nodes but for those of its smallest
member that lie above it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soukspark.llm.common import cut, join_hot, partitions

#: Turns of a block.
BLOCK = 4
#: Width in ``place`` of what one window adds up; wider keys are added up in segments of that width.
SEGMENT = 4096
_ID, _GROUP = ["depth", "b1", "b2"], ["gd", "g1", "g2"]


def running(rows: DataFrame, key: str, place: str, how: dict, *ties: str) -> DataFrame:
    """``rows`` with the aggregates of the rows of their key before them by ``place`` (whole numbers, nulls first).

    how: by name an aggregate function, its column, and how two of its values are put together; nothing gives 0. A key's
    rows are dealt over windows by ranges of ``place``, so that no task need order all of a long one's.
    """
    rows = rows.withColumn("_seg", F.coalesce(F.floor(F.col(place) / SEGMENT).cast("long"), F.lit(-(1 << 62)).cast("long")))
    order = [F.asc_nulls_first(place), *ties]
    inside = Window.partitionBy(key, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(key).alias("_key"), F.col("_seg").alias("_of")).agg(*[f(c).alias(f"_{n}") for n, (f, c, _) in how.items()])
    totals = [(F.bit_xor if f is F.bit_xor else F.sum)(f"_{n}").over(earlier).alias(f"_{n}") for n, (f, _, _) in how.items()]
    before = sums.select("_key", "_of", *totals, F.row_number().over(Window.partitionBy("_key").orderBy("_of")).alias("_nth"))
    before = before.where("_nth > 1").drop("_nth")
    out = rows.withColumns({n: F.coalesce(f(c).over(inside), F.lit(0)).cast("long") for n, (f, c, _) in how.items()})
    out = out.join(before, (F.col(key) == F.col("_key")) & (F.col("_seg") == F.col("_of")), "left")
    return out.withColumns({n: both(F.col(n), F.coalesce(f"_{n}", F.lit(0)).cast("long")) for n, (_, _, both) in how.items()}).drop("_seg", "_key", "_of", *[f"_{n}" for n in how])


def _add(a, b):
    return a + b


def _xor(a, b):
    return a.bitwiseXOR(b)


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, place, digest, chars``: the turns in order, counted from 0; ``chars``: code points of the text.

    Null roles and texts are empty; null turns come first; turns of equal number come by the digest of role and text.
    Rows that repeat another are turns of their own. Rows with a null conversation take no part. Other columns are not read.
    """
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("_turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars"))
    rows = cut(rows.where("conv is not null"))
    return running(rows, "conv", "_turn", {"place": (F.count, F.lit(1), _add)}, "digest").select("conv", "place", "digest", "chars")


def _stepped(blocks: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and a row for each turn of a block: ``depth``, the names before (``a1, a2``) and after it (``b1, b2``), ``chars``."""
    name = lambda k: f"aggregate(slice(turns, 1, i), q{k}, (x, y) -> x ^ y.f{k})"
    step = f"named_struct('depth', t.place + 1, 'a1', {name(1)}, 'a2', {name(2)}, 'b1', {name(1)} ^ t.f1, 'b2', {name(2)} ^ t.f2, 'chars', t.chars)"
    return blocks.select(*keep, F.explode(F.expr(f"transform(turns, (t, i) -> {step})")).alias("s")).select(*keep, "s.*")


def blocked(rows: DataFrame) -> DataFrame:
    """``conv, j, q1, q2, p1, p2, r, turns``: the blocks of conversations, named by all up to (q) and with them (p).

    A name is 128 bits: the exclusive-or of two hashes of each place and digest."""
    rows = rows.where("place is not null").select("conv", "place", "chars", F.xxhash64("place", "digest").alias("f1"), F.xxhash64("digest", "place", F.lit(1)).alias("f2"))
    made = rows.groupBy("conv", F.expr(f"place div {BLOCK}").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct("place", "f1", "f2", "chars"))).alias("turns"), F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2")
    )
    made = running(cut(made), "conv", "j", {f"q{k}": (F.bit_xor, f"x{k}", _xor) for k in (1, 2)})
    return cut(made.select("conv", "j", "q1", "q2", *[F.col(f"q{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)], F.size("turns").cast("long").alias("r"), "turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, b1, b2, ends_sha256``: of each node the hash of the conversations that end there. The numbers of a node
    stream through one hash in order, as its definition asks; memory doesn't grow with them."""

    def of(batches):
        at, h, out = None, None, []

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.string())], [*_ID, "ends_sha256"])

        for batch in batches:
            for *name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    if at is not None:
                        out.append((*at, h.hexdigest()))
                    at, h = name, hashlib.sha256(str(conv).encode())
                else:
                    h.update(b",%d" % conv)
            if out:
                yield done()
                out = []
        if at is not None:
            out.append((*at, h.hexdigest()))
            yield done()

    met = rows.select(*_ID, "conv").repartition(partitions(rows.sparkSession), *_ID).sortWithinPartitions(*_ID, "conv")
    return met.mapInArrow(of, "depth long, b1 long, b2 long, ends_sha256 string")


def tree(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a row for each node.

    ``rows``: ``conv, place, digest, chars`` as ``turns`` gives them; a row with a null place only says that there is such
    a conversation. A node is a distinct sequence of first turns, the root that of none; its members are the conversations
    that start with it, ``conv_id`` the smallest of them; ``saved_tokens``: summed over its subtree, what a text's code
    points come to in all members but one; ``ends_sha256``: of the members that end there, in ascending order, joined by
    commas. No conversations: no rows, not even the root.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    convs = cut(rows.groupBy("conv").agg(F.count("place").alias("n_turns")))
    whole = convs.agg(F.count("*").cast("long").alias("n"), F.min("conv").alias("least")).first()
    blocks = blocked(rows)

    # which blocks follow the same blocks; where it is more than one, turns are looked at
    block = ["j", "q1", "q2", "p1", "p2", "r"]
    follow = cut(blocks.groupBy(*block).agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.first("turns").alias("turns")))
    after = cut(follow.groupBy("j", "q1", "q2").agg(F.count("*").alias("follow"), F.sum("n").alias("weight")))
    kinds = after.select("j", "q1", "q2", (F.col("follow") > 1).alias("diverge"), "weight")
    blocks = cut(join_hot(blocks, kinds, ["j", "q1", "q2"], "weight"))
    alone = join_hot(follow, after.select("j", "q1", "q2", F.col("follow").alias("weight")), ["j", "q1", "q2"], "weight").where("weight = 1")

    fine = _stepped(blocks.where("diverge"), "conv").groupBy("a1", "a2", *_ID, "chars").agg(F.count("*").alias("n"), F.min("conv").alias("least"))
    fine = fine.select("n", "least", "a1", "a2", *_ID, "chars", *[F.col(c).alias(g) for c, g in zip(_ID, _GROUP, strict=True)])
    end = [F.expr(f"j * {BLOCK} + r").alias("gd"), F.col("p1").alias("g1"), F.col("p2").alias("g2")]
    coarse = _stepped(alone.select("n", "least", *end, "q1", "q2", "turns"), "n", "least", *_GROUP)
    root = [(whole.n, whole.least, None, None, 0, 0, 0, 0, 0, 0, 0)] if whole.n else []
    names = ["n", "least", "a1", "a2", *_ID, "chars", *_GROUP]
    nodes = fine.select(*names).unionAll(coarse.select(*names)).unionAll(spark.createDataFrame(root, ", ".join(f"{c} long" for c in names)))
    nodes = cut(nodes)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("a1").alias("b1"), F.col("a2").alias("b2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _ID, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": F.expr("(n - 1) * chars")})
    nodes = cut(running(cut(nodes), "least", "depth", {"above": (F.sum, "saved", _add)}))

    # what each conversation's own nodes save, and the leaf that it stands for, summed over members
    owners = cut(nodes.groupBy(F.col("least").alias("conv")).agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")).where("saved > 0 or leaves > 0"))
    owned = blocks.join(owners, "conv")
    parts = _stepped(owned.where("diverge"), "saved", "leaves").select(*[F.col(c).alias(g) for c, g in zip(_ID, _GROUP, strict=True)], "saved", "leaves")
    parts = parts.unionAll(owned.where("not diverge").select(*end, "saved", "leaves"))
    zero = [F.lit(0).cast("long").alias(g) for g in _GROUP]
    parts = parts.unionAll(owners.select(*zero, "saved", "leaves"))
    sums = parts.groupBy(*_GROUP).agg(F.sum("saved").alias("members_saved"), F.sum("leaves").alias("n_leaves"))
    nodes = cut(nodes.join(sums, _GROUP, "left").withColumn("saved_tokens", F.expr("members_saved - above")))

    ends = blocks.join(convs, "conv").where(f"j * {BLOCK} + r = n_turns").select(F.col("n_turns").alias("depth"), F.col("p1").alias("b1"), F.col("p2").alias("b2"), "conv")
    ends = ends.unionAll(convs.where("n_turns = 0").select(*[F.lit(0).cast("long").alias(c) for c in _ID], "conv"))
    nodes = nodes.join(_ends(ends), _ID, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))

    parent = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("least").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    nodes, parent = cut(nodes), cut(parent)
    out = join_hot(nodes.where("depth > 0"), parent, ["depth", "a1", "a2"], "weight").unionByName(nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "weight": F.lit(0).cast("long")}))
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
