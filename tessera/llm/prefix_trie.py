"""Conversation prefix trie with totals by depth bands.

Conversations that start alike share the nodes of a trie; a node is a distinct
sequence of first turns.  Nobody holds a conversation whole: turns travel as a digest
and a number of words, in groups of at most ``HEIGHT`` turns.

*Keys.*  A node's key is a chain of digests over its turns.  Inside a group of HEIGHT
turns the chain runs over the turns; from group to group it runs over the groups, by
the same function one level up (the groups of a conversation are the turns of the next
level).  So the number of levels is the logarithm of the longest conversation to the
base HEIGHT, most conversations end in the first group, and no group of rows grows.

*Depth-band rollup.*  A band is HEIGHT levels deep: the nodes of one group.  Each node
gives its numbers only to its ancestors inside the band (they are the keys before it in
its group), which bounds the explosion by HEIGHT.  The nodes at the bottom of a band
are the roots of the next; the totals of these band roots come first, by the same
rollup one level up (band roots of HEIGHT bands form a band of that level), and then
enter their own band as one number.  This bounds the rounds by the number of levels.

Positions in a conversation come from one sort over all turns, not from a window per
conversation, so a conversation with a third of all turns is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: Turns of a group, and levels of a depth band.
HEIGHT = 16
#: Conversations that share the start of the first of them, and the most turns shared.
FAMILY, MOST_SHARED = 20, 3
WORD = r"[^\x20\x09-\x0D]+"


def _root() -> Column:
    """The key of the textless root."""
    return F.unhex(F.lit("00" * 16))


def _digest(c: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


# ---- Turns in order, and the rebuilt conversations -------------------------

def _numbered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns, pieces): every turn with its place in the sort; every conversation with its stretches in the sorted files.

    turns: conv_id, part, place, turn digest h, number of words w.  pieces: conv_id,
    number of turns n and, by file, s: part, first (place of its first turn there), n.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    # Written before the sort, which reads its input twice: texts are read once.
    rows = scratch.write(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("_role"), _digest(said).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")), "digests")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("h")]
    at = F.monotonically_increasing_id()
    turns = scratch.write(rows.orderBy(*order).select("conv_id", "h", "w", at.alias("place"))
                          .withColumn("part", F.shiftright("place", 33)), "turns")
    sizes = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # The stretches of one conversation are as many as the files it lies in, at most.
    earlier = F.sort_array(F.collect_list(F.struct("part", "first", "n")))
    spans = sizes.groupBy("conv_id").agg(earlier.alias("s"))
    pieces = spans.select("conv_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n"), "s")
    return turns, pieces


def _rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after sharing: (conv_id, n turns) and (conv_id, pos, h, w, n).

    Conversation c takes the first h turns of conversation c - c % FAMILY (all if that
    has fewer, none if it is absent) and then its own turns after its first h, where h
    is the CRC-32 of the decimal c modulo MOST_SHARED + 1.
    """
    turns, pieces = _numbered(conversations, scratch)
    c = F.col("conv_id")
    shared = (F.crc32(c.cast("string")) % (MOST_SHARED + 1)).cast("int")
    pieces = scratch.write(pieces.select("conv_id", "n", "s", shared.alias("shared"), (c - c % FAMILY).alias("head")), "pieces")
    # The places of the first turns of the conversations that others start from.
    places = F.flatten(F.transform("s", lambda x: F.transform(
        F.sequence(F.lit(0).cast("long"), F.least(x.n, F.lit(MOST_SHARED).cast("long")) - 1),
        lambda k: F.struct(x.part.alias("part"), (x["first"] + k).alias("place")))))
    heads = pieces.where(c == F.col("head")).select("conv_id", F.explode(F.slice(places, 1, MOST_SHARED)).alias("p"))
    first = (heads.select("conv_id", "p.part", "p.place")
             .join(turns.where(c % FAMILY == 0), ["conv_id", "part", "place"])
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "h", "w"))).alias("given"))
             .withColumnRenamed("conv_id", "head"))
    convs = pieces.join(first, "head", "left").select(
        "conv_id", "n", "s", "shared",
        F.slice(F.coalesce("given", F.array().cast("array<struct<place:bigint,h:binary,w:bigint>>")), F.lit(1), F.col("shared")).alias("given"))
    convs = convs.withColumn("taken", F.size("given").cast("long"))
    total = F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))
    convs = scratch.write(convs.withColumn("total", total), "conversations")
    borrowed = convs.select("conv_id", "total", F.posexplode("given").alias("pos", "t")).select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "t.h", "t.w", F.col("total").alias("n"))
    # Where the turns of a stretch go: place - first + turns before it - shared + taken.
    starts = F.aggregate("s", F.array().cast("array<struct<part:bigint,move:bigint>>"), lambda a, x: F.array_append(
        a, F.struct(x.part.alias("part"), (F.aggregate(F.filter("s", lambda y: y.part < x.part), F.lit(0).cast("long"),
                                                       lambda b, y: b + y.n) - x["first"]).alias("move"))))
    moves = convs.select("conv_id", "shared", "taken", "total", F.explode(starts).alias("p")).select(
        "conv_id", "p.part", (F.col("p.move") - F.col("shared") + F.col("taken")).alias("move"), "taken", "total")
    own = (turns.join(moves, ["conv_id", "part"]).withColumn("pos", F.col("place") + F.col("move"))
           .where("pos >= taken").select("conv_id", "pos", "h", "w", F.col("total").alias("n")))
    return convs.select("conv_id", F.col("total").alias("n")), borrowed.unionByName(own)


# ---- Keys ------------------------------------------------------------------

def _keyed(items: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The groups of each level with the keys of their nodes; the first are those of the turns.

    Items are (conv_id, pos, h, whole, ...): the pos-th item of a conversation leads
    from its pos-th node to the next.  A group has conv_id, g, its items t in order and
    the keys of their nodes, the node before its first item included.  ``whole`` is
    false for the last item of a conversation where it stands for a group of fewer
    than HEIGHT turns: no node lies behind it.
    """
    rest = [c for c in items.columns if c not in ("conv_id", "pos")]
    groups = scratch.write(
        items.groupBy("conv_id", F.expr(f"pos div {HEIGHT}").alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("t")), "groups")
    full = (F.size("t") == HEIGHT) & F.element_at("t", -1).whole
    empty = F.lit("").cast("binary")
    deepest = groups.agg(F.max("g")).first()[0] or 0
    above: list[DataFrame] = []
    if deepest:
        # A conversation that ends within its first group needs nothing from above.
        above = _keyed(groups.where((F.col("g") > 0) | full).select(
            "conv_id", F.col("g").alias("pos"), _digest(F.aggregate("t", empty, lambda a, x: F.concat(a, x.h))).alias("h"),
            full.alias("whole")), scratch)
        ends = above[0].select("conv_id", F.col("g").alias("_g"), "keys", F.posexplode("t").alias("i", "x")).select(
            "conv_id", F.col("x.pos").alias("g"), F.get("keys", F.col("i")).alias("base"),
            F.get("keys", F.col("i") + 1).alias("next"))
        groups = groups.join(ends, ["conv_id", "g"], "left")
    else:
        groups = groups.withColumns({"base": F.lit(None).cast("binary"), "next": F.lit(None).cast("binary")})
    chain = F.aggregate("t", F.array(F.coalesce("base", _root())),
                        lambda a, x: F.array_append(a, _digest(F.concat(F.element_at(a, -1), x.h))))
    keys = F.when(full & F.col("next").isNotNull(), F.array_append(F.slice(chain, 1, HEIGHT), F.col("next"))).otherwise(chain)
    return [scratch.write(groups.select("conv_id", "g", "t", keys.alias("keys")), "keys"), *above]


def _members(groups: DataFrame) -> DataFrame:
    """One row for each node and member: its key, the keys before it in the group (path), and the item."""
    return (groups.select("conv_id", "keys", F.posexplode("t").alias("_i", "x")).where("x.whole")
            .select("conv_id", F.get("keys", F.col("_i") + 1).alias("key"), F.slice("keys", F.lit(1), F.col("_i") + 1).alias("path"),
                    (F.col("_i") == HEIGHT - 1).alias("bottom"), "x"))


# ---- Depth-band rollup -----------------------------------------------------

SUMS = ("saved", "leaves")


def _totals(nodes: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(key, saved, leaves, children): sums over the subtree of every node, and of the root, by key.

    ``nodes`` (key, path, bottom, saved, leaves) are those of levels[0]; the levels
    above hold the band roots.  children counts the nodes right below.
    """
    carried = nodes
    if len(levels) > 1:
        inner, roots = nodes.where("not bottom"), nodes.where("bottom")
        within = inner.groupBy(F.get("path", F.lit(0)).alias("key")).agg(*[F.sum(c).alias(f"_{c}") for c in SUMS])
        above = _members(levels[1]).groupBy("key").agg(F.first("path").alias("path"), F.first("bottom").alias("bottom"))
        weighed = above.join(roots.select("key", *SUMS), "key").join(within, "key", "left").select(
            "key", "path", "bottom", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS])
        done = _totals(scratch.write(weighed, "band-roots"), levels[1:], scratch).drop("children")
        carried = inner.unionByName(roots.drop(*SUMS).join(done, "key").select(nodes.columns))
    up = carried.select("path", *SUMS, F.posexplode("path").alias("_i", "key")).select(
        "key", *SUMS, (F.col("_i") == F.size("path") - 1).cast("long").alias("children"))
    own = nodes.select("key", *SUMS, F.lit(0).cast("long").alias("children"))
    return scratch.write(up.unionByName(own).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in (*SUMS, "children")]), "totals")


# ---- Conversations that end in a node ---------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows of a partition as pieces of comma-joined ids, one for a key and batch."""
    for batch in batches:
        keys, ids = (batch.column(c).to_pylist() for c in ("key", "conv_id"))
        out, at = [], 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            out.append((keys[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
            (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's pieces, read one after the other in the order of their first ids."""
    key, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield _hashed(done)
        done = []
    if key is not None:
        yield _hashed([(key, state.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      ["key", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id) rows: the digest of the ids in ascending order, comma-joined.

    The sort spreads the ids of one node over many tasks, which join them to pieces;
    a node's pieces then run through one digest, so no task holds the ids of a node.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (ends.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(bounded(_pieces, 4096), "key binary, first long, ids string"))
    return (pieces.repartition(parts, "key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(_hashes, "key binary, ends_sha256 string"))


# ---- The trie ----------------------------------------------------------------

def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (conv_id, turn, role, text).

    Columns, all long but the last: conv_id (smallest member), depth, parent_conv_id
    (conv_id of the parent; null for the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (sum over the subtree of
    (n_convs - 1) times the words of a node's last text), ends_sha256 (SHA-256 of the
    ids of the members that end here, ascending and comma-joined; that of the empty
    text without any).

    Turns are ordered by ``turn``, nulls first; rows of one turn follow each other by
    role, then by the SHA-256 of role and text, and repeated rows are turns of their
    own.  Null roles and texts are empty.  Rows without a conv_id are left out; for
    negative ids c % 20 has the sign of c.  An empty table gives no rows.  A turn is
    known by 128 bits of its SHA-256.  Further columns do no harm.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    convs, turns = _rebuilt(conversations, scratch)
    levels = _keyed(turns.withColumn("whole", F.lit(True)), scratch)
    members = _members(levels[0]).select("*", "x.pos", "x.w", (F.col("x.pos") + 1 == F.col("x.n")).alias("end"))
    n = F.count(F.lit(1))
    nodes = members.groupBy("key").agg(
        F.first("path").alias("path"), F.first("bottom").alias("bottom"), (F.first("pos") + 1).alias("depth"),
        F.min("conv_id").alias("conv_id"), n.alias("n_convs"), ((n - 1) * F.first("w")).alias("saved"),
        (F.count_if("end") == n).cast("long").alias("leaves"))
    nodes = scratch.write(nodes, "nodes")
    totals = _totals(nodes.select("key", "path", "bottom", *SUMS), levels, scratch)
    root = convs.agg(F.min("conv_id").alias("conv_id"), n.alias("n_convs")).where("n_convs > 0").select(
        _root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs")
    every = nodes.select("key", F.element_at("path", -1).alias("parent"), "depth", "conv_id", "n_convs").unionByName(root)
    every = scratch.write(every, "every")
    ends = _ends(members.where("end").select("key", "conv_id").unionByName(
        convs.where("n = 0").select(_root().alias("key"), "conv_id")))
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (every.join(totals, "key", "left").join(ends, "key", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
                    F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


ORACLE = r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
           turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, h, len(regexp_extract_all(x, '[^ 	-
]+')) AS w,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, h) - 1 AS i FROM turns),
k AS (SELECT c, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                 lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 4 AS s
      FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
built AS (
    SELECT k.c, t.i AS p, t.h, t.w FROM k JOIN t ON t.c = k.c - k.c % 20 AND t.i < k.s
    UNION ALL
    SELECT t.c, t.i - k.s + least(k.s, coalesce(m.n, 0)), t.h, t.w
    FROM t JOIN k ON k.c = t.c LEFT JOIN k AS m ON m.c = k.c - k.c % 20 WHERE t.i >= k.s),
paths AS (SELECT c, p + 1 AS d, w, string_agg(h, ',') OVER (PARTITION BY c ORDER BY p) AS key FROM built
          UNION ALL SELECT c, 0, 0, '' FROM k),
lengths AS (SELECT c, max(d) AS l FROM paths GROUP BY c),
nodes AS (SELECT key, max(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * max(w) AS saved,
                 CASE WHEN max(d) > 1 THEN key[1:65 * max(d) - 66] WHEN max(d) = 1 THEN '' END AS parent,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = l), '') AS ends
          FROM paths JOIN lengths USING (c) GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
leafed AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
up AS (SELECT CASE WHEN j = 0 THEN '' ELSE key[1:65 * j - 1] END AS key, saved, n_children = 0 AS leaf
       FROM (SELECT *, unnest(range(0, CAST(d AS BIGINT) + 1)) AS j FROM leafed)),
sums AS (SELECT key, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM up GROUP BY key)
SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, b.c AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs,
       CAST(a.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM leafed AS a JOIN sums USING (key) LEFT JOIN nodes AS b ON b.key = a.parent
"""
