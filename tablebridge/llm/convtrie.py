"""Prefix trie of conversations: which turns they share from the start, and what storing these once would save.

A burst trie. A suffix container holds the rest of all conversations below one prefix. Containers that hold more than ``CAP`` turns burst
by the next turn id: their prefix becomes a node of the trie's head, and each suffix moves to the container of its next turn. One
round bursts several levels (8, then 16, 32 and so on), reads only conversations that are in oversized containers still, and ends when
no container at its last level is oversized. What remains holds at most ``CAP`` turns, so a task sorts it by turn ids and sweeps it into nodes.

A turn id is the MD5 of role and text. A prefix is named by the exclusive or of two 64-bit hashes of each (depth, turn id), which a running
aggregate gives for conversations of any length; the parent's name is that of the prefix without its last turn.

Rows: those with a null conv_id take no part; turns go by number, nulls first, equal numbers by role and then turn id, so that repeated rows are
repeated turns. An empty table has no node, not even a root. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablebridge.operators.scan import running

from .common import by_group, join_hot, materialise

#: Most turns in a container, counted with all that follow in its suffixes.
CAP = 256
#: Levels that the first round of bursting looks at; each further round looks at twice as many.
LEVELS = 8
#: Most original turns of the hundred's first conversation that a rebuilt one begins with.
HEAD = 5

NODE = ["h1", "h2"]
SWEPT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, p1 long, p2 long"


def _keep(df: DataFrame) -> DataFrame:
    return materialise(df, "trie")


def _name(depth: Column, tid: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, tid), F.xxhash64(tid, depth, F.lit(1))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, tid, n, pos``: turns with their ids, code points and places from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), tid.alias("tid"), F.char_length(text).cast("long").alias("n"), F.monotonically_increasing_id().alias("tie"))
    return _keep(running(turns, ["conv_id"], ["turn", "role", "tid", "tie"], {"pos": ("sum", F.lit(1))}, _keep).drop("turn", "role", "tie"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, tid, n, len)`` and ``(conv_id, len)`` of conversations with the head of their hundred's first one.

    h = crc32(conv_id) % 6 turns are taken from conversation conv_id - conv_id % 100, and the own first h are left out.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    first = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "n"))).alias("first"))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    head = F.when(F.col("first").isNotNull() & (h > 0), F.slice("first", F.lit(1), F.greatest(h, F.lit(1))))
    convs = _keep(sizes.join(first, "base", "left").select("conv_id", "own", head.alias("head")).withColumn("k", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("k", F.greatest("k", F.lit(0).cast("long"))).withColumn("len", F.col("k") + F.greatest(F.col("own") - h, F.lit(0).cast("long"))))
    taken = convs.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.tid", "t.n", "len")
    own = join_hot(turns.where(F.col("pos") > h), convs.select("conv_id", "own", "k", "len"), "conv_id", "own").select("conv_id", (F.col("pos") - h + F.col("k")).alias("depth"), "tid", "n", "len")
    return taken.unionByName(own), convs.select("conv_id", "len")


def burst(paths: DataFrame, cap: int = CAP, levels: int = LEVELS) -> DataFrame:
    """Nodes of the trie's head: prefixes whose containers, as they burst, held more than ``cap`` turns.

    paths: ``conv_id, depth, h1, h2, p1, p2, n, left`` (turns from here to the end). A prefix is in one round only, so the rounds' tables are
    disjoint; nothing but a yes or no of each round reaches the driver.
    """
    low, high, rows, found = 0, levels, paths, []
    while True:
        part = rows.where((F.col("depth") > low) & (F.col("depth") <= high))
        each = part.groupBy(*NODE).agg(
            F.sum("left").alias("held"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
            *[F.any_value(c).alias(c) for c in ("depth", "n", "p1", "p2")],
        )
        found.append(_keep(each.where(F.col("held") > cap)))
        still = found[-1].where(F.col("depth") == high).select(*NODE)
        if not still.limit(1).count():
            return reduce(DataFrame.unionByName, found).drop("held")
        inside = _keep(part.where(F.col("depth") == high).join(still, NODE, "left_semi").select("conv_id"))
        rows = paths.join(inside, "conv_id", "left_semi")
        low, high, levels = high, high + 2 * levels, 2 * levels


def sweep(groups):
    """Sort each container's suffixes and walk them once: a node for each distinct prefix, with its counts and those of its subtree."""
    for batch in groups:
        suffixes = [([(s["tid"], s["n"], s["h1"], s["h2"]) for s in r["path"]], r["path"][0], r["conv_id"]) for r in batch.to_pylist()]
        # The group is one half of the container's name; the other half comes first in the order.
        suffixes.sort(key=lambda x: (x[1]["h2"], [t[0] for t in x[0]], x[2]))
        out, open_nodes, before, name = [], [], [], None

        def close():
            node = open_nodes.pop()
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("n")
            node["ends_sha256"] = hashlib.sha256(",".join(map(str, sorted(node.pop("ends")))).encode()).hexdigest()
            if open_nodes:
                up = open_nodes[-1]
                up["n_children"] += 1
                up["n_leaves"] += node["n_leaves"]
                up["saved_tokens"] += node["saved_tokens"]
                node["up"] = up
            out.append(node)

        for path, top, conv in suffixes:
            common = 0
            if top["h2"] == name:
                while common < min(len(path), len(before)) and path[common][0] == before[common][0]:
                    common += 1
            while len(open_nodes) > common:
                close()
            for i in range(common, len(path)):
                open_nodes.append({"conv_id": conv, "depth": top["depth"] + i, "n": path[i][1], "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends": [], "top": i == 0, "p1": top["p1"], "p2": top["p2"], "up": None})
            for node in open_nodes:
                node["n_convs"] += 1
                node["conv_id"] = min(node["conv_id"], conv)
            open_nodes[-1]["ends"].append(conv)
            before, name = path, top["h2"]
        while open_nodes:
            close()
        for node in out:
            up = node.pop("up")
            node["parent_conv_id"] = up["conv_id"] if up else None
        yield pa.RecordBatch.from_pylist(out, schema=SWEPT_ARROW)


SWEPT_ARROW = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in SWEPT.split(", "))])


def containers(rest: DataFrame) -> DataFrame:
    """Sweep what is not in the head: a suffix has at most CAP turns by the rule of bursting, and so has its container."""
    suffix = rest.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "tid", "n", "p1", "p2"))).alias("path"))
    return by_group(suffix.withColumn("at", F.col("path")[0]["h1"]), "at", sweep, SWEPT)


def _packed(batches):
    """Runs of sorted (h1, h2, conv_id) rows as rows of up to 4,096 ids in one text."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, held = None, []

    def row():
        return pa.RecordBatch.from_pylist([{"h1": node[0], "h2": node[1], "first": held[0], "ids": ",".join(map(str, held))}], schema=schema)

    for b in batches:
        for h1, h2, conv in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if held and ((h1, h2) != node or len(held) == 4096):
                yield row()
                held = []
            node = (h1, h2)
            held.append(conv)
    if held:
        yield row()


def _hashed(batches):
    """SHA-256 of each node's texts, which come in order."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for b in batches:
        for h1, h2, ids in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (h1, h2) != node:
                if node:
                    yield pa.RecordBatch.from_pylist([{"h1": node[0], "h2": node[1], "ends_sha256": state.hexdigest()}], schema=schema)
                node, state = (h1, h2), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node:
        yield pa.RecordBatch.from_pylist([{"h1": node[0], "h2": node[1], "ends_sha256": state.hexdigest()}], schema=schema)


def ends_of(members: DataFrame) -> DataFrame:
    """``h1, h2, ends_sha256`` of ``(h1, h2, conv_id)``: ids of any number of conversations that end at one node.

    Ranges of the sorted ids are packed into texts first, wherever a node's ids lie; SHA-256 itself is serial, so that one task streams a
    node's texts, of which it holds one at a time.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = members.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = spread.mapInArrow(_packed, "h1 long, h2 long, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame, cap: int = CAP, levels: int = LEVELS) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A container's nodes come whole from its sweep. For the head, each part of the trie gives its leaves and savings at the place (smallest
    member, depth) of its top; the sums of these along each member, from its end to the node, add up over the node's members.
    """
    zero = F.lit(0).cast("long")
    rows, convs = rebuild(numbered(conversations))
    a, b = _name(F.col("depth"), F.col("tid"))
    named = running(rows, ["conv_id"], ["depth"], {"h1": ("xor", a), "h2": ("xor", b)}, _keep)
    paths = _keep(named.select("conv_id", "depth", "tid", "n", *NODE, F.col("h1").bitwiseXOR(a).alias("p1"), F.col("h2").bitwiseXOR(b).alias("p2"), (F.col("len") - F.col("depth") + 1).alias("left")))
    head = burst(paths, cap, levels)
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    head = head.unionByName(root.select(zero.alias("h1"), zero.alias("h2"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("n"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")))
    in_head = join_hot(paths, _keep(head.where("depth > 0").select(*NODE, "n_convs")), NODE, "n_convs", "left")
    in_head = _keep(in_head.withColumn("in_head", F.col("n_convs").isNotNull()).drop("n_convs"))
    swept = _keep(containers(in_head.where(~F.col("in_head"))))

    tops = swept.where("top")
    below = head.select("p1", "p2").unionByName(tops.select("p1", "p2")).where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    head = _keep(head.join(below.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "n_children"), NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    null = F.lit(None).cast("long")
    given = head.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    given = given.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))).select("*", null.alias("h1"), null.alias("h2"))
    members = in_head.where("in_head").select("conv_id", "depth", *NODE, (F.col("left") == 1).alias("ends"))
    members = members.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), (F.col("len") == 0).alias("ends")))
    path = given.unionByName(members.select("conv_id", "depth", zero.alias("leaves"), zero.alias("saved"), *NODE))
    sums = running(path, ["conv_id"], [F.desc("depth"), F.asc("h1"), F.asc("h2")], {"leaves_": ("sum", F.col("leaves")), "saved_": ("sum", F.col("saved"))}, _keep)
    subtree = sums.where("h1 is not null").groupBy(*NODE).agg(F.sum("leaves_").alias("n_leaves"), F.sum("saved_").alias("saved_tokens"))

    ends = ends_of(members.where("ends").select(*NODE, "conv_id"))
    full = head.join(subtree, NODE, "left").join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    cols = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    loose = full.select(*cols, "p1", "p2").unionByName(tops.select(*cols, "p1", "p2"))
    above = _keep(head.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    hung = join_hot(loose.withColumnRenamed("n_children", "children"), above, ["p1", "p2"], "n_children", "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return hung.drop("n_children").withColumnRenamed("children", "n_children").select(out).unionByName(swept.where("not top").select(out))
