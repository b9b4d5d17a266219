"""The prefix trie of all conversations by distributed radix partitioning and multikey quicksort.

Turns are dictionary-encoded: equal turns (role and text) have one number, and the trie is
built of numbers. A conversation is cut into windows of `width` turns, so that no row grows
with its length, and round r looks at the r-th window of those that have one:

- windows that are equal below the same node are one row, with the number and the least id of
  their conversations; this is counted before and after the shuffle, so copies of any number
  are few rows. The ids that end there are hashed in order, block by block;
- most significant digit first, the windows below a node are partitioned by their next turn.
  A bucket of over `local` windows is a node of its own, and is partitioned again by the turn
  after it; all others are local, and are dealt to tasks;
- a task finishes its buckets by multikey quicksort: windows are split by one turn into less,
  equal and greater, and each group of equal ones is a node, emitted before the next turn.

What counts in subtrees comes back the other way: tasks return what their buckets add to the
nodes above, the passes add it up level by level, and a round hands it to the windows of the
round before it. A node is known by its depth and the smallest of its conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import hot_keys, join_facts, materialize, read, tidy
from joulewright.operators.windows import numbered

#: Every how many ids one conversation lends its first turns to the others, and the most turns that it lends.
FAMILY, LENT = 20, 3
#: Ids of a block (2 ** ID_BITS) whose part of a list of ids is made in one row; turns of a block that are numbered together.
ID_BITS, TURNS = 16, 4096
NOTHING = hashlib.sha256(b"").hexdigest()
FOUND = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, sums boolean"


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, in order of turn, null first, then of the turn's digest), turn_id, words; equal turns share a turn_id."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    rows = materialize(turns, "turns")
    distinct = rows.groupBy("digest").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    dictionary = materialize(distinct.withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    hot = hot_keys(dictionary, ["digest"], F.col("n"), rows.count())
    encoded = join_facts(rows.drop("words"), dictionary.drop("n"), ["digest"], hot)
    block = F.expr(f"turn div {TURNS} - if(turn % {TURNS} < 0, 1, 0)")
    return numbered(encoded, F.col("conv_id"), block, ("turn", "digest"), "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "turn_id", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length), (conv_id, pos, turn_id, words): each conversation after the first h turns of its family's first one took the place of its own.

    h is the unsigned CRC-32 of the decimal conv_id modulo LENT + 1; the family's first
    conversation is conv_id - conv_id % FAMILY, if there is one.
    """
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= LENT)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LENT + 1)).cast("int")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    plan = materialize(own.join(heads, "base", "left").select("conv_id", "own", "h", F.slice("head", F.lit(1), F.col("h")).alias("head")), "heads")
    lent = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    kept = turns.join(plan.select("conv_id", "h", lent.alias("lent")), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_id", "words")
    borrowed = plan.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.pos", "x.turn_id", "x.words")
    lengths = plan.select("conv_id", (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return lengths, kept.unionByName(borrowed)


def merge_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows in order of (top, turns, block), one row each of a window: the ids that end there go through the hash block by block."""
    now = digest = None
    for b in batches:
        out = []
        for top, turns, words, n, least, ids in zip(b["top"], b["turns"], b["words"], b["n"], b["least"], b["ids"]):
            key = (top, tuple(turns))
            if now is None or now[0] != key:
                if now is not None:
                    out.append((*now[1:], digest and digest.hexdigest()))
                now, digest = [key, top, turns, words, 0, least], None
            now[4] += n
            now[5] = min(now[5], least)
            if ids:
                if digest is None:
                    digest = hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["top", "turns", "words", "n", "least", "ends"])
    if now is not None:
        yield pd.DataFrame([(*now[1:], digest and digest.hexdigest())], columns=["top", "turns", "words", "n", "least", "ends"])


def distinct_windows(rows: DataFrame) -> DataFrame:
    """top, turns, words, n, least (conv_id), ends (hash of the ids that end there, null: none) of conv_id, top, turns, words, ended."""
    ids = F.sort_array(F.collect_list(F.when(F.col("ended"), F.col("conv_id"))))
    pieces = rows.groupBy("top", "turns", F.expr(f"shiftright(conv_id, {ID_BITS})").alias("block")).agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("ids")
    )
    dealt = pieces.repartition("top", "turns").sortWithinPartitions("top", "turns", "block")
    return dealt.mapInPandas(merge_pieces, "top long, turns array<long>, words array<int>, n long, least long, ends string")


def quicksort(turns: list, words: list, n: list, least: list, at: int) -> tuple[list[list], list[int]]:
    """Nodes [parent, depth below the start, n, least, words of the turn] (parent -1: the start), and each window's node.

    Multikey quicksort of windows that agree in their first `at` turns; a parent comes before its children.
    """
    nodes: list[list] = []
    ends = [-1] * len(turns)
    todo = [(list(range(len(turns))), at, -1)]
    while todo:
        rows, j, parent = todo.pop()
        rest = []
        for r in rows:
            if len(turns[r]) == j:
                ends[r] = parent
            else:
                rest.append(r)
        if len(rest) == 1:
            r = rest[0]
            for k in range(j, len(turns[r])):
                nodes.append([parent, k + 1 - at, n[r], least[r], words[r][k]])
                parent = len(nodes) - 1
            ends[r] = parent
        elif rest:
            some = sorted((turns[rest[0]][j], turns[rest[len(rest) // 2]][j], turns[rest[-1]][j]))
            pivot = some[1]
            same = [r for r in rest if turns[r][j] == pivot]
            for part in ([r for r in rest if turns[r][j] < pivot], [r for r in rest if turns[r][j] > pivot]):
                if part:
                    todo.append((part, j, parent))
            nodes.append([parent, j + 1 - at, sum(n[r] for r in same), min(least[r] for r in same), words[same[0]][j]])
            todo.append((same, j + 1, len(nodes) - 1))
    return nodes, ends


def finish(g: pd.DataFrame) -> pd.DataFrame:
    """FOUND of a task's buckets: the nodes below each top, and one row (sums) of what they add to the top."""
    out = []
    for (top, at, depth), rows in g.groupby(["top", "at", "depth"]):
        n, least = rows["n"].tolist(), rows["least"].tolist()
        nodes, ends = quicksort([x.tolist() for x in rows["turns"]], rows["words"].tolist(), n, least, at)
        # children, leaves, saved, ends of each node; the last is the top
        sums = [[0, 0, 0, None] for _ in range(len(nodes) + 1)]
        for node, children, leaves, saved, end in zip(ends, rows["children"], rows["leaves"], rows["saved"], rows["ends"]):
            s = sums[node]
            s[0] += children
            s[1] += leaves
            s[2] += saved
            s[3] = end or s[3]
        for k in range(len(nodes) - 1, -1, -1):
            parent, below, count, first, w = nodes[k]
            children, leaves, saved, end = sums[k]
            leaves, saved = leaves if children else 1, saved + (count - 1) * int(w)
            out.append((first, depth + below, nodes[parent][3] if parent >= 0 else top, count, children, leaves, saved, end or NOTHING, False))
            s = sums[parent]
            s[0] += 1
            s[1] += leaves
            s[2] += saved
        out.append((top, depth, None, None, *sums[-1], True))
    return pd.DataFrame(out, columns=[f.split()[0] for f in FOUND.split(", ")]).astype({"parent_conv_id": "Int64", "n_convs": "Int64"})


SUMS = ["n_children", "n_leaves", "saved_tokens"]


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("ends_sha256").alias("ends_sha256"))


def solve(windows: DataFrame, depth: int, local: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the tops of windows (all at one depth), and SUMS and ends_sha256 of each top (conv_id)."""
    left, parts, large = windows, [], []
    for p in range(1 << 30):
        turn = F.get("turns", F.lit(p))
        split = left.withColumn("turn", turn)
        buckets = split.where("turn IS NOT NULL").groupBy("top", "turn").agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("child"), F.sum("n").alias("n_convs"), F.first(F.get("words", F.lit(p))).alias("w"))
        big = materialize(buckets.where(F.col("c") > local).drop("c"), "buckets")
        parts_of = lambda df: df.withColumn("at", F.lit(p)).withColumn("depth", F.lit(depth + p).cast("long"))
        if big.isEmpty():
            parts.append(parts_of(split))
            break
        both = materialize(split.join(big.select("top", "turn", "child"), ["top", "turn"], "left"), "passed")
        parts.append(parts_of(both.where("child IS NULL").drop("child")))
        left = both.where("child IS NOT NULL").withColumn("top", F.col("child")).drop("child", "turn")
        large.append(big)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    turns = windows.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("top", "at", "turn"), F.lit(shards))).drop("turn")
    found = materialize(dealt.groupBy("shard").applyInPandas(finish, FOUND), "nodes")
    nodes = found.where("NOT sums").drop("sums")
    # back through the passes: what lies below a large bucket is known once all deeper ones are
    known = added(found.where(F.col("sums") & (F.col("depth") == depth + len(large))))
    for p in reversed(range(len(large))):
        below = large[p].join(known, F.col("child") == F.col("conv_id")).select(
            "conv_id", F.lit(depth + p + 1).cast("long").alias("depth"), F.col("top").alias("parent_conv_id"), "n_convs", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
        below = materialize(below, "large")
        nodes = nodes.unionByName(below)
        up = below.select(F.col("parent_conv_id").alias("conv_id"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
        here = found.where(F.col("sums") & (F.col("depth") == depth + p)).select("conv_id", *SUMS, "ends_sha256")
        known = added(here.unionByName(up))
    return nodes, materialize(known, "sums")


@tidy
def prefix_trie(lengths: DataFrame, turns: DataFrame, width: int = 256, local: int = 4096, shard: int = 500_000) -> DataFrame:
    """The nodes of the trie of conversations: lengths (conv_id, length), turns (conv_id, pos from 1, turn_id, words).

    One row per distinct sequence of first d turns, from the root (d = 0): conv_id (the
    smallest member), depth, parent_conv_id (null: root), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree: words of a
    node's last turn times its members but one), ends_sha256 (of the decimal ids, ascending,
    comma-joined, of the members that have no further turn). Of no conversation there is no
    root. width, local (windows of a bucket that one task sorts) and shard (turns of a task)
    bound memory and change no result.
    """
    first, most = lengths.agg(F.min("conv_id"), F.max("length")).first()
    in_windows = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {width}").alias("round")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("t"))
    windows = materialize(in_windows.select("conv_id", "round", F.col("t.turn_id").alias("turns"), F.col("t.words").alias("words")), "windows")
    nobody = F.expr("cast(array() AS array<long>)"), F.expr("cast(array() AS array<int>)")
    active = lengths.withColumn("top", F.lit(first).cast("long"))
    rounds = []
    for r in range(max(1, -(-(most or 0) // width))):
        rows = active.join(windows.where(F.col("round") == r), "conv_id", "left").select(
            "conv_id", "length", "top", F.coalesce("turns", nobody[0]).alias("turns"), F.coalesce("words", nobody[1]).alias("words"), (F.col("length") <= (r + 1) * width).alias("ended")
        )
        rows = materialize(rows, "round")
        groups = materialize(distinct_windows(rows), "distinct")
        rounds.append(groups)
        on = rows.where("NOT ended").select("conv_id", "length", "top", "turns")
        hot = hot_keys(groups, ["top", "turns"], F.col("n"), rows.count())
        active = join_facts(on, groups.select("top", "turns", "least"), ["top", "turns"], hot).select("conv_id", "length", F.col("least").alias("top"))
    nodes = sums = None
    for r in reversed(range(len(rounds))):
        deeper = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
        w = rounds[r]
        if sums is None:
            w = w.select("*", *deeper)
        else:
            w = w.join(sums.select(F.col("conv_id").alias("least"), *SUMS), "least", "left").select(*rounds[r].columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(x) for c, x in zip(SUMS, ("children", "leaves", "saved"))])
        more, sums = solve(w, r * width, local, shard)
        nodes = more if nodes is None else nodes.unionByName(more)
    root = sums.crossJoin(F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n_convs")))).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return nodes.select(root.columns).unionByName(root)


@tidy
def conversation_trie(conversations: DataFrame, **sizes) -> DataFrame:
    """prefix_trie() of rebuilt conversations (conv_id, turn, role, text).

    Turns are ordered by turn (null first); ties by the SHA-256 of role and text, so repeated
    rows are repeated turns. Null roles and texts are empty. Rows without a conv_id belong to
    no conversation. See rebuild() for what a conversation takes from another; one may be
    left without turns and is a member of the root. Other columns are not read; a text of any
    length leaves as its digest in the first pass; an empty table gives no rows.
    """
    lengths, turns = rebuild(materialize(encode_turns(conversations), "encoded"))
    return prefix_trie(materialize(lengths, "lengths"), turns, **sizes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), k),
s AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT c.conv_id, role, text, pos, 0 AS own FROM c JOIN o ON o.conv_id = base AND pos <= h
        UNION ALL SELECT c.conv_id, role, text, pos, 1 FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h)),
p AS (
  SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    count(*) OVER (PARTITION BY conv_id) AS len FROM s),
m AS (
  SELECT conv_id, depth, depth = len AS ended, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    min(conv_id) OVER (PARTITION BY depth, path) AS top FROM p
  UNION ALL
  SELECT conv_id, 0, conv_id NOT IN (SELECT conv_id FROM s), 0, min(conv_id) OVER () FROM c),
n AS (
  SELECT top, depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM m GROUP BY top, depth),
u AS (
  SELECT n.*, q.top AS parent_conv_id, (SELECT count(*) FROM m AS x, n AS y
      WHERE x.top = n.top AND x.depth = n.depth AND y.top = x.conv_id AND y.depth = n.depth + 1) AS n_children
  FROM n LEFT JOIN m AS q ON q.conv_id = n.top AND q.depth = n.depth - 1)
SELECT a.top AS conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256,
  count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
FROM u AS a JOIN m ON m.top = a.top AND m.depth = a.depth JOIN u AS b ON b.top = m.conv_id AND b.depth >= a.depth
GROUP BY ALL
"""
