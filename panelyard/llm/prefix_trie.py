"""Prefix trie of conversations: what shared openings would save if computed once.

A conversation is the sequence of its turns, a turn a digest of (role, text) and the number of
its words. Sequences are sorted by range (ties by conversation), so that a node's members lie side
by side, a popular sequence may spread over many partitions, and the depth two neighbours
share is known where they meet. Within a partition the edges between neighbours are united in
descending depth: a merge of two components at a depth makes the branching node there. Nodes on the
paths to a partition's first and last sequence may go on next door: what hangs below them is
contracted into them, and the partitions' paths, at most two each, are merged by node, then summed
towards the root. All other nodes are complete where they are.

Defined results: rows without a conversation are left out; a null role or text is empty; turns
are ordered by ``turn``, null first, equal ones by their digest; repeated rows are further turns; a
conversation's turns (28 bytes each, not their texts) must fit in a task, its number of
members need not; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import ship
from panelyard.sources.store import attach, materialise

DIGEST = 32              # figures of a turn's digest
PER_PARTITION = 100_000  # conversations of a partition, about
IDS = 20_000             # members in one piece of a list that goes on next door
WORD = "[^\\x20\\x09-\\x0D]+"
OUT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
       "n_leaves long, saved_tokens long, ends_sha256 string")
FIELDS = ("kind", "key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
          "n_leaves", "saved_tokens", "words", "ends_sha256", "part", "piece", "ids")
SCHEMA = ("kind string, key string, parent_key string, depth long, conv_id long, "
          "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "words long, ends_sha256 string, part int, piece int, ids string")


# ------------------------------------------------------------------ sequences
def sequences(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, turns as (turn, digest, words) in order."""
    said = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    turn = F.struct("turn", F.substring(F.sha2(both, 256), 1, DIGEST).alias("digest"),
                    F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return said.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t")).groupBy(
        "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def borrowed_heads(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns replaced by those of its block's first one.

    Conversation c takes crc32(c) mod ``most`` turns of conversation c - c mod ``every``.
    """
    c = F.col("conv_id")
    seqs = materialise(seqs, "sequences")
    donors = seqs.where(c % every == 0).select(
        c.alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    own = seqs.withColumns({"donor": c - c % every,
                            "h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int")})
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(donors, "donor", "left").select("conv_id", F.concat(head, rest).alias("turns"))


# --------------------------------------------------------- one partition's forest
def shared_depth(a: str, b: str) -> int:
    """Turns that two keys open with together."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:                       # most neighbours differ early or late
        mid = (low + high + 1) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def forest(depths: list[int], shared: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Compressed tree over sorted distinct sequences: (depth, parent, any sequence below).

    Nodes 0..n-1 are the ends of the sequences; ``shared[i]`` is the depth that i and i + 1 share.
    Edges are united in descending depth. The root, of depth 0, has no parent (-1).
    """
    n = len(depths)
    depth, parent, sample = list(depths), [-1] * n, list(range(n))
    leader, top = list(range(n)), list(range(n))        # union-find; a component's highest node

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for i in sorted(range(n - 1), key=lambda i: -shared[i]):
        a, b, at = find(i), find(i + 1), shared[i]
        if depth[top[a]] != at:                          # a branching node where they part
            depth.append(at)
            parent.append(-1)
            sample.append(i)
            parent[top[a]] = len(depth) - 1
            top[a] = len(depth) - 1
        parent[top[b]] = top[a]
        leader[b] = a
    if n and depth[top[find(0)]] != 0:
        depth.append(0)
        parent.append(-1)
        sample.append(0)
        parent[top[find(0)]] = len(depth) - 1
    return depth, parent, sample


def _chain(key: str, upto: int) -> list[str]:
    """A name for each opening of a sequence, from the root on."""
    names = [""]
    for d in range(upto):
        names.append(hashlib.sha256((names[-1] + key[d * DIGEST:(d + 1) * DIGEST]).encode())
                     .hexdigest()[:DIGEST])
    return names


def _runs(batches):
    """(key, words, first member, members, digest of members, pieces) of a sorted partition."""
    key, words, held, n, low, seal, pieces = None, None, [], 0, None, None, []

    def flush():
        text = ",".join(held)
        seal.update((("," if pieces else "") + text).encode())
        pieces.append(text)
        held.clear()

    for b in batches:
        for k, w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if k != key:
                if key is not None:
                    flush()
                    yield key, words, low, n, seal.hexdigest(), pieces
                key, words, n, low, seal, pieces = k, w, 0, c, hashlib.sha256(), []
            held.append(str(c))
            n += 1
            if len(held) == IDS:
                flush()
    if key is not None:
        if held or not pieces:
            flush()
        yield key, words, low, n, seal.hexdigest(), pieces


NOTHING = hashlib.sha256(b"").hexdigest()


def _partition(batches):
    """Complete nodes ('done'), contracted nodes of both border paths ('open'), their members ('ids', 'seal')."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    keys, words, lows, sizes, seals, edge = [], [], [], [], [], {}
    for key, w, low, n, seal, pieces in _runs(batches):
        if len(keys) > 1:
            edge.pop(len(keys) - 1, None)                # not the last one after all
        edge[len(keys)] = pieces
        keys.append(key), words.append(w), lows.append(low), sizes.append(n), seals.append(seal)
    if not keys:
        return
    last = len(keys) - 1
    depths = [len(k) // DIGEST for k in keys]
    depth, parent, sample = forest(
        depths, [shared_depth(keys[i], keys[i + 1]) for i in range(last)])
    nodes = len(depth)
    count, low = sizes + [0] * (nodes - last - 1), lows + [None] * (nodes - last - 1)
    kids, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    # How deep a node lies on the way to the first and to the last sequence, if it does.
    border = [False] * nodes
    for end in {0, last}:
        while end >= 0 and not border[end]:
            border[end] = True
            end = parent[end]
    order = sorted(range(nodes), key=lambda v: -depth[v])
    first_name, last_name = _chain(keys[0], depths[0]), _chain(keys[last], depths[last])
    on_first = [False] * nodes
    v = 0
    while v >= 0:
        on_first[v] = True
        v = parent[v]
    for v in order:                                       # children before parents
        p = parent[v]
        if p >= 0:
            count[p] += count[v]
            low[p] = low[v] if low[p] is None else min(low[p], low[v])
    rows = []

    def flushed():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, TYPES)], names=list(FIELDS))

    for v in order:
        p, n = parent[v], count[v]
        top, w = (depth[p] if p >= 0 else -1), words[sample[v]]
        names = (first_name if on_first[v] else last_name) if border[v] else None
        ends = seals[v] if v <= last else NOTHING
        if border[v]:
            below, under, lost = kids[v], leaves[v], saved[v]
            for d in range(depth[v], top, -1):
                rows.append(("open", names[d], names[d - 1] if d else None, d, low[v], None, n, below,
                             under, lost, w[d - 1] if d else 0, None, part, None, None))
                below, under, lost = 0, 0, 0              # what is deeper is in an open node of its own
            if v <= last and v not in edge:                # its members are all here
                rows.append(("seal", names[depth[v]], None, None, None, None, None, None, None, None,
                             None, ends, part, None, None))
            elif v <= last:
                rows += [("ids", names[depth[v]], None, None, None, None, None, None, None, None, None,
                          None, part, i, text) for i, text in enumerate(edge[v])]
        else:
            under = max(leaves[v], 1 if kids[v] == 0 else 0)
            below, total = kids[v], saved[v]
            at_border = border[p]
            name = ((first_name if on_first[p] else last_name)[top] if at_border else None)
            for d in range(depth[v], top, -1):
                total += (n - 1) * w[d - 1]
                tops = d == top + 1
                rows.append(("done", None, name if tops else None, d, low[v],
                             (None if at_border else low[p]) if tops else low[v], n, below, under,
                             total, None, ends, None, None, None))
                below, ends = 1, NOTHING
            kids[p] += 1
            leaves[p] += under
            saved[p] += total
        if border[v] and p >= 0 and not border[p]:
            raise AssertionError("a border path leaves the border")
        if len(rows) > 5_000:
            yield flushed()
    if rows:
        yield flushed()


TYPES = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.int32(),
         pa.int32(), pa.string())


# ------------------------------------------------------------ across partitions
def _seals(batches):
    """(key, digest of members) of pieces sorted by key, partition and piece."""
    key, seal, some = None, None, False
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    yield _row(key, seal)
                key, seal, some = k, hashlib.sha256(), False
            seal.update((("," if some else "") + text).encode())
            some = True
    if key is not None:
        yield _row(key, seal)


def _row(key, seal):
    return pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [seal.hexdigest()]})


def _summed(batches):
    """Contracted nodes summed towards the root."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    by = {r["key"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        if r["n_children"] == 0:
            r["n_leaves"] = 1
        if r["depth"]:
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            up = by[r["parent_key"]]
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = up["conv_id"]
        else:
            r["parent_conv_id"] = None
    names = ("key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens")
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], pa.string() if c == "key" else pa.int64()) for c in names],
        names=list(names))


def prefix_trie(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per distinct opening of the sequences (see :func:`sequences`).

    conv_id is the smallest member, parent_conv_id the parent's; n_leaves and saved_tokens cover the
    whole subtree; ends_sha256 is of the members that end there, in order, comma-joined.
    """
    spark = seqs.sparkSession
    ship(spark)
    keyed = materialise(seqs.select(
        F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id"), "trie-sequences")
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                         -(-keyed.count() // PER_PARTITION))
    parts = keyed.repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = materialise(parts.mapInArrow(_partition, SCHEMA), "trie")
    merged = made.where("kind = 'open'").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.first("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # Two paths a partition: their number follows the partitions, not the rows.
    paths = materialise(merged.coalesce(1).mapInArrow(
        _summed, "key string, depth long, conv_id long, parent_conv_id long, n_convs long, "
                 "n_children long, n_leaves long, saved_tokens long"), "trie-paths")
    ends = (made.where("kind = 'ids'").select("key", "ids", "part", "piece").repartition("key")
            .sortWithinPartitions("key", "part", "piece").select("key", "ids")
            .mapInArrow(_seals, "key string, ends_sha256 string")
            .unionByName(made.where("kind = 'seal'").select("key", "ends_sha256")))
    names = [c.split()[0] for c in OUT.split(", ")]
    opened = paths.join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    tops = paths.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    done = attach(made.where("kind = 'done'"), tops, ["parent_key"], paths.count()).withColumn(
        "parent_conv_id", F.coalesce("_above", "parent_conv_id"))
    return done.select(*names).unionByName(opened.select(*names))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of conversations that borrow their openings."""
    return prefix_trie(borrowed_heads(sequences(df)))
