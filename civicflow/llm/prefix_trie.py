"""Prefix trie of conversations as burst tries.

A turn becomes an id of fixed width (128 bits of a SHA-256 of role and text, and
its number of words), a conversation a string of ids.  Conversations are cut
into pieces of at most ``SEGMENT`` turns; the head of a piece is the digest of
all turns before it.  Equal pieces below one head are one suffix with a weight,
so that copies of a conversation are counted before anything is compared.

A container holds the suffixes below one head.  While a container is oversized
it is burst: its suffixes lose their common turns, or else their next turn, and
move to the container of the longer head, which becomes an edge of the trie
(each round is an aggregation and a join, so that a head with a third of all
suffixes is split like any skewed join).  The remaining containers are dealt
out by head, sorted and swept once from left to right with a stack of open
nodes.  Sums over subtrees then rise along the edges, round by round; across
pieces they need no rounds, as a conversation is the smallest member of its path
from some depth on: what the nodes of its own are worth is summed over its
pieces and added to each head that it passes.

Defined cases: rows with a null ``conv_id`` belong to no conversation; turns
come in the order of ``turn`` (null first), then of their id; null role or text
is an empty one; repeated rows are further turns; the remainder of a negative
``conv_id`` is that of SQL; an empty table gives no node; other columns are not
read.  One SHA-256 can't be split: the ids of all conversations that end at one
node pass, in blocks, through one hash state of constant size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import global_index, materialise

#: Turns of a piece; turns and suffixes of a container that is not burst.
SEGMENT, BURST_TURNS, BURST_ROWS = 256, 2048, 256
#: Conversations that share a beginning, and the turns that may be borrowed.
FAMILY, BORROWED = 20, 4
#: Characters of a turn's id: 32 of its digest, 8 of its words.
ID, WIDTH = 32, 40
#: Conversation ids of a block that is hashed at once.
IDS = 4096

_NODE = ("key string, kind int, p long, head string, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "own long, n_children long, n_leaves long, saved long, ends string, goes_on boolean")
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _digest(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, ID)


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, entry``: each turn as an id of fixed width."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    digest = _digest(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", F.concat(digest, F.lpad(F.hex(n_words(F.col("text")).cast("long")), WIDTH - ID, "0")).alias("entry"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, entry, total`` of the rebuilt conversations, and those without any turn."""
    turns = global_index(turn_ids(conversations), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("entry")], "turns")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("turns"))
    convs = materialise(convs.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % BORROWED), "convs")
    heads = turns.where(F.col("conv_id") == base).join(convs.select("conv_id", "first"), "conv_id")
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("rank") - F.col("first")).alias("pos"), "entry").where(F.col("pos") < BORROWED - 1)
    heads = materialise(heads, "heads")
    of_base = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(of_base, "base", "left").withColumn("taken", taken)
    convs = materialise(convs.withColumn("total", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.join(convs, "conv_id").where("rank - first >= h").select("conv_id", F.expr("rank - first - h + taken").alias("pos"), "entry", "total")
    borrowed = convs.where("h > 0").join(heads, "base").where("pos < h").select("conv_id", "pos", "entry", "total")
    return own.unionByName(borrowed), convs.where("total = 0").select("conv_id")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of the pieces of each conversation, which come in order."""
    last, head = None, ""
    for batch in batches:
        heads = []
        for conv, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if conv != last:
                last, head = conv, ""
            heads.append(head)
            head = hashlib.sha256((head + piece).encode()).hexdigest()[:ID]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.string())], names=["conv_id", "p", "head"])


def pieces(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """``conv_id, p, head, piece, path, total``: conversations in pieces of at most ``SEGMENT`` turns."""
    p = F.floor(F.col("pos") / SEGMENT).cast("long")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x.entry), "")
    cut = turns.groupBy("conv_id", p.alias("p"), "total").agg(whole.alias("path"))  # at most SEGMENT turns
    cut = cut.unionByName(turnless.select("conv_id", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("total"), F.lit("").alias("path")))
    cut = materialise(cut.withColumn("piece", _digest("path")), "pieces")
    heads = cut.where(F.col("total") > SEGMENT).select("conv_id", "p", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "p").mapInArrow(
        _chain, "conv_id long, p long, head string").where("p > 0")
    return cut.where("p = 0").withColumn("head", F.lit("")).unionByName(cut.where("p > 0").join(heads, ["conv_id", "p"]))


def suffixes(cut: DataFrame) -> DataFrame:
    """Equal pieces below one head with their number, smallest conversation and that of the head's node."""
    same = cut.groupBy("p", "head", "piece").agg(
        F.first("path").alias("rest"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"),
        F.max(F.col("total") > (F.col("p") + 1) * SEGMENT).alias("goes_on"))
    same = materialise(same, "suffixes")
    above = same.where("goes_on").select(_digest("head", "piece").alias("head"), F.col("owner").alias("head_owner"))
    first = same.where("p = 0").withColumn("head_owner", F.lit(None).cast("long"))
    return first.unionByName(same.where("p > 0").join(above, "head")).withColumn("key", F.col("head")).withColumn("off", F.col("p") * SEGMENT)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common turns of the least and the greatest suffix, thus of all; at least one."""
    for batch in batches:
        steps = [max(1, _common(a, b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, pa.int32())], names=["key", "step"])


def _common(a: str, b: str) -> int:
    """Number of equal turns at the beginning."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i:i + WIDTH] == b[i:i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def burst(state: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes in containers that are not oversized, and the edges of each round."""
    kept, edges = [], []
    while True:
        sizes = materialise(state.groupBy("key").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.length("rest") / WIDTH).alias("turns"), F.min("owner").alias("least")), "sizes")
        large = sizes.where((F.col("rows") > 1) & ((F.col("turns") > BURST_TURNS) | (F.col("rows") > BURST_ROWS)))
        state = state.join(sizes.select("key", "least"), "key").withColumn("head_owner", F.coalesce("head_owner", "least")).drop("least")
        if large.isEmpty():
            kept.append(state)
            break
        ends = state.join(large.select("key"), "key").groupBy("key").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        steps = materialise(ends.mapInArrow(_steps, "key string, step int"), "steps")
        state = materialise(state.join(steps, "key", "left"), "containers")
        moves = F.col("step").isNotNull() & (F.col("rest") != "")
        kept.append(state.where(~moves).drop("step"))
        moved = state.where(moves).withColumn("label", F.expr(f"substring(rest, 1, step * {WIDTH})"))
        moved = moved.withColumn("next", _digest(F.lit("burst"), "key", "label"))
        edge = moved.groupBy(F.col("key").alias("parent"), F.col("next").alias("key"), "label", "p", "head", "off", "head_owner").agg(
            F.sum("n").alias("n"), F.min("owner").alias("owner"))
        edges.append(materialise(edge, "edges"))
        state = moved.select(
            F.col("next").alias("key"), "p", "head", "piece", F.expr(f"substring(rest, step * {WIDTH} + 1)").alias("rest"), "n", "owner", "goes_on",
            F.lit(None).cast("long").alias("head_owner"), (F.col("off") + F.col("step")).alias("off"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, edges


class _Rows:
    """Node rows on their way to Arrow."""

    def __init__(self):
        self.columns: dict[str, list] = {c: [] for c in _NAMES}

    def add(self, *values) -> None:
        for column, value in zip(self.columns.values(), values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
        made = pa.RecordBatch.from_pydict({c: pa.array(self.columns[c], kinds[t]) for c, t in (x.split() for x in _NODE.split(", "))})
        self.__init__()
        return made


class _Node:
    __slots__ = ("depth", "n", "owner", "above", "words", "children", "leaves", "saved", "piece", "goes_on")

    def __init__(self, depth: int, above: _Node | None, words: int):
        self.depth, self.above, self.words = depth, above, words
        self.n, self.owner, self.children, self.leaves, self.saved, self.piece, self.goes_on = 0, None, 0, 0, 0, None, False

    def take(self, row: dict) -> None:
        """A suffix ends here; below it may lie nodes of the next piece."""
        self.n += row["n"]
        self.owner = row["owner"] if self.owner is None else min(self.owner, row["owner"])
        self.piece, self.goes_on = row["piece"], row["goes_on"]
        self.children, self.leaves, self.saved = self.children + row["more_children"], self.leaves + row["more_leaves"], self.saved + row["more_saved"]

    def close(self) -> None:
        up = self.above
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.words
        up.children, up.leaves, up.saved, up.n = up.children + 1, up.leaves + self.leaves, up.saved + self.saved, up.n + self.n
        up.owner = self.owner if up.owner is None else min(up.owner, self.owner)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers, whose suffixes come sorted; a row of kind 1 holds what a container adds to its head."""
    out = _Rows()
    key, first, last, stack, nodes = None, None, "", [], []

    def finish() -> None:
        while len(stack) > 1:
            stack.pop().close()
        head = stack[0]
        for x in nodes:
            parent = first["head_owner"] if x.above is head else x.above.owner
            out.add(key, 0, first["p"], first["head"], x.depth, x.owner, parent, x.n, (x.n - 1) * x.words, x.children, x.leaves, x.saved, x.piece, x.goes_on)
        out.add(key, 1, first["p"], first["head"], None, None, None, None, None, head.children, head.leaves, head.saved, head.piece, head.goes_on)

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    finish()
                    if len(out.columns["key"]) >= 10_000:
                        yield out.batch()
                key, first, last, nodes = row["key"], row, "", []
                stack = [_Node(row["off"], None, 0)]
            rest = row["rest"]
            common = _common(last, rest)
            while len(stack) > common + 1:
                stack.pop().close()
            for i in range(common * WIDTH, len(rest), WIDTH):
                stack.append(_Node(stack[-1].depth + 1, stack[-1], int(rest[i + ID:i + WIDTH], 16)))
                nodes.append(stack[-1])
            stack[-1].take(row)
            last = rest
    if key is not None:
        finish()
    if out.columns["key"]:
        yield out.batch()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of edges whose sums are known, and what each edge adds to the container above."""
    out = _Rows()
    for batch in batches:
        for row in batch.to_pylist():
            label, n, owner = row["label"], row["n"], row["owner"]
            children, leaves, saved = row["children"] or 0, row["leaves"] or 0, row["saved"] or 0
            leaves, piece, goes_on = leaves if children else 1, row["ends"], bool(row["goes_on"])
            for i in range(len(label) // WIDTH - 1, -1, -1):
                own = (n - 1) * int(label[i * WIDTH + ID:(i + 1) * WIDTH], 16)
                saved += own
                out.add(row["key"], 0, row["p"], row["head"], row["off"] + i + 1, owner, owner if i else row["head_owner"], n, own, children, leaves, saved, piece, goes_on)
                children, piece, goes_on = 1, None, False
            out.add(row["parent"], 1, row["p"], row["head"], None, None, None, None, None, 1, leaves, saved, None, False)
        yield out.batch()


def _nodes(containers: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """All nodes below the heads, and rows of kind 1 for the heads themselves."""
    swept = containers.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_sweep, _NODE)
    parts = [materialise(swept, "swept")]
    for edge in reversed(edges):
        known = parts[0].where("kind = 1")
        for part in parts[1:]:
            known = known.unionByName(part.where("kind = 1"))
        sums = known.join(edge.select("key"), "key", "left_semi").groupBy("key").agg(
            F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.max("ends").alias("ends"), F.max("goes_on").alias("goes_on"))
        parts.append(materialise(edge.join(sums, "key", "left").mapInArrow(_expand, _NODE), "expanded"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _below(cut: DataFrame, nodes: DataFrame) -> DataFrame:
    """``head, more_children, more_leaves, more_saved`` of the heads of later pieces.

    Every node belongs to its smallest member, whose later pieces all lie below
    the heads that it passes: sums over its own pieces from the last one on,
    added up over the members of a head, are the sums of the head's subtree.
    """
    real = nodes.where("kind = 0")
    own = real.groupBy("conv_id", "p").agg(F.sum("own").alias("saved"), F.sum(((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")).alias("leaves"))
    later = Window.partitionBy("conv_id").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    passed = cut.where("p > 0").select("conv_id", "p", "head").join(own, ["conv_id", "p"], "left")
    passed = passed.select("head", F.sum(F.coalesce("saved", F.lit(0))).over(later).alias("saved"), F.sum(F.coalesce("leaves", F.lit(0))).over(later).alias("leaves"))
    sums = passed.groupBy("head").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    children = real.where(F.col("depth") == F.col("p") * SEGMENT + 1).groupBy("head").agg(F.count(F.lit(1)).alias("more_children"))
    return sums.join(children, "head")


def _blocks(size: int):
    """Sorted ids of a node in blocks of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key or len(ids) == size:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = row[:2], []
                ids.append(row[2])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["head", "ends", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_pydict({"head": [key[0]], "ends": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    return run


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each node, which come in order."""
    key, state, out = None, None, []
    for batch in batches:
        for head, ends, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (head, ends) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (head, ends), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["head", "ends", "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"head": [key[0]], "ends": [key[1]], "ends_sha256": [state.hexdigest()]})


def _ends(cut: DataFrame) -> DataFrame:
    """``head, ends, ends_sha256``: the conversations that end with a piece."""
    last = cut.where(F.col("total") <= (F.col("p") + 1) * SEGMENT).select("head", F.col("piece").alias("ends"), "conv_id")
    order = ["head", "ends", "conv_id"]
    blocks = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(IDS), "head string, ends string, first long, ids string")
    return blocks.repartition("head", "ends").sortWithinPartitions("head", "ends", "first").mapInArrow(_hash, "head string, ends string, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    cut = pieces(*rebuilt(conversations))
    # the pieces with their heads are read again and again
    cut = materialise(cut, "heads-of-pieces")
    containers, edges = burst(suffixes(cut))
    containers = materialise(containers, "burst")
    none = [F.lit(0).cast("long").alias(c) for c in ("more_children", "more_leaves", "more_saved")]
    later = containers.where("p > 0").select("*", *none)
    first = _nodes(later, [e.where("p > 0") for e in edges]) if not later.isEmpty() else None
    if first is None:
        paid = containers.select("*", *none)
    else:
        below = materialise(_below(cut, first), "below").withColumnRenamed("head", "below")
        goes_on = containers.where("goes_on").withColumn("below", _digest("head", "piece")).join(below, "below", "left").drop("below")
        paid = containers.where("not goes_on").select("*", *none).unionByName(goes_on.fillna(0, ["more_children", "more_leaves", "more_saved"]))
    nodes = _nodes(paid, edges)
    least, everyone = cut.where("p = 0").agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root = nodes.where("kind = 1 and key = ''").agg(
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    root = root.where(F.lit(everyone > 0)).select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(everyone).cast("long").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved"), F.lit("").alias("head"), "ends")
    every = nodes.where("kind = 0").select(*root.columns).unionByName(root)
    hashed = every.where("ends is not null").join(_ends(cut), ["head", "ends"], "left")
    every = hashed.unionByName(every.where("ends is null").withColumn("ends_sha256", F.lit(None).cast("string")))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same nodes from lists of turns: every prefix of every conversation, and sums over all ancestors.
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(length(role), 0) || ':' || coalesce(role, '') || coalesce(text, '') AS body,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(coalesce(length(role), 0) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {ID})) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, CAST(conv_id AS VARCHAR) AS s FROM t),
     bits AS (SELECT conv_id, base, list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(substr(s, i, 1)) AS BIGINT) FOR i IN range(1, length(s) + 1)],
                lambda a, b: list_reduce([xor(a, b)] || [CAST(k AS BIGINT) FOR k IN range(8)],
                  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)) AS x FROM c),
     h AS (SELECT conv_id, base, xor(x, CAST(4294967295 AS BIGINT)) % {BORROWED} AS h FROM bits),
     seq AS (SELECT h.conv_id, b.body, b.words, b.pos FROM h JOIN t b ON b.conv_id = h.base AND b.pos < h.h
             UNION ALL SELECT h.conv_id, t.body, t.words, t.pos FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos >= h.h),
     lists AS (SELECT h.conv_id, coalesce(list(seq.body ORDER BY seq.pos) FILTER (seq.pos IS NOT NULL), []) AS l,
                      coalesce(list(seq.words ORDER BY seq.pos) FILTER (seq.pos IS NOT NULL), []) AS w FROM h LEFT JOIN seq ON seq.conv_id = h.conv_id GROUP BY h.conv_id),
     pre AS (SELECT conv_id, len(l) AS total, unnest(range(0, len(l) + 1)) AS depth, l, w FROM lists),
     node AS (SELECT l[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n, max(CASE WHEN depth = 0 THEN 0 ELSE w[depth] END) AS words,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
              FROM pre GROUP BY ALL),
     kids AS (SELECT path[1:depth - 1] AS path, count(*) AS k FROM node WHERE depth > 0 GROUP BY ALL),
     full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON kids.path = node.path),
     up AS (SELECT path[1:d] AS path, sum((n - 1) * words) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves
            FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves,
       CAST(up.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN up ON up.path = f.path LEFT JOIN node p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]
"""
