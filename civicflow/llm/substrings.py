"""Removal of repeated passages through a compacted de Bruijn graph.

A passage counts as repeated if a window of ``WINDOW`` words also starts
anywhere else.  Nodes of the graph are token k-mers, sampled by content: of all
k-mers of a window the one with the least hash (its anchor), so that equal
windows have equal anchors and every window has one.  An edge leads from an
anchor to the next one and stands for all words of both and between.

1. Anchors that occur once are dropped by a join on their counts.
2. An edge is glued to the next if neither branches: every occurrence of the
   one is followed, and every occurrence of the other preceded, by the same
   edge.  Runs of glued edges are nonbranching paths; all occurrences of a path
   hold the same words.
3. A window is settled by a path if it lies inside an occurrence of the path
   and its anchor occurs nowhere but there: then so do all its copies.  The
   other windows with a repeated anchor are compared on their own.
4. Source coordinates verify: whole paths and single windows are read from the
   text again and counted by 128-bit digests of their words; what occurs twice
   is removed.

The graph of all k-mers is not built: its repeated nonbranching paths that are
long enough for a window are those of the sampled graph.  A window's anchor is
the k-mer of least hash in it, which depends on its words alone, so every copy
of the window holds the same anchor at the same place: what repeats in the full
graph repeats in the sampled one, and what is removed is decided by comparing
the words themselves.  ``tests/llm/test_substrings.py`` compares both graphs.

Texts are written once to the shared folder, bucketed by row, so that later
passes move coordinates to the texts instead of texts.

Defined cases: null or empty texts have no words; texts shorter than a window
keep everything; repeated rows are copies like any other; null ids are kept as
they are; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import materialise, scratch_path, scratch_table, slices
from civicflow.llm.hashing import Words, mix

WINDOW, K = 35, 10
#: Text of a bucket, which is read by one task.
BUCKET_BYTES = 128 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of word ranges of some texts, by one of two polynomial hashes."""

    def __init__(self, words: Words, which: int):
        h = words.hashes(which)
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(h)
        powers = np.ones(n + 1, np.uint64)
        back = np.ones(n + 1, np.uint64)
        powers[1:], back[1:] = base, inverse
        powers, self.back = np.cumprod(powers), np.cumprod(back)
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(h * powers[:n]))

    def ranges(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of words first to last - 1."""
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


class Anchors:
    """The anchor of every window of some texts (positions count words of all texts together)."""

    def __init__(self, words: Words, rolling: Rolling, window: int, k: int):
        n = len(words.starts)
        #: the first word of every window that lies in one text
        self.windows = np.flatnonzero(words.text[:n - window + 1] == words.text[window - 1:]) if n >= window else np.zeros(0, np.int64)
        if not len(self.windows):
            self.of = self.at = self.windows
            return
        first = np.arange(n - k + 1)
        # the leftmost of the least hashes: 40 bits of hash over 24 bits of position
        low = (rolling.ranges(first, first + k) >> np.uint64(24)) << np.uint64(24) | (first & 0xFFFFFF).astype(np.uint64)
        width, left = 1, window - k + 1
        while 2 * width <= left:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if left > width:
            low = np.minimum(low[:width - left], low[left - width:])
        low = (low[self.windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        #: the anchor of each window: its position agrees with the window's up to 2 ** 24
        self.of = self.windows + ((low - self.windows) & 0xFFFFFF)
        self.at = self.of[np.append(True, self.of[1:] != self.of[:-1])]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in slices(batches):
        yield batch, Words([(t or "").encode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])


def _anchors(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _pieces(batches):
            rolling = Rolling(words, 0)
            at = Anchors(words, rolling, window, k).at
            if not len(at):
                continue
            text = words.text[at]
            following = np.append(at[1:], at[-1:])
            edge = np.append(text[1:] == text[:-1], False)
            span = Rolling(words, 1).ranges(at, following + k).view(np.int64)
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[text]), pa.array((at - words.first[text]).astype(np.int32)),
                 pa.array(np.where(edge, following - at, 0).astype(np.int32)),
                 pa.array(rolling.ranges(at, at + k).view(np.int64)), pa.array(np.where(edge, span, 0))], names=["rid", "p", "gap", "anchor", "edge"])

    return run


def _digests(window: int, k: int):
    """Per text, ``marks``: repeated anchors (kind 0) with the spans that settle their windows, and paths (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _pieces(batches):
            rollings = [Rolling(words, w) for w in (0, 1)]
            anchors = Anchors(words, rollings[0], window, k)
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2)
            of = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            kind, p, ls, le, rs, re = (marks.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            begin = words.first[of]
            # windows of repeated anchors, less those inside a settling span
            a = np.flatnonzero(kind == 0)
            a = a[np.argsort(begin[a] + p[a])]
            where = np.searchsorted(begin[a] + p[a], anchors.of)
            known = where < len(a)
            known[known] = (begin[a] + p[a])[where[known]] == anchors.of[known]
            s, mark = anchors.windows[known], a[where[known]]
            own = s - begin[mark]
            settled = (own >= ls[mark]) & (own + window <= le[mark]) | (own >= rs[mark]) & (own + window <= re[mark])
            s = s[~settled]
            out = [[r.ranges(s, s + window).view(np.int64) for r in rollings], [words.text[s], s, np.full(len(s), window)]]
            paths = np.flatnonzero((kind == 1) & (le - p >= window))
            long = [hashlib.blake2b(words.join(int(begin[i] + p[i]), int(begin[i] + le[i])), digest_size=16).digest() for i in paths]
            pair = np.frombuffer(b"".join(long), "<i8").reshape(-1, 2)
            h1, h2 = (np.concatenate([out[0][j], pair[:, j]]) for j in (0, 1))
            text = np.concatenate([out[1][0], of[paths]])
            start = np.concatenate([out[1][1], begin[paths] + p[paths]]) - words.first[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[text]), pa.array(start.astype(np.int32)),
                 pa.array(np.concatenate([out[1][2], le[paths] - p[paths]]).astype(np.int32)), pa.array(h1), pa.array(h2)],
                names=["rid", "start", "n", "h1", "h2"])

    return run


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, cover in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                n = len(words)
                if cover:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, [c["start"] for c in cover], 1)
                    np.add.at(step, [c["start"] + c["n"] for c in cover], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0)]
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:len(columns)])

    return run


def _bytes(docs: DataFrame) -> int:
    """Bytes of the columns that are read, from one pass over lengths."""
    return int(docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)


def _texts(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, bucketed by it in the shared folder."""
    spark = docs.sparkSession
    # a bucket is one task: as many as the bytes of the table ask for
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(docs) // BUCKET_BYTES))
    name = scratch_table(spark, "texts")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    (rows.repartition(buckets, "rid").write.option("path", scratch_path(spark, "texts")).option("compression", "zstd")
         .bucketBy(buckets, "rid").saveAsTable(name))
    return spark.table(name)


def _paths(marked: DataFrame, k: int) -> DataFrame:
    """Marks per text from the repeated anchors ``rid, p, gap, anchor, edge, times``."""
    order = Window.partitionBy("rid").orderBy("p")
    # an edge is kept if the next anchor is repeated, too
    edges = marked.withColumn("real", (F.col("gap") > 0) & (F.lead("p").over(order) == F.col("p") + F.col("gap")))
    real = F.coalesce("real", F.lit(False))
    linked = (edges.withColumn("real", real)
                   .withColumn("before", F.when(F.lag("real").over(order) & (F.lag("p").over(order) + F.lag("gap").over(order) == F.col("p")), F.lag("edge").over(order)))
                   .withColumn("after", F.when(F.col("real") & F.lead("real").over(order), F.lead("edge").over(order))))
    linked = materialise(linked, "edges")
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))  # noqa: E731  the same edge at every occurrence
    stats = materialise(linked.where("real").groupBy("edge").agg(
        F.count(F.lit(1)).alias("edge_times"), F.coalesce(one("before"), F.lit(False)).alias("one_before"),
        F.coalesce(one("after"), F.lit(False)).alias("one_after")).where("edge_times > 1"), "edge-counts")
    known = linked.join(stats, "edge", "left").withColumn("real", F.col("real") & F.col("edge_times").isNotNull())
    glued = (F.col("real") & F.col("one_before") & F.coalesce(F.lag("real").over(order) & F.lag("one_after").over(order)
             & (F.lag("p").over(order) + F.lag("gap").over(order) == F.col("p")), F.lit(False)))
    known = known.withColumn("path", F.sum(F.when(glued, 0).otherwise(1)).over(order))
    path = Window.partitionBy("rid", "path")
    known = (known.withColumn("from", F.min("p").over(path)).withColumn("to", F.max(F.col("p") + F.col("gap") + k).over(path)))
    # the spans of the paths on both sides that hold all occurrences of the anchor
    side = lambda c, ok: F.when(ok, F.col(c)).otherwise(0)
    right = F.col("real") & (F.col("edge_times") == F.col("times"))
    known = known.withColumn("_real", F.col("real")).withColumn("_right", right)
    touching = F.lag("p").over(order) + F.lag("gap").over(order) == F.col("p")
    left = F.coalesce(F.lag("_real").over(order) & touching & (F.lag("edge_times").over(order) == F.col("times")), F.lit(False))
    known = known.select(
        "rid", "p", "real", "path", "from", "to", F.when(left, F.lag("from").over(order)).otherwise(0).alias("ls"),
        F.when(left, F.lag("to").over(order)).otherwise(0).alias("le"), side("from", F.col("_right")).alias("rs"), side("to", F.col("_right")).alias("re"))
    mark = lambda *c: F.struct(*[x.cast("int").alias(n) for x, n in zip(c, ("kind", "p", "ls", "le", "rs", "re"))])
    zero = F.lit(0)
    marks = known.select("rid", F.explode(F.array_compact(F.array(
        mark(zero, F.col("p"), F.col("ls"), F.col("le"), F.col("rs"), F.col("re")),
        F.when(F.col("real") & (F.col("p") == F.col("from")), mark(F.lit(1), F.col("from"), F.col("from"), F.col("to"), zero, zero))))).alias("mark"))
    return marks.groupBy("rid").agg(F.collect_list("mark").alias("marks"))  # of one text


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text`` of every row."""
    texts = _texts(docs)
    anchors = materialise(texts.select("rid", "text").mapInArrow(_anchors(window, k), "rid long, p int, gap int, anchor long, edge long"), "anchors")
    repeated = materialise(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated-anchors")
    marked = materialise(anchors.join(repeated, "anchor"), "marked-anchors")
    marks = _paths(marked, k)
    found = materialise(texts.join(marks, "rid").select("rid", "text", "marks")
                             .mapInArrow(_digests(window, k), "rid long, start int, n int, h1 long, h2 long"), "digests")
    twice = materialise(found.groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "repeated")
    cover = (found.join(twice, ["h1", "h2", "n"]).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("cover")))  # of one text
    rows = texts.join(cover, "rid", "left").select("doc_id", "text", "cover")
    return rows.mapInArrow(_remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


#: The same rows by counting every window.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     win AS (SELECT rid, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS g
             FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
     twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
     gone AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(s, s + {WINDOW})) AS p FROM win SEMI JOIN twice USING (g)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT coalesce(list_contains(p, i), false)], ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
