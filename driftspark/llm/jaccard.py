"""Exact Jaccard join of word shingles by adaptive multi-match prefixes.

A document is the set of its distinct SHINGLE-word shingles (A-Z lower-cased),
as 64-bit hashes. Two documents are linked where they share LINK percent of
the union of their sets; documents of a connected group get its least id.

Equal sets are one node. Of a node's n shingles the n - ceil(SCREEN % n) + 1
of least hash are looked at; two linked nodes share at least g = ceil((LINK -
SCREEN) % n) of these, n being the size of either. Their frequencies over all
nodes are counted, those of one node only can lead nowhere, and the others are
ordered by frequency. A prefix leaves out the g - m most frequent of the
looked-at shingles: two linked nodes share at least m of the prefixes of m
matches, so the smaller m of two nodes that choose their own. Every node takes
the m of least estimated cost: the lists its prefix reads, and the candidates
left, of which there are at most as many as list entries over m.

Shingles with at most BUCKET prefixes give their pairs, which are counted and
kept where they match often enough. Longer lists link their nodes to one node
each and stay whole. Connected candidates are a cluster; the shingle sets of
its nodes meet, each once, and the exact overlaps are taken through an index
of the shingles inside a task, which returns a spanning forest of the links,
never pairs. A cluster of more than BLOCK shingles is cut: its most central
node is compared with all, and blocks of the nodes not linked to it are
compared with blocks of all others, so no task holds more than two blocks.

Null, empty and blank texts have an empty set and are linked with nothing:
their component is their own id. Shorter texts are one shingle. Repeated rows
share a node. Null ids get the component of their group; a group of null ids
only has a null component. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, drop_table, table, without, write_table
from driftspark.llm.components import components

SHINGLE = 5
LINK = 80  # percent of the union
SCREEN = 65
MATCHES = 16  # most that a prefix may ask for
VERIFY = 20  # cost of a candidate, in list entries
BUCKET = 128
BLOCK = 1 << 18  # shingles of a block of nodes
PAIRS = 1 << 18  # of short lists that are in memory at a time
LONG = T.LongType()
ENDS = T.StructType([T.StructField("u", LONG), T.StructField("v", LONG)])


def share(percent: int, n: int) -> int:
    """percent of n, rounded up."""
    return -(-percent * n // 100)


def shingles(text: str | None, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: lowers A-Z, splits at the six spaces
    if not words:
        return np.zeros(0, np.int64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(size, len(words))
    found = np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends[k - 1:])), np.uint64, len(words) - k + 1)
    return np.unique(found.view(np.int64))


def described(size: int):
    """Per text: number of shingles, digest of the set and, where a task meets
    the set first, the shingles that are looked at."""
    seen: set[bytes] = set()

    def run(texts):
        from xxhash import xxh3_128_digest

        out: list[list] = [[], [], []]
        for text in texts:
            s = shingles(text, size)
            n = len(s)
            digest = xxh3_128_digest(s.tobytes()) if n else None
            first = n > 0 and digest not in seen
            if first:
                seen.add(digest)
            for made, v in zip(out, (n, digest, s[:n - share(SCREEN, n) + 1].tobytes() if first else None)):
                made.append(v)
        return out

    return run


def exploded(nodes: DataFrame) -> DataFrame:
    """(token, node, n) of the looked-at shingles."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = [b.as_py() for b in part.column(2)]
                times = [len(b) // 8 for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(blobs), np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(), times)) for i in (0, 1))],
                    names=["token", "node", "n"])

    schema = T.StructType([T.StructField(c, LONG) for c in ("token", "node", "n")])
    return nodes.select("node", "n", "looked").mapInArrow(run, schema)


def prefix(n: int, tokens, counts):
    """(shingles of the cheapest prefix, matches it asks for) of a node of n
    shingles, of which ``tokens`` are looked at and in ``counts`` > 1 nodes;
    no shingles where it has no candidate."""
    import numpy as np

    g = share(LINK - SCREEN, n)
    left = len(tokens) - (g - 1)  # of a prefix of one match; shingles of one node come first
    if left < 1:
        return tokens[:0], 0
    order = np.lexsort((tokens, counts))
    read = np.cumsum(counts[order] - 1)
    m = np.arange(1, min(MATCHES, g) + 1)
    entries = read[left + m - 2]
    best = int((entries * (1 + VERIFY / m)).argmin()) + 1
    return tokens[order][:left + best - 1], best


def prefixes(shared: DataFrame) -> DataFrame:
    """(token, node, n, matches, central) from (node, n, found: shared
    looked-at shingles with their counts)."""
    import pyarrow as pa

    names = ["token", "node", "n", "matches", "central"]

    def run(batches):
        import numpy as np

        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for node, n, found in zip(*(batch.column(i) for i in range(3))):
                c, t = (found.values.field(i).to_numpy() for i in (0, 1))
                got, m = prefix(n.as_py(), t, c)
                made[0].append(got)
                for to, v in zip(made[1:], (node.as_py(), n.as_py(), m, int(c.sum()) // n.as_py())):
                    to.append(np.full(len(got), v, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in made], names=names)

    return shared.select("node", "n", "found").mapInArrow(run, T.StructType([T.StructField(c, LONG) for c in names]))


def list_pairs(lists: DataFrame) -> DataFrame:
    """(u, v, need) of every two nodes of a short list whose sizes may link."""
    import pyarrow as pa

    def batch_of(made):
        import numpy as np

        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in made], names=["u", "v", "need"])

    def run(batches):
        import numpy as np

        for batch in batches:
            nodes = batch.column(0)
            starts = nodes.offsets.to_numpy()
            node, n, m = (nodes.values.field(i).to_numpy() for i in range(3))
            made: list[list] = [[], [], []]
            lengths = np.diff(starts)
            for length in np.unique(lengths):  # lists of one length at once
                first = starts[:-1][lengths == length]
                i, j = np.triu_indices(length, 1)
                step = max(1, PAIRS // max(len(i), 1))
                for at in range(0, len(first), step):
                    a, b = ((first[at:at + step, None] + k).ravel() for k in (i, j))
                    fit = 100 * np.minimum(n[a], n[b]) >= LINK * np.maximum(n[a], n[b])
                    a, b = a[fit], b[fit]
                    for to, x in zip(made, (np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), np.minimum(m[a], m[b]))):
                        to.append(x)
                    if sum(map(len, made[0])) > PAIRS:
                        yield batch_of(made)
                        made = [[], [], []]
            yield batch_of(made)

    return lists.select("nodes").mapInArrow(run, T.StructType([*ENDS.fields, T.StructField("need", LONG)]))


class Index:
    """The shingles of some nodes, to find those linked with another set."""

    def __init__(self, sets: list):
        import numpy as np

        self.sizes = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.token, starts = np.unique(token[order], return_index=True)
        self.owner, self.starts = owner[order], np.append(starts, len(token))

    def linked(self, s):
        """Numbers of the nodes linked with the set ``s``."""
        import numpy as np

        at = np.searchsorted(self.token, s)
        at = at[(at < len(self.token)) & (self.token[np.minimum(at, len(self.token) - 1)] == s)] if len(self.token) else at[:0]
        if not len(at):
            return at
        owners = np.concatenate([self.owner[self.starts[k]:self.starts[k + 1]] for k in at])
        both = np.bincount(owners, minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= LINK * (self.sizes + len(s) - both))


def forest(nodes: list[int], sets: list, others: list[int] | None = None, other_sets: list | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest: among ``nodes``, or between these and ``others``."""
    index = Index(sets)
    top: dict[int, int] = {}

    def root(x):
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for a, s in zip(nodes if others is None else others, sets if others is None else other_sets):
        for k in index.linked(s).tolist():
            b = nodes[k]
            x, y = root(a), root(b)
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _forests(groups: DataFrame) -> DataFrame:
    """(u, v) of rows with arrays ``own`` and, where two blocks meet, ``other``
    of (node, set)."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        def read(cell):
            if not cell.is_valid:
                return None, None
            return cell.values.field(0).to_pylist(), [np.frombuffer(b, np.int64) for b in cell.values.field(1).to_pylist()]

        for batch in batches:
            found = [e for own, other in zip(batch.column(0), batch.column(1)) for e in forest(*read(own), *read(other))]
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return groups.select("own", "other").mapInArrow(run, ENDS)


def block_links(nodes: DataFrame) -> DataFrame:
    """(u, v) of clusters cut into blocks; ``nodes``: cluster, node, central, set."""
    import pyarrow as pa

    hubs = nodes.groupBy("cluster").agg(F.max_by(F.struct("node", "set"), F.struct("central", "node")).alias("hub"))
    sided = nodes.join(hubs.select("cluster", F.col("hub.node").alias("hub"), F.col("hub.set").alias("hub_set")), "cluster")

    def near(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                star = []
                for a, b in zip(part.column(4), part.column(5)):
                    a, b = (np.frombuffer(x.as_py(), np.int64) for x in (a, b))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    star.append(100 * both >= LINK * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(star)],
                                                 names=["cluster", "node", "central", "hub", "set", "star"])

    kinds = {f.name: f.dataType for f in sided.schema.fields}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("cluster", "node", "central", "hub", "set")), T.StructField("star", T.BooleanType())])
    sided = write_table(sided.select("cluster", "node", "central", "hub", "set", "hub_set").mapInArrow(near, schema), "jaccard-stars")
    size = F.octet_length("set") / 8
    n_blocks = lambda these: F.ceil(F.sum(F.when(these, size).otherwise(0)) / BLOCK).cast("int")
    parts = sided.groupBy("cluster").agg(n_blocks(F.col("star")).alias("stars"), n_blocks(~F.col("star")).alias("loose"))
    placed = sided.join(parts, "cluster").withColumn(
        "place", F.pmod(F.xxhash64("node"), F.when(F.col("star"), F.col("stars")).otherwise(F.col("loose"))).cast("int"))
    # loose blocks are numbered from 0, blocks of the star below 0; a pair of blocks has a loose block first
    some, cell = F.col("loose") > 0, F.struct("node", "set")
    first = placed.where(some & ~F.col("star")).withColumn("mate", F.explode(F.sequence(-F.col("stars"), F.col("place"))))
    second = placed.where(some & ~F.col("star")).where("place + 1 < loose").withColumn("one", F.explode(F.sequence(F.col("place") + 1, F.col("loose") - 1)))
    starred = placed.where(some & F.col("star")).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("loose") - 1)))
    rows = first.select("cluster", F.col("place").alias("one"), "mate", F.lit(True).alias("own"), cell.alias("cell")).union(
        second.select("cluster", "one", F.col("place").alias("mate"), F.lit(False), cell)).union(
        starred.select("cluster", "one", (-1 - F.col("place")).alias("mate"), F.lit(False), cell))
    met = rows.groupBy("cluster", "one", "mate").agg(
        F.collect_list(F.when(F.col("own"), F.col("cell"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("cell"))).alias("other"))
    met = met.withColumn("other", F.when(F.col("one") != F.col("mate"), F.col("other")))
    return _forests(met).union(sided.where("star and node != hub").select("node", "hub"))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, v) that connect what may link, prefixes) of distinct sets with
    columns node, n and looked."""
    entries = exploded(nodes)
    counts = write_table(entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-counts")
    shared = entries.join(counts, "token").groupBy("node", "n").agg(F.collect_list(F.struct("c", "token")).alias("found"))
    index = write_table(prefixes(shared), "jaccard-prefixes")
    drop_table(counts)
    sizes = write_table(index.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "jaccard-lists")
    listed = index.join(sizes, "token")
    short = listed.where(F.col("size") <= BUCKET).groupBy("token").agg(F.collect_list(F.struct("node", "n", "matches")).alias("nodes"))
    pairs = list_pairs(short).groupBy("u", "v").agg(F.count("*").alias("times"), F.min("need").alias("need")).where("times >= need")
    stars = listed.where((F.col("size") > BUCKET) & (F.col("node") != F.col("least"))).select(F.col("least").alias("u"), F.col("node").alias("v"))
    return write_table(pairs.select("u", "v").union(stars.distinct()), "jaccard-candidates"), index


def links(nodes: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(u, v) that connect ``nodes`` (node, n, digest, key, looked) as their
    links do; ``texts`` (key, text) has the texts of all."""
    import pyarrow as pa

    near, index = candidates(nodes)
    clusters = components(near)
    central = index.groupBy("node").agg(F.max("central").alias("central"))
    wanted = write_table(clusters.select("node", F.col("root").alias("cluster")).join(central, "node").join(
        nodes.select("node", "digest", "key"), "node"), "jaccard-wanted")
    # one text of each key; copies meet before they are shuffled
    found = texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), pa.array([shingles(t.as_py(), size).tobytes() for t in part.column(3)], pa.binary())],
                    names=["cluster", "node", "central", "set"])

    schema = T.StructType([*(T.StructField(c, LONG) for c in ("cluster", "node", "central")), T.StructField("set", T.BinaryType())])
    sets = write_table(found.select("cluster", "node", "central", "text").mapInArrow(cut, schema), "jaccard-sets")
    large = write_table(sets.groupBy("cluster").agg(F.sum(F.octet_length("set") / 8).alias("size")).where(F.col("size") > BLOCK), "jaccard-large")
    whole = sets.join(large, "cluster", "left_anti").groupBy("cluster").agg(F.collect_list(F.struct("node", "set")).alias("own"))
    out = _forests(whole.withColumn("other", F.lit(None).cast(whole.schema["own"].dataType)))
    if not large.isEmpty():
        out = out.union(block_links(sets.join(large, "cluster", "left_semi")))
    return write_table(out, "jaccard-links")


def near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", size: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Every row with ``n_shingles`` and ``component_id``."""
    made = ["n_shingles", "component_id"]
    kept = [c for c in without(df, made) if keep_text or c != text]
    key = F.md5(col(text).cast("binary"))
    fields = [T.StructField("__n", LONG), T.StructField("__digest", T.BinaryType()), T.StructField("__looked", T.BinaryType())]
    rows = add_columns(df.withColumn("__key", key), [text], described(size), fields)
    rows = write_table(rows.select(*map(col, kept), "__key", *(f.name for f in fields), col(ident).alias("__id")), "jaccard-rows")
    nodes = rows.where("__n > 0").groupBy(F.col("__digest").alias("digest")).agg(
        F.min("__id").alias("id"), F.first("__n").alias("n"), F.min("__key").alias("key"), F.first("__looked", ignorenulls=True).alias("looked"))
    nodes = write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    joined = links(nodes.drop("id"), df.select(key.alias("key"), col(text).alias("text")), size)
    roots = components(joined)
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("id").alias("least"))
    linked = roots.join(least, "root").select("node", "least")
    found = nodes.join(linked, "node", "left").select(F.col("digest").alias("__set"), F.coalesce("least", "id").alias("component_id"))
    found = write_table(found, "jaccard-components")
    own = rows.where("__n = 0").withColumn("component_id", F.col("__id"))
    rest = rows.where("__n > 0").join(found, F.col("__digest") == F.col("__set"))
    last = [*map(col, kept), F.col("__n").alias("n_shingles"), "component_id"]
    return rest.select(*last).union(own.select(*last))


def op13_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
