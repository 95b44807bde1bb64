"""Exact repeats across texts by an enhanced suffix array, cut to fit a cluster.

Wanted: every byte inside a LENGTH-byte string that starts in two places.

1. Anchors. Of the GRAM-byte strings inside each LENGTH-byte window the one of
   least hash is the window's anchor. Equal windows choose equal anchors at
   equal offsets, so equal windows meet under the anchor's hash. Anchors whose
   hash is unique cannot belong to a repeat and go.
2. Contexts. A remaining anchor takes the bytes of the windows it stands for.
   Equal contexts of one anchor become one, with a count.
3. Repeat groups. The different contexts of an anchor meet in one task. The
   suffixes at the anchor are sorted into a suffix array with common prefix
   lengths; a stack scan yields the tree of common-prefix intervals, and their
   members are told apart by what precedes them, until each group is a maximal
   repeat with all its occurrences.
4. The occurrences of the maximal repeats, and contexts that occur more than
   once, cover the bytes to remove.

A group of more than GROUP different contexts does not go to one task: each of
its windows is counted by its digest instead (a sum per key, joined back), which
is exact and linear in the group. Rows are told apart by the hashes of id and
text; rows equal in both are copies of each other and get the same result.

Null texts are empty; texts shorter than LENGTH have no repeats. Matches never
cross rows. Repeated rows are repeats of each other. An empty table gives an
empty table.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, drop_table, table, without, write_table

LENGTH = 200
GRAM = 48
REACH = LENGTH - GRAM      # bytes before an anchor that its windows can start at
GROUP = 4096               # different contexts of an anchor in one task
BLOCK = 1 << 21            # bytes of contexts in one suffix array
MEMBERS = 1 << 19          # members of common-prefix intervals looked at together
CHUNK = 1 << 22            # bytes of a text hashed at a time
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def window_minima(x, width: int):
    """Minimum of every ``width`` neighbours, in linear time."""
    import numpy as np

    n = len(x)
    pad = -n % width
    grid = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: bytes, powers: dict = {}):  # noqa: B006  powers are kept from text to text
    """(hash, position, first window, last window) of one text's anchors; an
    anchor stands for the windows that start from first to last."""
    import numpy as np

    found = []
    for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
        part = np.frombuffer(data, np.uint8)[at:at + CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        if len(powers.get("up", ())) < len(part):
            n, inverse = len(part) + 4096, pow(BASE, -1, 1 << 64)
            for name, b in (("up", BASE), ("down", inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                powers[name] = np.multiply.accumulate(p)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * powers["up"][:len(part)], dtype=np.uint64)])
        h = (total[GRAM:] - total[:-GRAM]) * powers["down"][:len(part) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        where = np.uint64((1 << 24) - 1)
        least = (window_minima((h & ~where) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & where).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        pos, last = least[first], np.append(first[1:], len(least)) - 1
        found.append((h[pos].view(np.int64), pos + at, first + at, last + at))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def common_prefixes(strings: list[bytes], groups: list[int]):
    """(order, lcp): strings sorted within their groups, and the common prefix
    of each with the one before it (0 at the borders of a group)."""
    import numpy as np

    n, order = len(strings), sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    width = max(1, max(map(len, strings), default=1))
    grid = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(n, width)
    size, group = np.array([len(strings[i]) for i in order]), np.array([groups[i] for i in order])
    differ = grid[1:] != grid[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1])) * (group[1:] == group[:-1])
    return np.array(order), np.concatenate([[0], lcp])


class RangeMinimum:
    """Minimum of x[lo..hi], both ends included, for arrays of lo and hi."""

    def __init__(self, x):
        import numpy as np

        self.rows = [np.asarray(x)]
        while 2 ** len(self.rows) <= len(x):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo, hi):
        import numpy as np

        lo, hi = np.asarray(lo), np.asarray(hi)
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - 2**int(k) + 1])
        return out


def intervals(lcp, start: int = 0):
    """Common-prefix intervals of a sorted list, innermost first, by a stack
    scan: (length, first, last). ``lcp[k]`` belongs to entries k - 1 and k."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        length, first = (lcp[k] if k < len(lcp) else 0), k - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, start + first, start + k - 1
        if length and not (stack and stack[-1][0] == length):
            stack.append((length, first))


def maximal_repeats(contexts: list[bytes], lefts: list[int], groups: list[int]):
    """Maximal repeats of LENGTH bytes or more among contexts of equal group,
    aligned at the anchor (``left`` bytes after a context's start).

    The suffixes that start at the anchors form the array; the tree of their
    common-prefix intervals gives every right extension and who shares it. In
    an interval the left sides are compared in the same way: each interval of
    common left extensions, long enough together with the right one, is a
    repeat, and it is maximal if its suffixes do not all go on alike to the
    right. Yields (length, [(context, start), ...]).
    """
    import numpy as np

    order, right = common_prefixes([c[k:] for c, k in zip(contexts, lefts)], groups)
    back, left = common_prefixes([c[:k][::-1] for c, k in zip(contexts, lefts)], groups)
    rank = np.empty(len(back), np.int64)
    rank[back] = np.arange(len(back))
    left_min, right_min = RangeMinimum(left), RangeMinimum(right)
    lefts = np.array(lefts)

    def solve(nodes):
        length, lo, hi = (np.array(x) for x in zip(*nodes))
        sizes = hi - lo + 1
        node = np.repeat(np.arange(len(nodes)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
        by = np.lexsort((rank[order[at]], node))
        node, at = node[by], at[by]
        r = rank[order[at]]
        pair = np.flatnonzero(node[1:] == node[:-1])
        shared = np.zeros(len(at), np.int64)  # left extension with the member before
        shared[pair + 1] = left_min(r[pair] + 1, r[pair + 1])
        shared[shared + length[node] < LENGTH] = 0
        long = shared > 0
        if (length >= LENGTH).any():  # the right side alone is enough: an empty left extension counts
            long |= np.concatenate([[False], node[1:] == node[:-1]]) & (length[node] >= LENGTH)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], long, [False]]).astype(np.int8)))
        for first, stop in zip(edge[::2] - 1, edge[1::2]):  # members first..stop-1 are linked
            n = node[first]
            for extra, i, j in intervals([0, *(shared[first + 1:stop] + 1).tolist()], int(first)):
                places = at[i:j + 1]
                a, b = int(places.min()), int(places.max())
                if right_min([a + 1], [b])[0] > length[n]:
                    continue  # all of them go on alike: found with the longer right side
                who = order[places]
                yield int(length[n]) + extra - 1, list(zip(who.tolist(), (lefts[who] - (extra - 1)).tolist()))

    nodes, members = [], 0
    for length, lo, hi in intervals(right.tolist()):
        if length + REACH >= LENGTH:
            nodes.append((length, lo, hi))
            members += hi - lo + 1
        if members > MEMBERS:
            yield from solve(nodes)
            nodes, members = [], 0
    if nodes:
        yield from solve(nodes)


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _row_key(text: str, ident: str):
    return F.xxhash64(col(text)), F.xxhash64(col(ident))


def find_contexts(df: DataFrame, text: str, ident: str) -> DataFrame:
    """Contexts of anchors that occur twice: (h, ck, lead, ctx, r1, r2, at)."""
    import pyarrow as pa

    r1, r2 = _row_key(text, ident)
    docs = df.select(r1.alias("r1"), r2.alias("r2"), F.encode(F.coalesce(col(text), F.lit("")), "UTF-8").alias("data"))
    docs = docs.where(F.octet_length("data") >= LENGTH)
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("h", "r1", "r2", "pos", "lo", "hi")])

    def cut(batches):
        import numpy as np

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [anchors(x.as_py()) for x in part.column(2)]
                counts = [len(x[0]) for x in got]
                h, pos, first, last = (pa.array(np.concatenate(x)) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([
                    h, pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(np.repeat(part.column(1).to_numpy(), counts)),
                    pos, first, last], names=["h", "r1", "r2", "pos", "lo", "hi"])

    marks = write_table(docs.mapInArrow(cut, kind), "repeat-anchors")
    # written, so that both sides of the join are shuffles whose large keys Spark can split
    twice = write_table(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-hashes")
    spots = marks.join(twice, "h").groupBy("r1", "r2").agg(F.collect_set(F.struct("pos", "h", "lo", "hi")).alias("spots"))
    made = T.StructType([T.StructField("h", T.LongType()), T.StructField("ck", T.BinaryType()), T.StructField("lead", T.LongType()),
                         T.StructField("ctx", T.BinaryType()), T.StructField("r1", T.LongType()), T.StructField("r2", T.LongType()),
                         T.StructField("at", T.ArrayType(T.LongType()))])

    def surround(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, found = batch.column("data")[k].as_py(), {}
                for x in batch.column("spots")[k].as_py():
                    lead, ctx = x["pos"] - x["lo"], data[x["lo"]:x["hi"] + LENGTH]
                    found.setdefault((x["h"], lead, ctx), []).append(x["pos"])
                rows = [{"h": h, "ck": blake2b(ctx, digest_size=16).digest(), "lead": lead, "ctx": ctx,
                         "r1": batch.column("r1")[k].as_py(), "r2": batch.column("r2")[k].as_py(), "at": sorted(at)}
                        for (h, lead, ctx), at in found.items()]
                for i in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[i:i + 4096], schema=arrow)

    arrow = pa.schema([("h", pa.int64()), ("ck", pa.binary()), ("lead", pa.int64()), ("ctx", pa.binary()), ("r1", pa.int64()),
                       ("r2", pa.int64()), ("at", pa.list_(pa.int64()))])
    out = write_table(docs.join(spots, ["r1", "r2"]).mapInArrow(surround, made), "repeat-contexts")
    drop_table(marks)
    drop_table(twice)
    return out


def repeat_groups(contexts: DataFrame, merge: bool = False) -> DataFrame:
    """Maximal repeats among the contexts of each anchor: (h, ck, lead, grp,
    start, length), one row per occurrence; start counts from the context's
    start and grp numbers the repeats of a task. Contexts that occur more than
    once are repeats of their whole length, with grp -1; windows of anchors
    with more than GROUP contexts come as repeats of LENGTH bytes with grp -2.
    ``merge`` joins the occurrences that overlap in a context (grp -3)."""
    import pyarrow as pa

    distinct = write_table(contexts.groupBy("h", "ck", "lead").agg(
        F.sum(F.size("at")).alias("n"), F.first("ctx").alias("ctx")), "repeat-distinct")
    width = write_table(distinct.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "repeat-widths")
    several = distinct.join(width, "h")
    whole = distinct.where((F.col("n") > 1) & (F.length("ctx") >= LENGTH)).select(
        "h", "ck", "lead", F.lit(-1).cast("long").alias("grp"), F.lit(0).cast("long").alias("start"),
        F.length("ctx").cast("long").alias("length"))
    names = ["h", "ck", "lead", "grp", "start", "length"]
    schema = whole.schema
    arrow = pa.schema([(f, pa.binary() if f == "ck" else pa.int64()) for f in names])

    def scan(batches):
        def solve(block):
            rows = [(h, x) for h, members in block for x in members]
            ids = {h: k for k, h in enumerate(dict.fromkeys(h for h, _ in rows))}
            found = maximal_repeats([x["ctx"] for _, x in rows], [x["lead"] for _, x in rows], [ids[h] for h, _ in rows])
            if merge:
                runs: dict[int, list] = {}
                for length, places in found:
                    for c, start in places:
                        runs.setdefault(c, []).append((start, start + length))
                found = ((c, a, b - a) for c, r in runs.items() for a, b in merged(r))
                out = [(rows[c][0], rows[c][1]["ck"], rows[c][1]["lead"], -3, start, length) for c, start, length in found]
            else:
                out = [(rows[c][0], rows[c][1]["ck"], rows[c][1]["lead"], g, start, length)
                       for g, (length, places) in enumerate(found) for c, start in places]
            for i in range(0, len(out), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i:i + 8192]), arrow.types)], names=names)

        block, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column("members")[k].as_py()
                block.append((batch.column("h")[k].as_py(), members))
                size += sum(len(x["ctx"]) for x in members)
                if size >= BLOCK:
                    yield from solve(block)
                    block, size = [], 0
        if block:
            yield from solve(block)

    fit = several.where(F.col("m") <= GROUP).groupBy("h").agg(F.collect_list(F.struct("ck", "lead", "ctx")).alias("members"))
    out = whole.union(fit.mapInArrow(scan, schema))
    large = several.where(F.col("m") > GROUP)
    if not large.isEmpty():
        # windows end at the context's end; the two hashes stand for distance to the anchor and bytes
        starts = F.sequence(F.lit(0), F.length("ctx") - LENGTH)
        cell = F.expr(f"substring(ctx, start + 1, {LENGTH})")
        windows = (large.select("h", "ck", "lead", "ctx", F.explode(starts).alias("start"))
                   .select("h", "ck", "lead", "start", F.xxhash64("h", F.col("lead") - F.col("start"), cell).alias("lane"),
                           F.xxhash64(cell).alias("window")))
        again = windows.groupBy("lane", "window").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        out = out.union(windows.join(again, ["lane", "window"]).select(
            "h", "ck", "lead", F.lit(-2).cast("long"), F.col("start").cast("long"), F.lit(LENGTH).cast("long")))
    return out


def covered(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(r1, r2, runs): the repeated byte runs of every row that has some."""
    contexts = find_contexts(df, text, ident)
    cover = repeat_groups(contexts, merge=True).groupBy("h", "ck", "lead").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    runs = T.ArrayType(T.ArrayType(T.LongType()))
    join_runs = lambda parts: [[[list(r) for r in merged((x["start"], x["start"] + x["length"]) for x in p)] for p in parts]]
    cover = write_table(add_columns(cover, ["parts"], join_runs, [T.StructField("part", runs)]).drop("parts"), "repeat-cover")
    hits = contexts.select("h", "ck", "lead", "r1", "r2", "at").join(cover, ["h", "ck", "lead"])
    return hits.groupBy("r1", "r2").agg(F.collect_list(F.struct("lead", "at", "part")).alias("hits"))


def remove_repeats(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Every row with n_bytes, n_removed, ``removed`` (runs of bytes) and
    ``kept`` (the remaining bytes, not always valid UTF-8)."""
    made = ["n_bytes", "n_removed", "removed", "kept"]
    r1, r2 = _row_key(text, ident)
    rows = df.select(*map(col, without(df, made)), F.coalesce(col(text), F.lit("")).alias("__text"), r1.alias("__r1"), r2.alias("__r2"))
    hits = covered(df, text, ident).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("hits").alias("__hits"))

    def cut(texts, found):
        out = [[], [], [], []]
        for t, hs in zip(texts, found):
            data = t.encode("utf-8")
            runs = merged((p - x["lead"] + a, p - x["lead"] + b) for x in hs or () for p in x["at"] for a, b in x["part"])
            kept, last = [], 0
            for a, b in runs:
                kept.append(data[last:a])
                last = b
            kept.append(data[last:])
            for o, v in zip(out, (len(data), sum(b - a for a, b in runs), [list(r) for r in runs], b"".join(kept))):
                o.append(v)
        return out

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())]
    return add_columns(rows.join(hits, ["__r1", "__r2"], "left"), ["__text", "__hits"], cut, fields).drop(
        "__text", "__hits", "__r1", "__r2")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = add_columns(out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept"),
                         ["kept"], lambda xs: [[sha256(x).hexdigest() for x in xs]], [T.StructField("kept_sha256", T.StringType())])
    return digest.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
