"""Alignment of two tokenizers over the same bytes.

Tokenizer A is byte-level BPE, B a piece model with byte fallback
(``sentencepiece``). Both cut " " + text; where the bytes of their tokens do
not join to exactly that, the text has no tokens. A's file is read by
``tokenizers``; where its ids follow its merges, texts of scripts whose
character classes no Unicode version changes go through ``tiktoken`` with the
same vocabulary, which gives the same ids in a third of the time.

Offsets where tokens of both end cut them into groups. They are found by
skipping along a diagonal: where A[i] and B[j] start together, the ends of
A[i + x] and B[j + x] are compared in blocks of 1, 2, 4, .. tokens, so a
stretch of one-to-one tokens costs one list comparison a block; at the first
difference the block is narrowed by halves. What stands there is one irregular
group, walked token by token until the ends meet, and j - i is the new shift.

Two tokens are linked where their byte ranges overlap. The count of an id pair
is the number of documents (rows) that hold it linked. Every document is cut
once; its numbers, distinct pairs and their occurrences are written. Tasks add
the pairs of their rows before the counts are shuffled. Counts are looked up in
arrays sent to every task where the table has at most SENT pairs; beyond that
the pairs of the documents are joined with the table, so no size is refused.

Null, empty and differing texts have zeros everywhere and an empty digest.
Repeated rows count one by one. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, table, without, write_table

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSTABLE = re.compile("[^\x00-\u052f\u2010-\u2060]")
SENT = 2_000_000  # pairs of the table that every task gets, 17 bytes each
HELD = 2_000_000  # pairs that a task adds up before it passes them on


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others for 256, 257, .. in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def quick(file: bytes, entries: list[bytes]):
    """A ``tiktoken`` encoder of a byte-level vocabulary, or None where the ids
    are not in the order of the merges."""
    import tiktoken

    read = json.loads(file)
    vocab, merges = read["model"]["vocab"], read["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if read.get("normalizer") is not None or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(pairs)):
        return None
    ranks = {entries[i]: i for i in range(256 + len(pairs))}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Cutter:
    """Both tokenizers and the bytes of their ids; made once in each worker."""

    def __init__(self, a: bytes, b: bytes):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        of = byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.quick = quick(a, self.bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names = [[np.array([f"{i}{sep}" for i in range(n)], object) for sep in seps]
                      for n, seps in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;"))]

    def cut_a(self, texts: list[str]) -> list[list[int]]:
        other = [i for i, t in enumerate(texts) if self.quick is None or UNSTABLE.search(t)]
        out: list = [None] * len(texts)
        for i, got in zip(other, self.a.encode_batch([texts[i] for i in other], add_special_tokens=False)):
            out[i] = got.ids
        return [self.quick.encode_ordinary(t) if x is None else x for t, x in zip(texts, out)]

    def cut(self, texts: list[str | None]):
        """(ids of A, ids of B) per text, both empty where they do not join."""
        there = [i for i, t in enumerate(texts) if t]
        whole = [" " + texts[i] for i in there]
        out: list = [([], [])] * len(texts)
        got_a = self.cut_a(whole)
        got_b = self.b.encode([texts[i] for i in there], num_threads=1)
        for i, text, x, y in zip(there, whole, got_a, got_b):
            raw = text.encode()
            if b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y)):
                out[i] = (x, y)
        return out

    def text(self, x, y, ends_a, ends_b) -> str:
        """a1,a2|b1;a3|b2,b3 of ids and the groups' last tokens."""
        import numpy as np

        spots, parts = [], []
        for ids, ends, (inner, last) in ((x, ends_a, self.names[0]), (y, ends_b, self.names[1])):
            named = inner[ids]
            named[ends] = last[ids[ends]]
            parts.append(named)
            spots.append(np.searchsorted(ends, np.arange(len(ids))))  # the group of each token
        out = np.empty(len(x) + len(y), object)
        # tokens of A stand behind the groups before; tokens of B behind those of A in the same group too
        out[np.arange(len(x)) + np.concatenate(([0], ends_b + 1))[spots[0]]] = parts[0]
        out[np.arange(len(y)) + ends_a[spots[1]] + 1] = parts[1]
        return "".join(out.tolist())[:-1]


def groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indexes of the tokens of A and of B that end a group, from the ends of
    all tokens in bytes."""
    out_a: list[int] = []
    out_b: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        # a and b start together here
        if a[i] == b[j]:
            step, start = 1, i
            shift = j - i
            while i < n and a[i:i + step] == b[i + shift:i + shift + step]:
                i += step
                step *= 2
            i = min(i, n)
            while step > 1:
                step //= 2
                if i < n and a[i:i + step] == b[i + shift:i + shift + step]:
                    i = min(i + step, n)
            j = i + shift
            out_a += range(start, i)
            out_b += range(start + shift, j)
        else:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            out_a.append(i)
            out_b.append(j)
            i += 1
            j += 1
    return out_a, out_b


def links(x, y, ends_a, ends_b):
    """(id of A, id of B) of every two tokens that share bytes: one pair for
    each stretch between neighbouring ends."""
    import numpy as np

    at = np.union1d(ends_a, ends_b)
    return x[np.searchsorted(ends_a, at)], y[np.searchsorted(ends_b, at)]


def measured(cutter: Cutter, texts: list[str | None]) -> list[list]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, keys, times."""
    import numpy as np

    out: list[list] = [[] for _ in range(7)]
    for ids_a, ids_b in cutter.cut(texts):
        row = [0, 0, 0, 0, "", b"", b""]
        if ids_a:
            x, y = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            at_a, at_b = np.cumsum(cutter.len_a[x]), np.cumsum(cutter.len_b[y])
            end_a, end_b = (np.array(g, np.int64) for g in groups(at_a.tolist(), at_b.tolist()))
            one, two = links(x, y, at_a, at_b)
            keys, times = np.unique(one << 32 | two, return_counts=True)
            digest = sha256(cutter.text(x, y, end_a, end_b).encode()).hexdigest()
            row = [len(x), len(y), len(end_a), len(one), digest, keys.astype("<i8").tobytes(), times.astype("<i4").tobytes()]
        for made, v in zip(out, row):
            made.append(v)
    return out


def pair_counts(cut: DataFrame) -> DataFrame:
    """(key, n, best): documents of each id pair, and whether no pair of the
    same id of A is in more."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
        for batch in batches:
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            new, times = np.unique(new, return_counts=True)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n, times]), minlength=len(both)).astype(np.int64)
            keys = both
            if len(keys) > HELD:
                yield emit()
                keys, n = keys[:0], n[:0]
        yield emit()

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    counts = write_table(cut.select("__keys").mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n")), "align-counts")
    a = F.shiftright("key", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", a).join(most, "a")
    return write_table(joined.select("key", "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")


def _by_arrays(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_best and count_sum from arrays of all pairs in every task."""
    import numpy as np

    got = pairs.toArrow()  # at most SENT rows
    key = got["key"].to_numpy()
    order = np.argsort(key)
    sent = cut.sparkSession.sparkContext.broadcast(
        tuple(np.ascontiguousarray(x[order]) for x in (key, got["n"].to_numpy(), got["best"].to_numpy(zero_copy_only=False))))

    def run(keys, times):
        import numpy as np

        all_keys, n, best = sent.value
        out: list[list[int]] = [[], []]
        for k, t in zip(keys, times):
            at, t = np.searchsorted(all_keys, np.frombuffer(k, "<i8")), np.frombuffer(t, "<i4").astype(np.int64)
            out[0].append(int(t[best[at]].sum()))
            out[1].append(int((t * n[at]).sum()))
        return out

    return add_columns(cut, ["__keys", "__times"], run, [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])


def _by_join(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a join on the pair; Spark splits its large keys."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            for row, k, t in zip(*(batch.column(i) for i in range(3))):
                k, t = np.frombuffer(k.as_py(), "<i8"), np.frombuffer(t.as_py(), "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row.as_py(), np.int64)), pa.array(k), pa.array(t)],
                                                 names=["__row", "key", "times"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("__row", "key", "times")])
    long = cut.select("__row", "__keys", "__times").mapInArrow(run, schema).join(pairs, "key")
    sums = long.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return cut.join(sums, "__row", "left").fillna(0, ["n_best", "count_sum"])


def align(df: DataFrame, text: str = "text", folder: str = FOLDER, keep_text: bool = True, sent: int = SENT) -> DataFrame:
    """Every row with n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256. ``folder`` is read by the driver; both files travel with
    the tasks."""
    files = []
    for name in (FILE_A, FILE_B):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    both = df.sparkSession.sparkContext.broadcast(tuple(files))
    state: list[Cutter] = []

    def run(texts):
        if not state:
            state.append(Cutter(*both.value))
        return measured(state[0], texts)

    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [*(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups_sha256", T.StringType()),
              T.StructField("__keys", T.BinaryType()), T.StructField("__times", T.BinaryType())]
    cut = add_columns(df, [text], run, fields)
    made = [*numbers, "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in without(df, made) if keep_text or c != text]
    cut = write_table(cut.select(*map(col, kept), *(f.name for f in fields), F.monotonically_increasing_id().alias("__row")), "align-cut")
    pairs = pair_counts(cut)
    found = (_by_arrays if pairs.count() <= sent else _by_join)(cut, pairs)
    return found.select(*map(col, kept), *made)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
