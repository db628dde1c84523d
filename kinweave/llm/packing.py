"""Filling fixed-capacity containers with items (problem 8) by Karmarkar-Karp differencing.

Texts are measured in tokens of a public tokenizer, whole and once. Items are dealt by hash into
blocks of about BLOCK items each, so no task holds more whatever the input's size; a block's share
of unused space shrinks with its size, and at BLOCK items is a part of one container in hundreds.
Within a block multiway differencing starts from one partial partition for each item and always merges
the two of largest difference, largest sums against smallest, until one partition into k windows is
left; k starts at the least number that could hold the block and rises whenever a window exceeds
the capacity.

An item larger than the capacity is split into full pieces and a rest; a full piece fills a
container by itself, the rest is an item like any other. No other item is split.

Defined results: null texts are no items; an empty text is an item of no tokens and lies in some
container; equal sizes go by document and piece; repeated rows of a doc_id are one item each, told
apart by nothing but their number; a capacity that is null or below one packs nothing; empty tables
give no rows; further columns are ignored.
"""

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import cut

BLOCK = 2048
#: File of ranks of a public byte-level BPE tokenizer; the environment variable overrides it.
TOKENIZER = os.environ.get("KINWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Split of text into words before byte pairs are merged (the vocabulary's published pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a ranks file, made once for each Python worker."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def measured(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each item, sum of each window) for k windows.

    A partial partition is k sums in falling order with the group behind each; groups form a
    forest whose leaves are the items, so merging moves numbers, not lists.
    """
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    parent = np.arange(2 * n, dtype=np.int64)
    made = n
    # only the filled windows of a partial partition are kept, the other k - len are empty
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.array([s]), np.array([i])) for i, s in enumerate(sizes)}
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (sa, ga), (sb, gb) = parts.pop(x), parts.pop(y)
        a, b = len(sa), len(sb)
        both = max(0, a + b - k)  # windows that get a group of each: a's smallest with b's largest... b's order turned round
        if both:
            lead, tail = a - both, both
            s = np.concatenate([sa[:lead], sa[lead:] + sb[b - tail :][::-1] if tail else sa[lead:], sb[: b - tail]])
            new = np.arange(made, made + both)
            parent[ga[lead:]], parent[gb[b - tail :][::-1]] = new, new
            made += both
            g = np.concatenate([ga[:lead], new, gb[: b - tail]])
        else:
            s, g = np.concatenate([sa, sb]), np.concatenate([ga, gb])
        order = np.argsort(-s, kind="stable")
        s, g = s[order], g[order]
        parts[serial] = (s, g)
        low = s[-1] if len(s) == k else 0
        heapq.heappush(heap, (-int(s[0] - low), serial))
        serial += 1
    s, g = parts[heap[0][1]]
    window = np.full(made, -1, np.int64)
    window[g] = np.arange(len(g))
    for i in range(made - 1, -1, -1):
        if window[i] < 0:
            window[i] = window[parent[i]]
    return window[:n], s


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: differencing into the fewest windows that it can keep within the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    step, last = 1, k - 1  # the number of windows rises, in growing steps, until all fit; then the gap is closed
    while True:
        window, sums = difference(sizes, min(k, len(sizes)))
        if sums.max() <= capacity or k >= len(sizes):
            break
        last, k, step = k, k + step, step * 2
    best, high = window, k
    while high - last > 1:
        mid = (high + last) // 2
        window, sums = difference(sizes, min(mid, len(sizes)))
        if sums.max() <= capacity:
            best, high = window, mid
        else:
            last = mid
    return best


_OUT = T.StructType([T.StructField("target_id", T.LongType()), T.StructField("container_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("start_token", T.LongType()), T.StructField("n_tokens", T.LongType())])


def containers(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(target_id, container_id, doc_id, piece, start_token, n_tokens): where each text, or piece of a
    text longer than the capacity, lies."""
    sized = cut(measured(documents, path))
    n = F.col("n_tokens")
    cap = F.col("capacity")
    to = targets.filter("capacity_tokens >= 1 AND target_id IS NOT NULL").select(F.col("target_id").cast("long"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    # equal rows are told apart by their count, so nothing depends on how the table is split
    told = sized.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("rows")).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    each = told.crossJoin(to)  # a handful of targets
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / cap) - 1, F.lit(0)).cast("long"))))
    pieces = pieces.select("target_id", "capacity", "doc_id", n.alias("size"), "row", "piece", (F.col("piece") * cap).alias("start_token"), F.least(cap, n - F.col("piece") * cap).alias("n_tokens"))
    whole = pieces.filter("n_tokens = capacity").select(
        "target_id", F.concat_ws("-", "target_id", F.lit("w"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "row", "piece").alias("container_id"), "doc_id", "piece", "start_token", "n_tokens"
    )
    rest = pieces.filter("n_tokens < capacity")
    blocks = rest.groupBy("target_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("long").alias("blocks"))
    dealt = rest.join(blocks, "target_id").withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", "row", "piece"), F.col("blocks")))

    def run(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        t = t.take(order)
        window = pack(t.column("n_tokens").to_numpy(), int(t.column("capacity")[0].as_py()))
        at = f"{t.column('target_id')[0].as_py()}-{t.column('block')[0].as_py()}-"
        ids = pa.array([f"{at}{w}" for w in window], pa.string())
        return pa.table([t.column("target_id"), ids, t.column("doc_id"), t.column("piece"), t.column("start_token"), t.column("n_tokens")], names=_OUT.names)

    # blocks are small but take a second of CPU each, so they are not put together by their bytes
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.sparkSession.sparkContext.defaultParallelism)
    spread = dealt.select("target_id", "capacity", "block", "doc_id", "piece", "start_token", "n_tokens").repartition(tasks, "target_id", "block")
    packed = spread.groupBy("target_id", "block").applyInArrow(run, _OUT)
    return packed.unionByName(whole)


def filling(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, tokens, fullest, filled): number of containers and the share of their space in use."""
    each = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("target_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return total.join(targets.select("target_id", "capacity_tokens"), "target_id").select("target_id", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
