"""Evaluation texts leaking into training text (problem 9): size-partitioned MinHash containment search.

Items are partitioned by size, and each class keeps as few minwise shingle hashes as it can without
losing a reportable passage:

* an item of fewer than SHINGLE words keeps one hash, of all its words;
* an item of fewer than MIN_WORDS words must be held whole: it keeps its least shingle hash, and that one
  shingle is then sure to be in the document;
* of a longer item any MIN_WORDS words may be held, with at most one in ALTERED altered. Whichever word
  of such a passage is altered, somewhere RUN shingles in a row stay whole, so the item keeps the
  least hash of each RUN neighbouring shingles (two thirds of all), and a document's
  own least hashes of RUN neighbours hit it: the same RUN shingles have the same least hash.

The sketch is small and goes to every executor, in blocks of MOST_SHINGLES if there are more; the corpus is
read once for each block and never shuffled: a document's shingles are hashed in place, looked up
in the sorted sketch, and what is hit is verified in the same batch by exact containment.

Verification lines the item's words up with the document's along each diagonal that was hit, joins
the runs of equal words, and reports the item if some stretch of MIN_WORDS or more of its
consecutive words has at most one word in ALTERED altered, whether replaced, dropped or put in.
Words are runs of non-blank characters without markup, case and punctuation.

Defined results: null and empty texts leak nothing; an item of fewer than MIN_WORDS words is found
if the document holds it whole; an item without words is in no document; repeated items are each
reported; repeated rows of a document count once; empty tables give no rows; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import kernels as K

SHINGLE = 5
MIN_WORDS = 12
ALTERED = 9


def _sure_run() -> int:
    """Shingles in a row that stay whole in any reportable passage, wherever its altered words are."""
    # k altered words part n words into k + 1 stretches, the longest of at least (n - k) / (k + 1) words
    longest = (-(-(n - n // ALTERED) // (n // ALTERED + 1)) for n in range(MIN_WORDS, MIN_WORDS + 20 * ALTERED))
    return min(longest) - SHINGLE + 1


RUN = _sure_run()
#: Shingles of one block of items: 16 bytes each, 64 MB on an executor.
MOST_SHINGLES = 4_000_000
#: Hits of a document batch that are lined up at once.
MOST_HITS = 1_000_000

_STEPS = [
    (r"<[/!?A-Za-z][^<>]*>|&[A-Za-z#0-9]{2,8};", " "),
    ("[   -     　–—…|/]", " "),
    (r"[^\p{L}\p{N}\s]+", ""),
]


def plain_words(col: pa.Array) -> pa.Array:
    """Texts as lower-case words without markup and punctuation, one blank or more between them."""
    col = pc.utf8_normalize(col, form="NFKC") if hasattr(pc, "utf8_normalize") else col
    for pattern, by in _STEPS:
        col = pc.replace_substring_regex(col, pattern=pattern, replacement=by)
    return pc.utf8_lower(col)


def least_of_runs(h: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each shingle, at word ``at`` of text ``row``, has the least hash of some RUN neighbouring
    shingles of its text; a text of fewer shingles keeps its least."""
    keep = np.zeros(len(h), bool)
    if not len(h):
        return keep
    # windows start at each shingle that has RUN - 1 more of its text behind it
    n = len(h) - RUN + 1
    start = np.flatnonzero(row[:n] == row[RUN - 1 : RUN - 1 + n]) if n > 0 else np.zeros(0, np.int64)
    best = start.copy()
    for i in range(1, RUN):
        best = np.where(h[start + i] < h[best], start + i, best)
    keep[best] = True
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.concatenate([first, [len(row)]]))
    for f, k in zip(first[size < RUN], size[size < RUN]):
        keep[f + int(np.argmin(h[f : f + k]))] = True
    return keep


def sketch(texts: list[str]) -> tuple[list[np.ndarray], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], list[int]]:
    """(word hashes of each text; for each shingle length the sorted hashes kept, item and word position
    of each; the shingle lengths for which all of a document's shingles must be looked up)."""
    h, _, _, row = K.words(plain_words(pa.array(texts, pa.string())))
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    words = [h[a:b] for a, b in zip(ends, ends[1:])]
    n_words = np.diff(ends)
    kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    whole = []

    def add(k: int, s: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        old = kept.get(k, (np.zeros(0, s.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        s, item, place = (np.concatenate(x) for x in zip(old, (s, item, place)))
        order = np.argsort(s, kind="stable")
        kept[k] = s[order], item[order], place[order]

    for k in range(1, SHINGLE):  # items shorter than a shingle
        s, at = K.shingles(h, row, k)
        mine = n_words[row[at]] == k
        if mine.any():
            add(k, s[mine], row[at][mine], np.zeros(int(mine.sum()), np.int64))
            whole.append(k)
    s, at = K.shingles(h, row, SHINGLE)
    item = row[at]
    size = n_words[item]
    long = np.flatnonzero(size >= MIN_WORDS)
    keep = long[least_of_runs(s[long], at[long], item[long])]
    short = np.flatnonzero(size < MIN_WORDS)
    if len(short):
        order = short[np.lexsort((s[short], item[short]))]
        keep = np.concatenate([keep, order[np.concatenate([[True], item[order][1:] != item[order][:-1]])]])
        whole.append(SHINGLE)
    if len(keep):
        add(SHINGLE, s[keep], item[keep], (at - ends[item])[keep])
    return words, kept, whole


def _runs(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of runs of equal words on the diagonals."""
    out = []
    for d in diagonals:
        a, b = max(0, -d), min(len(item), len(doc) - d)
        same = np.concatenate([[False], item[a:b] == doc[a + d : b + d], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        out += [(int(a + s), int(a + s + d), int(e - s)) for s, e in zip(edge[::2], edge[1::2])]
    return sorted(out)


def holds(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> bool:
    """Whether a stretch of the item with few enough altered words lies along the diagonals."""
    least = min(MIN_WORDS, len(item))
    runs = _runs(doc, item, diagonals)
    if any(n >= least for _, _, n in runs):
        return True
    # best[r]: stretches that end with run r, as (first item word, altered words so far), the undominated ones
    best: list[list[tuple[int, int]]] = []
    for r, (i, j, n) in enumerate(runs):
        states = [(i, 0)]
        for q in range(r - 1, -1, -1):
            qi, qj, qn = runs[q]
            gi, gj = i - (qi + qn), j - (qj + qn)
            # the diagonals may meet inside equal words
            over = max(0, -gi, -gj)
            if over >= min(n, qn):
                continue
            gap = max(gi, gj) + over
            if gap > 1 + len(item) // ALTERED:
                continue
            states += [(s, c + max(gap, 1)) for s, c in best[q]]
        keep, low = [], 1 << 30
        for s, c in sorted(set(states)):
            if c < low:
                keep.append((s, c))
                low = c
        best.append(keep)
        for s, c in keep:
            words = i + n - s
            before, behind = min(s, j - (i - s)), min(len(item) - i - n, len(doc) - j - n)
            # altered words may also stand at either end
            if any(words + k >= least and c + k <= (words + k) // ALTERED for k in range(max(0, min(before + behind, least)) + 1)):
                return True
    return False


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])


def _hits(h: np.ndarray, row: np.ndarray, first: np.ndarray, kept: dict, whole: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, diagonal), each once, of the shingles in the sketch; MOST_HITS at a time, a document's hits together."""
    found = []
    for k, (keys, items, places) in kept.items():
        s, at = K.shingles(h, row, k)
        if k not in whole:
            mine = least_of_runs(s, at, row[at])
            s, at = s[mine], at[mine]
        lo = np.searchsorted(keys, s, "left")
        some = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == s)
        lo, at = lo[some], at[some]
        found.append((at, lo, np.searchsorted(keys, s[some], "right") - lo, np.full(len(at), k)))
    at, lo, n, k = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    at, lo, n, k = at[order], lo[order], n[order], k[order]
    doc = row[at]
    total = np.cumsum(n)
    a = 0
    while a < len(at):  # whole documents, as many as stay under MOST_HITS, one at least
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST_HITS, "right"))
        b = int(np.searchsorted(doc, doc[b], "left")) if b < len(at) else b
        b = b if b > a else int(np.searchsorted(doc, doc[a], "right"))
        best = np.zeros((0, 3), np.int64)
        for c in range(a, b, max(1, MOST_HITS // max(1, int(n[a:b].max(initial=1))))):  # a common shingle of many items expands piece by piece
            e = min(b, c + max(1, MOST_HITS // max(1, int(n[a:b].max(initial=1)))))
            m = n[c:e]
            j = np.repeat(lo[c:e] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            pos, kind = np.repeat(at[c:e], m), np.repeat(k[c:e], m)
            item, place = np.empty(len(j), np.int64), np.empty(len(j), np.int64)
            for kk, (_, items, places) in kept.items():
                some = kind == kk
                item[some], place[some] = items[j[some]], places[j[some]]
            best = np.unique(np.concatenate([best, np.stack([row[pos], item, pos - first[row[pos]] - place], axis=1)]), axis=0)
        yield best[:, 0], best[:, 1], best[:, 2]
        a = b


def _search(shared, ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept, whole = shared.value
        for b in batches:
            h, _, _, row = K.words(plain_words(pc.fill_null(b.column(1), "")))
            first = np.searchsorted(row, np.arange(len(b) + 1))
            out: tuple[list, list] = ([], [])
            doc_ids = b.column(0)
            for doc, item, diagonal in _hits(h, row, first, kept, whole) if kept else ():
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
                for x, y in zip(cut, [*cut[1:], len(doc)]):
                    d = doc[x]
                    if holds(h[first[d] : first[d + 1]], words[item[x]], diagonal[x:y]):
                        out[0].append(doc_ids[int(d)].as_py())
                        out[1].append(ids[item[x]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], _SCHEMA.names)

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    sized = items.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // (5 * MOST_SHINGLES)) + 1  # a word and a blank take five characters or more, about
    found = None
    for i in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id").collect()
        if part:
            shared = spark.sparkContext.broadcast(sketch([r.text for r in part]))
            got = docs.mapInArrow(_search(shared, [r.item_id for r in part]), _SCHEMA)
            found = got if found is None else found.unionByName(got)
    return found.distinct() if found is not None else spark.createDataFrame([], _SCHEMA)
