"""Keyword-stuffed and link-list pages (problem 10).

A page becomes a sequence of classes: function words stand for themselves, other words for their
kind (lower case, capital, said again, number, address, hashtag), punctuation and line ends for themselves. A
trigram model of such sequences is trained on the prose of the corpus itself: the pages whose
share of function words is within the middle of all pages'. A page is a candidate if the model
finds it abnormally surprising or abnormally predictable: further than WIDTH robust deviations
from the median of the prose. Counts, quantiles and scores cover all pages and whole texts; the model's
size is bounded by the number of classes, not by the corpus.

Glossaries, logs and exports are as far from prose as spam is, so a candidate is spam only if it
has few function words and most of its words stand in repeated keywords, links or tags. Lines that carry a record (a time or date
in front, a row of a table, a key with its value) are not that, however much they repeat.

Defined results: null and empty texts, and texts without words, are not spam; equal texts get equal
answers; an empty table gives no rows; further columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import cut, reclaim

# Function words of the corpus' languages.
FUNCTION_WORDS = {
    "en": "a an the and or but if of to in on at by for from with as that this these those it its is are was were be been has have had not no so than then there they them their he his her she we you i our your who which what when where how all each any one both still only into after before between since because while although whether",
    "es": "el la los las un una unos y o de del al en con por para sin que se no es son fue ha su sus lo le este esta como más pero antes ya",
    "de": "der die das den dem des ein eine einen und oder aber in im an auf mit von zu zum bei für nicht ist sind war wurde hat haben soll aus nach es er sie wir dass",
    "fr": "le la les l un une des et ou mais de du d à au aux en dans sur par pour sans que qui ne pas est sont a été son sa ses ce cette il elle nous plus avec",
}
_WORDS = {w: i for i, w in enumerate(sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()}))}
_KINDS = ["edge", "again", "lower", "capital", "number", "mixed", "link", "tag", "stop", "comma", "colon", "bracket", "rule", "other", "line"]
_KIND = {k: len(_WORDS) + i for i, k in enumerate(_KINDS)}
N_CLASSES = len(_WORDS) + len(_KINDS)
_CODE = np.uint16
_TOKEN = re.compile(r"</?[aA](?:\s[^<>]*)?>|(?:[hH][tT][tT][pP][sS]?://|www\.)[^\s<>\"')\]]+|\#[^\W\d]\w*|[^\W_]+(?:[_'’][^\W_]+)*|\n\s*|[^\w\s]")
_MARK = {".": "stop", "!": "stop", "?": "stop", "…": "stop", ",": "comma", ";": "colon", ":": "colon", "(": "bracket", ")": "bracket", "[": "bracket", "]": "bracket", "<": "bracket", ">": "bracket", "|": "rule", "/": "rule", "•": "rule", "-": "rule", "*": "rule", "·": "rule"}
WIDTH = 2.0
#: Surprise from which on a share of function words up to FAR_SHARE, as prose may have, doesn't save a page.
FAR, FAR_SHARE = 8.0, 0.4
SPAM_SHARE = 0.5
#: A content word counts as said again if it is among so many before it.
RECENT = 12
#: Share of function words from which on a text is sentences, however often they recur.
PROSE_SHARE = 0.25
#: Repeats from which on a phrase counts as a keyword of its page.
REPEATS = 3


def _class(s: str) -> tuple[int, str | None]:
    """(class, the content word in lower case or None) of one token."""
    c = s[0]
    if c == "\n":
        return _KIND["line"], None
    if len(s) > 1 and (c == "<" or "://" in s or s.startswith("www.")):
        return _KIND["link"], None
    if c == "#" and len(s) > 1:
        return _KIND["tag"], None
    if not c.isalnum():
        return _KIND[_MARK.get(s, "other")], None
    low = s.lower()
    if (w := _WORDS.get(low)) is not None:
        return w, None
    if s.isdigit():
        return _KIND["number"], None
    if any(ch.isdigit() for ch in s):
        return _KIND["mixed"], None
    return _KIND["capital" if c.isupper() else "lower"], low


class _Known(dict):
    """Classes of the tokens met so far; words recur, so most lookups are a dictionary's."""

    def __missing__(self, s: str) -> tuple[int, str | None]:
        got = _class(s)
        if len(self) < 500_000:
            self[s] = got
        return got


_KNOWN = _Known()


def classes(text: str) -> np.ndarray:
    """Class of each token, with an edge at either end. Text wholly in capitals counts as lower case."""
    if text.isupper():
        text = text.lower()
    edge, again = _KIND["edge"], _KIND["again"]
    out, recent, at = [edge], [""] * RECENT, 0
    for c, word in map(_KNOWN.__getitem__, _TOKEN.findall(text)):
        if word is not None:
            if word in recent:
                c = again
            recent[at % RECENT] = word
            at += 1
        out.append(c)
    out.append(edge)
    return np.array(out, dtype=np.int64)


def function_share(codes: np.ndarray) -> float:
    words = (codes <= _KIND["tag"]) & (codes != _KIND["edge"]) & (codes != _KIND["number"])
    return float((codes < len(_WORDS)).sum() / max(1, words.sum()))


def _trigrams(codes: np.ndarray) -> np.ndarray:
    padded = np.concatenate([[_KIND["edge"]], codes])
    return (padded[:-2] * N_CLASSES + padded[1:-1]) * N_CLASSES + padded[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of coded pages with their counts."""
    total: Counter[int] = Counter()
    for b in batches:
        grams = [_trigrams(np.frombuffer(c, dtype=_CODE).astype(np.int64)) for c in b.column(0).to_pylist()]
        if grams:
            k, n = np.unique(np.concatenate(grams), return_counts=True)
            total.update(dict(zip(k.tolist(), n.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])


class Model:
    """Interpolated trigram model from counts of trigrams."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        v = N_CLASSES
        order = np.argsort(gram)
        self.tri, self.n3 = gram[order], n[order].astype(float)
        self.pair, self.n2c = self._sum(self.tri // v, self.n3)  # contexts of two
        self.bi, self.n2 = self._sum(self.tri % (v * v), self.n3)
        self.one, self.n1c = self._sum(self.bi // v, self.n2)
        self.uni = np.bincount(self.tri % v, weights=self.n3, minlength=v) + 1.0
        self.uni /= self.uni.sum()

    @staticmethod
    def _sum(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, inverse = np.unique(key, return_inverse=True)
        return k, np.bincount(inverse, weights=n, minlength=len(k))

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(at))
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, values[i], 0.0)

    def surprise(self, codes: np.ndarray) -> float:
        """Mean bits of a token, the logarithm of the perplexity."""
        v, g = N_CLASSES, _trigrams(codes)
        p1 = self.uni[g % v]
        c1, c2 = self._get(self.one, self.n1c, (g // v) % v), self._get(self.pair, self.n2c, g // v)
        p2 = (self._get(self.bi, self.n2, g % (v * v)) + 5 * p1) / (c1 + 5)
        p3 = (self._get(self.tri, self.n3, g) + 5 * p2) / (c2 + 5)
        return float(-np.log2(p3).mean())


_RECORD = re.compile(
    r"\s*(?:[\[(]?\d{1,2}:\d\d|\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|(?:[\w.-]{1,80}: ?)?\[[^\]]{0,300}\]\s*$|[\w.-]{1,80}:\s*$|[\w.-]{1,80}\s?[=:]\s*\S+\s*$|\d+(?:\.\d+)+\s|#\s)"
)
_CELL = re.compile(r"[^,\s],(?=\S)")
_LEADER = re.compile(r"\.{4}\s{0,20}\d{1,6}\s{0,20}$")
_LINKED = re.compile(r"<a\s[^<>]{0,2000}>([^<]{0,500})</a>|\[([^\]\[\n]{0,300})\]\(\s{0,5}(?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+", re.I)


def _is_record(line: str) -> bool:
    """A line of a table, log, configuration or list of contents."""
    return bool(_RECORD.match(line)) or line.count("\t") >= 2 or len(_CELL.findall(line)) >= 3 or bool(_LEADER.search(line))


_TAG = re.compile(r"#[^\W\d]\w*")
_WORD = re.compile(r"[^\W\d_]+")


def stuffed_share(text: str) -> float:
    """Share of a text's words that stand in repeated keywords, links or tags."""
    text = text.lower()
    total = stuffed = 0
    lines: list[list[str]] = []
    for line in text.split("\n"):
        links = list(_LINKED.finditer(line))
        tags = _TAG.findall(line)
        if links or len(tags) > 1:
            inside = sum(len(_WORD.findall(re.sub(r"https?://|www\.|</?a[^>]*?href", " ", m[0]))) for m in links)
            rest = _TAG.sub(" ", _LINKED.sub(" ", line))
            inside += sum(max(1, len(_WORD.findall(t))) for t in tags)
            total += inside
            stuffed += inside
            words = _WORD.findall(rest)
        elif _is_record(line):
            total += len(_WORD.findall(line))
            continue
        else:
            words = _WORD.findall(line)
        total += len(words)
        if words:
            lines.append(words)
    if not total:
        return 0.0
    pairs: Counter[tuple[str, str]] = Counter()
    for w in lines:
        pairs.update(p for p in zip(w, w[1:]) if not (p[0] in _WORDS and p[1] in _WORDS))
    key = {p for p, n in pairs.items() if n >= REPEATS}
    for w in lines:
        hit = [False] * len(w)
        for i, p in enumerate(zip(w, w[1:])):
            if p in key:
                hit[i] = hit[i + 1] = True
        for i in range(1, len(w) - 1):  # a word or two between keywords, such as the town a keyword is put to
            if not hit[i] and hit[i - 1] and any(hit[i + 1 : i + 3]):
                hit[i] = True
        stuffed += sum(hit)
    return stuffed / total


_CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("function_share", T.DoubleType()), T.StructField("stuffed", T.DoubleType())])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as class codes, the only time their texts are read."""
    for b in batches:
        codes, share, stuffed = [], [], []
        for t in b.column(1).to_pylist():
            c = classes(t)
            codes.append(c.astype(_CODE).tobytes())
            share.append(function_share(c))
            stuffed.append(stuffed_share(t) if share[-1] < FAR_SHARE else 0.0)  # no other page can be spam
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(share, pa.float64()), pa.array(stuffed, pa.float64())], _CODED.names)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            bits = [model.surprise(np.frombuffer(c, dtype=_CODE).astype(np.int64)) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.float64()), b.column(2), b.column(3)], ["doc_id", "bits", "function_share", "stuffed"])

    return run


def scored(documents: DataFrame, low: float = 0.3, high: float = 0.75) -> DataFrame:
    """(doc_id, bits, function_share, stuffed, z): each page's surprise under the prose model, with its
    robust distance from the prose. low, high: shares of function words between which a page is prose."""
    spark = documents.sparkSession
    docs = documents.filter("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long"), "text")
    coded = cut(docs.mapInArrow(_code, _CODED))
    prose = coded.filter(F.col("function_share").between(low, high))
    counts = prose.select("codes").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most N_CLASSES cubed
    shared = spark.sparkContext.broadcast(Model(counts["gram"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("bits", "function_share", "stuffed"))])
    rows = cut(coded.mapInArrow(_score(shared), schema))
    reclaim(coded)
    prose = rows.filter(F.col("function_share").between(low, high))
    q = prose.agg(F.percentile_approx("bits", [0.25, 0.5, 0.75], 10_000).alias("q")).first()["q"] or [0.0, 0.0, 0.0]
    spread = max((q[2] - q[0]) / 1.349, 1e-6)
    return rows.withColumn("z", (F.col("bits") - q[1]) / spread)


def spam(documents: DataFrame) -> DataFrame:
    """(doc_id) of keyword-stuffed and link-list pages."""
    return scored(documents).filter((F.col("stuffed") > SPAM_SHARE) & (((F.abs("z") > WIDTH) & (F.col("function_share") < PROSE_SHARE)) | ((F.col("z") > FAR) & (F.col("function_share") < FAR_SHARE)))).select("doc_id").distinct()
