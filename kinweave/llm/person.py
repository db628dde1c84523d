"""Whether two records describe one person: evidence of each attribute, added up.

The evidence is worked out twice: once for whole arrays of pairs from codes of the values, as a
lower and an upper bound, and, only where the bounds fall on both sides of the threshold, value
by value with tolerance for slips, nicknames, initials, cut names and swapped parts.
"""

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinweave.functions.address import slips
from kinweave.operators.contents import GAP

# Given names and their short or pet forms in English.
NICKNAMES = {
    "abigail": "abby abbie gail", "albert": "al bert bertie", "alexander": "alex alec sandy xander lex sasha", "amelia": "amy millie", "andrew": "andy drew", "anthony": "tony ant",
    "arthur": "art artie", "augustus": "gus augie", "barbara": "barb babs", "bartholomew": "bart barty", "benjamin": "ben benny benji", "bernard": "bernie", "catherine": "cathy cath",
    "charles": "charlie chuck chas chip", "christopher": "chris kit topher", "cornelius": "neil con", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dolores": "lola dolly",
    "donald": "don donnie", "dorothy": "dot dottie dolly dory", "edward": "ed eddie ted teddy ned", "eleanor": "nell ellie nora nellie", "elizabeth": "liz lizzie beth betty bess eliza libby betsy lisa",
    "emily": "em emmy", "eugene": "gene", "florence": "flo florrie", "frances": "fran frankie", "francisco": "paco pancho cisco frank", "francis": "frank", "frederick": "fred freddie freddy fritz rick",
    "friederike": "rike fritzi", "gabriel": "gabe", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "helen": "nell nellie", "henry": "harry hank hal", "isabella": "bella izzy isabel",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "jonathan": "jon jonny jonathon", "john": "johnny jack", "joseph": "joe joey jo", "josephine": "jo josie", "judith": "judy",
    "katherine": "kate kathy katie kat kitty kathryn", "kenneth": "ken kenny", "lawrence": "larry laurie lars", "leonard": "len lenny leo", "louis": "lou louie", "margaret": "maggie meg peggy marge greta margie", "martin": "marty",
    "matthew": "matt matty", "mikhail": "misha mischa", "maximilian": "max", "michael": "mike mick mickey mikey", "nathaniel": "nat nate nathan", "nicholas": "nick nicky nico", "patricia": "pat patty tricia trish patsy", "patrick": "pat paddy rick",
    "penelope": "penny", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob bobby rob robbie bert robt", "ronald": "ron ronnie", "samuel": "sam sammy",
    "sebastian": "seb bastian", "stephen": "steve stevie steven", "susannah": "sue susie suzy susan", "theodore": "ted teddy theo", "theodora": "theo dora", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky vic tori vicki",
    "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally", "wilfred": "wilf fred", "wilhelmina": "willa mina minnie billie", "william": "will bill billy willy liam wm", "zachary": "zach zack",
}
SUFFIXES = frozenset("jr sr ii iii iv junior senior mr mrs ms dr prof esq phd md".split())
_FULL: dict[str, frozenset[str]] = {}
for _n, _s in NICKNAMES.items():
    for _w in _s.split():
        _FULL[_w] = _FULL.get(_w, frozenset()) | {_n}

#: Evidence for (agree, near, differ) of each attribute, in about bits.
EVIDENCE = {
    "email": (7.0, 7.0, -0.3), "phone": (4.5, 4.5, -0.3), "birth": (6.0, 2.5, -12.0), "given": (3.0, 2.2, -12.0), "family": (3.5, 2.5, -2.0), "door": (4.5, 4.0, -0.2), "town": (0.8, 0.8, -0.2),
}
INITIAL = 1.0
THRESHOLD = 9.0
COLUMNS = ["given", "family", "email", "phone", "birth", "number", "street", "unit", "town", "postal"]


@lru_cache(maxsize=200_000)
def tokens(s: str | None) -> tuple[str, ...]:
    return tuple(t for t in s.split() if t not in SUFFIXES) if s else ()


@lru_cache(maxsize=200_000)
def canon_given(s: str | None) -> str | None:
    """The first full given name with pet forms written out where they stand for one name only."""
    ts = [t for t in tokens(s) if len(t) > 1] or list(tokens(s))
    if not ts:
        return None
    full = _FULL.get(ts[0])
    return next(iter(full)) if full and len(full) == 1 and ts[0] not in NICKNAMES else ts[0]


@lru_cache(maxsize=400_000)
def token_alike(a: str, b: str) -> float:
    """1 equal or pet form, 0.9 and 0.8 a slip or two, 0.75 cut short, 0.6 initial, 0 otherwise."""
    if a == b or b in _FULL.get(a, ()) or a in _FULL.get(b, ()) or _FULL.get(a, frozenset()) & _FULL.get(b, frozenset()):
        return 1.0
    n = min(len(a), len(b))
    if n == 1:
        return 0.6 if a[0] == b[0] else 0.0
    d = slips(a, b, 2)
    if d == 1 and n >= 3 or d == 2 and n >= 5:
        return 1.0 - d / 10
    if n >= 2 and (a.startswith(b) or b.startswith(a)):
        return 0.75
    if n >= 5 and any(slips(x, f, 1) <= 1 for x, y in ((a, b), (b, a)) for f in _FULL.get(y, ())):
        return 0.8
    return 0.0


def monge_elkan(a: Sequence[str], b: Sequence[str]) -> float:
    """Mean over the tokens of the shorter name of the best likeness in the other; 0 if either is empty."""
    if len(a) > len(b):
        a, b = b, a
    return sum(max(token_alike(x, y) for y in b) for x in a) / len(a) if a else 0.0


def _best(a: Sequence[str], b: Sequence[str]) -> float | None:
    a, b = [t for t in a if len(t) > 1] or a, [t for t in b if len(t) > 1] or b
    return max((token_alike(x, y) for x in a for y in b), default=None)


#: A name of more words than this is compared as a whole.
MOST_WORDS = 40


@lru_cache(maxsize=400_000)
def name_alike(ga: str | None, fa: str | None, gb: str | None, fb: str | None) -> tuple[float | None, float | None]:
    """(likeness of given names, of family names), None where a side has none; swapped parts and
    names written whole into one field are taken apart."""
    a1, a2, b1, b2 = tokens(ga), tokens(fa), tokens(gb), tokens(fb)
    if max(map(len, (a1, a2, b1, b2))) > MOST_WORDS:
        return (None if not a1 or not b1 else float(a1 == b1)), (None if not a2 or not b2 else float(a2 == b2))
    g, f = _best(a1, b1), _best(a2, b2)
    if (g is None or g < 0.7) or (f is None or f < 0.7):
        g2, f2 = _best(a1, b2), _best(a2, b1)
        if g2 is not None and f2 is not None and min(g2, f2) >= 0.6 and g2 + f2 > (g or 0) + (f or 0):
            return g2, f2
        whole = [(a1, b1 + b2)] if not a2 and len(a1) > 1 else [(b1, a1 + a2)] if not b2 and len(b1) > 1 else [(a2, b1 + b2)] if not a1 and len(a2) > 1 else [(b2, a1 + a2)] if not b1 and len(b2) > 1 else []
        for x, y in whole:
            hits = sorted((max(token_alike(t, u) for u in y) for t in x), reverse=True) if y else []
            if len(hits) > 1 and hits[1] >= 0.6:
                return hits[0], hits[1]
            if hits and hits[0] >= 0.75:  # one of several words fits, the other side has no second
                return (hits[0], None)
            return (0.0 if y else None), None
    return g, f


def _graded(kind: str, s: float | None) -> float:
    if s is None:
        return 0.0
    yes, near, no = EVIDENCE[kind]
    return yes if s >= 0.95 else near if s >= 0.7 else INITIAL if s >= 0.55 else no


@lru_cache(maxsize=100_000)
def birth_alike(a: str | None, b: str | None) -> float | None:
    if not a or not b:
        return None
    if a == b:
        return 1.0
    near = slips(a, b, 1) <= 1 or a[:4] == b[:4] and a[5:7] == b[8:] and a[8:] == b[5:7]
    return 0.8 if near else 0.0


def evidence(a: Sequence, b: Sequence) -> float:
    """Evidence that two records, as tuples of COLUMNS, describe one person."""
    g, f = name_alike(a[0], a[1], b[0], b[1])
    out = _graded("given", g) + _graded("family", f) + _graded("birth", birth_alike(a[4], b[4]))
    for i, kind in ((2, "email"), (3, "phone")):
        if a[i] and b[i]:
            out += EVIDENCE[kind][0 if a[i] == b[i] else 2]
    if a[6] and b[6]:
        door = a[5] == b[5] and (a[7] == b[7] or not a[7] or not b[7]) and slips(a[6], b[6], 2) <= 2
        out += EVIDENCE["door"][0 if door else 2]
    where = (a[9] == b[9]) if a[9] and b[9] else (slips(a[8], b[8], 2) <= 2) if a[8] and b[8] else None
    if where is not None:
        out += EVIDENCE["town"][0 if where else 2]
    return out


_ISO = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_POP = np.array([bin(i).count("1") for i in range(1 << 13)], dtype=np.int8)


@lru_cache(maxsize=200_000)
def _letters(s: str | None) -> int:
    return sum({1 << (ord(c) - 97) for c in s if "a" <= c <= "z"}) if s else 0


def _unlike_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that only one of two words has; two slips make four at most."""
    x = a ^ b
    return _POP[x & 0x1FFF] + _POP[x >> 13]


@lru_cache(maxsize=400_000)
def _half(name: str | None, given: bool) -> tuple:
    """What the bounds need to know of a given or family name, in the order of _Half.KINDS."""
    ts = tokens(name)
    words = [t for t in ts if len(t) > 1] or ts
    one = words[0] if words else ""
    full = canon_given(name) if given else " ".join(ts) or None
    pet = one in _FULL and len(one) >= 5
    initial = ord(one[0]) if one else 0
    return full, len(words) > 1, len(ts) > 1, len(ts) > MOST_WORDS, one in _FULL or one in NICKNAMES, pet, pet and one == full, len(one), _letters(one), _letters(full), initial


class _Half:
    """The given or the family names of a block as arrays, a place for each distinct name."""

    #: many: any of the words may fit; two: may be a whole name; pet: a pet form that a slip of its full name fits,
    #: for given names only where it stands for several (unsure).
    KINDS = {"many": bool, "two": bool, "huge": bool, "known": bool, "pet": bool, "unsure": bool, "size": np.int32, "letters": np.int32, "full": np.int32, "initial": np.int32}

    def __init__(self, names: list[str | None], given: bool) -> None:
        fulls, *rest = zip(*(_half(s, given) for s in names))
        number = {None: -1}
        self.code = np.array([number.setdefault(f, len(number)) for f in fulls], dtype=np.int64)
        for (kind, dtype), values in zip(self.KINDS.items(), rest):
            setattr(self, kind, np.array(values, dtype=dtype))


def _distinct(col: pa.ChunkedArray) -> tuple[list[str | None], np.ndarray]:
    """(distinct values with None last, each row's place among them)."""
    d = col.combine_chunks().dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return [*d.dictionary.to_pylist(), None], pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """Records as columns of codes, for bounds over many pairs at once."""

    def __init__(self, table: pa.Table) -> None:
        # packed values, where there are any, are taken apart for the few rows that need it
        self.packed = table.column("v") if "v" in table.column_names else pc.binary_join_element_wise(*(pc.fill_null(table.column(c), "") for c in COLUMNS), GAP)
        self.codes = {c: self._code(table.column(c)) for c in ("email", "phone", "postal", "number")}
        halves = {}
        for kind in ("given", "family"):
            values, at = _distinct(table.column(kind))
            halves[kind] = {k: v[at] for k, v in vars(_Half(values, kind == "given")).items()}
        each = lambda k: {kind: h[k] for kind, h in halves.items()}
        self.codes |= each("code")
        self.many, self.two, self.known, self.pet, self.size, self.letters, self.initial = map(each, ("many", "two", "known", "pet", "size", "letters", "initial"))
        self.letters["full"], self.unsure = halves["given"]["full"], halves["given"]["unsure"]
        self.huge = halves["given"]["huge"] | halves["family"]["huge"]
        self.codes["door"] = self._code(pc.binary_join_element_wise(table.column("number"), table.column("street"), pc.fill_null(table.column("unit"), ""), "|"))
        values, at = _distinct(table.column("street"))
        self.letters["street"] = np.array([_letters(s) for s in values], dtype=np.int32)[at]
        self.street = np.array([bool(s) for s in values], dtype=bool)[at]
        values, at = _distinct(table.column("birth"))
        self.codes["birth"] = np.where(at == len(values) - 1, -1, at)
        self.odd = np.array([d is not None and not _ISO.fullmatch(d) for d in values], dtype=bool)[at]
        day = [(d.replace("-", "") + "        ")[:8] if d else " " * 8 for d in values]
        self.digits = np.frombuffer("".join(day).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(day), 8)[at]

    @staticmethod
    def _code(col: pa.ChunkedArray) -> np.ndarray:
        d = col.combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _may(self, kind: str, i: np.ndarray, other: str, j: np.ndarray) -> np.ndarray:
        """Whether a word of one half of a name may be alike to one of another half; never false where token_alike isn't 0."""
        x, y, m, n = self.letters[kind][i], self.letters[other][j], self.size[kind][i], self.size[other][j]
        may = (_unlike_letters(x, y) <= np.where(np.minimum(m, n) >= 5, 4, 2)) & (np.abs(m - n) <= 2)
        may |= (self.initial[kind][i] == self.initial[other][j]) & (((x & y) == x) | ((x & y) == y))  # initial or cut short
        may |= (self.known[kind][i] & self.known[other][j]) | self.many[kind][i] | self.many[other][j]
        if kind == other == "given":
            return may | (_unlike_letters(self.letters["full"][i], self.letters["full"][j]) <= 2) | self.unsure[i] | self.unsure[j]
        return may | self.pet[kind][i] | self.pet[other][j]

    def _name_bounds(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most evidence of the names."""
        have = {k: self.codes[k] >= 0 for k in ("given", "family")}
        # a half left out beside a whole name in the other
        whole = np.zeros(len(i), dtype=bool)
        for x in (i, j):
            whole |= (~have["family"][x] & self.two["given"][x]) | (~have["given"][x] & self.two["family"][x])
        swapped = self._may("given", i, "family", j) & self._may("family", i, "given", j)
        low, high = np.zeros(len(i)), np.zeros(len(i))
        for kind in ("given", "family"):
            yes, _, no = EVIDENCE[kind]
            both, same = have[kind][i] & have[kind][j], self.codes[kind][i] == self.codes[kind][j]
            may = same | whole | swapped | self._may(kind, i, kind, j)
            low += np.where(both, np.where(same & ~self.huge[i] & ~self.huge[j], yes, no), np.where(whole, no, 0))
            high += np.where(both, np.where(may, yes, no), np.where(whole, yes, 0))
        return low, high

    def _other_bounds(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most evidence of all but the names."""
        base = np.zeros(len(i))
        for kind in ("email", "phone"):
            a, b = self.codes[kind][i], self.codes[kind][j]
            base += np.where((a >= 0) & (b >= 0), np.where(a == b, EVIDENCE[kind][0], EVIDENCE[kind][2]), 0)
        a, b = self.codes["birth"][i], self.codes["birth"][j]
        yes, some, no = EVIDENCE["birth"]
        both, same = (a >= 0) & (b >= 0), a == b
        low = base + np.where(both, np.where(same, yes, no), 0)
        high = low.copy()
        other = np.flatnonzero(both & ~same)
        x, y = self.digits[i[other]], self.digits[j[other]]
        differ = x != y
        n = differ.sum(axis=1)
        near = n <= 1
        for p in (0, 1, 2, 4, 6):  # neighbours swapped; the others have a hyphen between them
            near |= (n == 2) & differ[:, p] & differ[:, p + 1] & (x[:, p] == y[:, p + 1]) & (x[:, p + 1] == y[:, p])
        near |= ((x[:, :4] == y[:, :4]).all(axis=1) & (x[:, 4:6] == y[:, 6:]).all(axis=1) & (x[:, 6:] == y[:, 4:6]).all(axis=1))
        odd = self.odd[i[other]] | self.odd[j[other]]  # a digit lost or put in, say
        low[other[near & ~odd]] += some - no
        high[other[near | odd]] += some - no
        a, b = self.codes["door"][i], self.codes["door"][j]
        both, same = (a >= 0) & (b >= 0), a == b
        like = (self.codes["number"][i] == self.codes["number"][j]) & (_unlike_letters(self.letters["street"][i], self.letters["street"][j]) <= 4)
        yes, _, no = EVIDENCE["door"]
        known = self.street[i] & self.street[j]
        low += np.where(known, np.where(both & same, yes, no), 0)
        high += np.where(known, np.where(same & both | like, yes, no), 0)
        a, b = self.codes["postal"][i], self.codes["postal"][j]
        known = (a >= 0) & (b >= 0)
        low += np.where(known & (a == b), EVIDENCE["town"][0], EVIDENCE["town"][2])
        high += np.where(known, np.where(a == b, EVIDENCE["town"][0], EVIDENCE["town"][2]), EVIDENCE["town"][0])
        return low, high

    def bounds(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Evidence that each pair has at least and at most."""
        low, high = self._other_bounds(i, j)
        lo, hi = self._name_bounds(i, j)
        return low + lo, high + hi

    def scores(self, i: np.ndarray, j: np.ndarray, least: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the pairs with enough evidence, their evidence)."""
        low, high = self._other_bounds(i, j)
        may = np.flatnonzero(high + EVIDENCE["given"][0] + EVIDENCE["family"][0] >= least)  # like names could still suffice
        i, j = i[may], j[may]
        lo, hi = self._name_bounds(i, j)
        low, high = low[may] + lo, high[may] + hi
        sure = low >= least
        ask = np.flatnonzero(~sure & (high >= least))
        exact = np.zeros(0)
        if len(ask):
            rows = np.unique(np.concatenate([i[ask], j[ask]]))
            pick = {x: v.split(GAP) for x, v in zip(rows.tolist(), self.packed.take(pa.array(rows)).to_pylist())}
            exact = np.array([evidence(pick[x], pick[y]) for x, y in zip(i[ask].tolist(), j[ask].tolist())])
        out = low
        out[ask] = exact
        hit = np.flatnonzero(out >= least)
        return may[hit], out[hit]


def confidence(score: float) -> float:
    """Evidence as a probability: half at the threshold less two bits."""
    return 1.0 / (1.0 + 2.0 ** -(score - THRESHOLD + 2.0))


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        if len(b):
            yield pa.Table.from_batches([b])
