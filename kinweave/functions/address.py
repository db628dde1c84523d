"""A reader of postal address lines, for lines that no fixed grammar covers.

Plain Python on one line at a time; operators run it inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

# Street types and the ways they are shortened.
STREET_TYPES = {
    "alley": "aly ally", "avenue": "ave av aven avenu avn avnue", "boulevard": "blvd boul boulv bvd blv", "circle": "cir circ crcl", "close": "cl clo",
    "court": "ct crt", "crescent": "cres crsnt", "cross": "", "drive": "dr drv driv", "gardens": "gdns gdn", "grove": "grv gr", "highway": "hwy hiway hiwy hway highwy",
    "lane": "ln la", "parkway": "pkwy pky pkway parkwy prkwy", "place": "pl plc", "plaza": "plz", "road": "rd", "route": "rte", "row": "", "square": "sq sqr sqre squ",
    "street": "st str strt", "terrace": "ter terr tce", "trail": "trl tr", "walk": "wlk", "way": "wy",
}
# Directions, ordinals, unit words, and short forms in names of towns.
DIRECTIONS = {"north": "n no", "south": "s so", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]
UNIT_WORDS = "apartment|apartmt|appartment|apmt|aptmt|apt|unit|suite|ste|room|rm|flat|floor|fl|number|numb|nbr|num|no|nr|#|door|lot|office|ofc"
TOWN_WORDS = {"st": "saint", "ste": "saint", "mt": "mount", "mnt": "mount", "ft": "fort", "pt": "port", "prt": "port", "lk": "lake", "north": "n", "new": "n", "nw": "n", "s": "south", "e": "east", "w": "west"}

_TYPE = {w: t for t, ws in STREET_TYPES.items() for w in (t, *ws.split())}
_DIR = {w: d for d, ws in DIRECTIONS.items() for w in (d, *ws.split()) if w not in ("no", "so")}
_ORD = {w: str(i + 1) for i, w in enumerate(ORDINALS)}
_UNIT = re.compile(rf"(?<![a-z0-9])(?:(?:{UNIT_WORDS})(?![a-z])[\s.:]*)+(?:#[\s.]*)?(\d+[\s-]?[a-z]?|[a-z][\s-]?\d*)(?![a-z0-9])")
_SLASH = re.compile(r"^\s*(\d+\s?-?\s?[a-z]?)\s*/\s*(\d+)(?=\s)")
_CARE = re.compile(r"^\s*(?:c/o|care of|attn\.?|attention|z\.?\s?hd\.?)\s[^,]*,")
_ORDNUM = re.compile(r"^(\d+)(?:st|nd|rd|th)$")
_TAIL_POSTAL = re.compile(r"[\s,]+(\d{5})(?:-\d{4})?[\s.]*$")
_TAIL_REGION = re.compile(r",\s*([a-z]{2})[\s.]*$")
_TAIL_REGION_LOOSE = re.compile(r"\s([a-z]{2})[\s.]*$")
_TOKEN = re.compile(r"[a-z0-9']+")
_POBOX = re.compile(r"\b(?:p\.?\s*o\.?\s*box|post\s*office\s*box|postbox|po\s*bx|locked bag|pmb)\b")

#: What a line must hold for _POBOX to be worth a try; most lines hold none.
_BOXES = ("box", "bx", "bag", "pmb")


class Address(NamedTuple):
    number: str | None
    street: str | None  # name alone: no type, no direction
    kind: str | None  # street type, written out
    direction: str | None
    unit: str | None
    town: str | None
    region: str | None
    postal: str | None


NOTHING = Address(*[None] * 8)


def plain(s: str | None) -> str:
    if not s:
        return ""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", s.lower()).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in s if not unicodedata.combining(c))


@lru_cache(maxsize=20000)
def town_norm(s: str | None) -> str | None:
    """A town's name with its short words written out; n. may be short for either north or new, so both become n."""
    words = _TOKEN.findall(plain(s).replace("'", ""))
    if not words:
        return None
    if len(words) > 1:
        words[:-1] = [TOWN_WORDS.get(w, w) for w in words[:-1]]
    return " ".join(words)


def _unit(m: str) -> str:
    return re.sub(r"[\s-]", "", m)


def parse(line: str | None, towns: Towns | None = None) -> Address:
    """Parts of one address line; all None where no house number with a street is found.

    towns: names of towns that may end a line without a comma before them.
    """
    s = plain(line)
    if not s or any(w in s for w in _BOXES) and _POBOX.search(s):
        return NOTHING
    if s.lstrip()[:1] in ("c", "a", "z"):
        s = _CARE.sub(" ", s)
    unit = town = region = postal = number = None
    if "/" in s and (m := _SLASH.match(s)):
        unit, s = _unit(m[1]), s[m.start(2):]
    if s.rstrip(" .\t\n\r\x0b\x0c")[-1:].isdigit() and (m := _TAIL_POSTAL.search(s)):
        before = s[: m.start()]
        if re.search(r"[a-z]", before) and re.search(r"\d", before):
            postal, s = m[1], before
    if m := _TAIL_REGION.search(s) or (_TAIL_REGION_LOOSE.search(s) if postal or s.count(",") else None):
        if m[1] not in _TYPE and m[1] not in _DIR:
            region, s = m[1], s[: m.start()]
    if m := list(_UNIT.finditer(s)):
        m = m[-1] if len(m) > 1 else m[0]
        rest = s[: m.start()] + " , " + s[m.end() :]
        if re.search(r"[a-z]{2}", rest):
            unit, s = _unit(m[1]), rest
    parts = [p for p in ([*_TOKEN.findall(x.replace("'", ""))] for x in s.split(",")) if p]
    for p in [p for p in parts if len(p) == 2 and len(p[0]) == 2 and p[0].isalpha() and len(p[1]) == 5 and p[1].isdigit() and len(parts) > 1]:
        region, postal = region or p[0], postal or p[1]  # region and postal code before the street
        parts.remove(p)
    if not parts:
        return NOTHING
    # the part with the street: the first that has a house number and a word, or the first with a word
    at = next((i for i, p in enumerate(parts) if any(t.isdigit() for t in p) and any(not t[0].isdigit() for t in p)), None)
    if at is None:
        nums = [i for i, p in enumerate(parts) if len(p) == 1 and p[0].isdigit()]
        at = next((i for i, p in enumerate(parts) if not p[0].isdigit()), None)
        if at is None:
            return Address(None, None, None, None, unit, None, region, postal)
        if nums:
            parts[at] = parts[nums[0]] + parts[at]
            parts.pop(nums[0])
            at -= nums[0] < at
    words, after = parts[at], [w for p in parts[at + 1 :] for w in p]
    if words[0].isdigit() or re.fullmatch(r"\d+[a-z]", words[0]):
        number, words = words[0], words[1:]
    else:
        k = next((i for i in range(len(words) - 1, -1, -1) if words[i].isdigit()), None)
        if k is not None:
            number = words[k]
            after = words[k + 1 :] + after
            words = words[:k]
    if words and not after and towns:  # a town that nothing separates from the street
        for n in (3, 2, 1):
            if len(words) > n and (cut := near_town(" ".join(words[-n:]), towns)) and (n > 1 or len(words) > 2 or words[-1] not in _TYPE):
                if any(w in _TYPE for w in words[:-n]):
                    after, words = [cut], words[:-n]
                    break
    if after:
        town = town_norm(" ".join(after))
    elif at and towns:  # a town before the street
        town = next((t for p in parts[:at] if len(p) <= 3 and (t := near_town(" ".join(p), towns)) in towns), None)
    lead = trail = None
    if len(words) > 1 and words[0] in _DIR:
        lead, words = _DIR[words[0]], words[1:]
    if len(words) > 1 and words[-1] in _DIR:
        trail, words = _DIR[words[-1]], words[:-1]
    kind = None
    if len(words) > 1 and words[-1] in _TYPE:
        kind, words = _TYPE[words[-1]], words[:-1]
    elif len(words) > 2:  # words behind the type: a town that isn't known
        k = next((i for i in range(len(words) - 1, 0, -1) if words[i] in _TYPE), None)
        if k and k < len(words) - 1:
            rest = words[k + 1 :]
            if rest[0] in _DIR and len(rest) == 1:
                trail = _DIR[rest[0]]
            elif town is None:
                town = town_norm(" ".join(rest))
            kind, words = _TYPE[words[k]], words[:k]
    if len(words) > 1 and words[-1] in _DIR and not trail:
        trail, words = _DIR[words[-1]], words[:-1]
    if len(words) > 1 and words[0] in _DIR and not lead:
        lead, words = _DIR[words[0]], words[1:]
    names = []
    for w in words:
        m = _ORDNUM.match(w)
        names.append(m[1] + "th" if m else _ORD[w] + "th" if w in _ORD and len(words) > 1 else w)
    street = " ".join(names) or None
    return Address(number, street, kind, lead or trail, unit, town, region, postal)


class Towns:
    """Names of towns by first letter and length, for looking up a name with a slip or two."""

    def __init__(self, names: Iterable[str]) -> None:
        self.names = frozenset(names)
        self._like: dict[tuple[str, int], list[str]] = {}
        for t in sorted(self.names):
            self._like.setdefault((t[0], len(t)), []).append(t)

    def __contains__(self, t: object) -> bool:
        return t in self.names

    def __len__(self) -> int:
        return len(self.names)

    def near(self, t: str) -> str | None:
        """The town fewest slips away, two at most; ties to the smaller name."""
        best = min(((d, x) for n in range(len(t) - 2, len(t) + 3) for x in self._like.get((t[0], n), ()) if (d := slips(x, t, 2)) <= 2), default=None)
        return best and best[1]


def near_town(s: str, towns: Towns) -> str | None:
    """The town of this name, or the one town a slip or two away from it."""
    t = town_norm(s)
    if t is None or t in towns:
        return t
    return towns.near(t) if len(t) >= 5 else None


def slips(a: str, b: str, most: int = 2) -> int:
    """Edits between two strings, a swap of neighbours counting one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        d = len(a) + len(b)
        return d if d <= most else most + 1
    far = most + 1
    two, one = None, [min(y, far) for y in range(len(b) + 1)]
    for x in range(1, len(a) + 1):  # only cells within ``most`` of the diagonal can matter
        row = [min(x, far)] + [far] * len(b)
        for y in range(max(1, x - most), min(len(b), x + most) + 1):
            c = a[x - 1] != b[y - 1]
            v = min(one[y] + 1, row[y - 1] + 1, one[y - 1] + c)
            if two and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                v = min(v, two[y - 2] + 1)
            row[y] = v
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1] if one[-1] <= most else most + 1
