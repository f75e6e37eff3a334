"""Personal data with disguises: find identifiers in a normalised copy, report them in source characters.

Base detectors run on the text as it is. Then transducers rewrite a copy --
invisible characters vanish, homoglyphs and full-width forms become the ASCII
character they imitate, spelled digits become digits, bracketed or spaced
``at`` / ``dot`` become ``@`` / ``.`` -- and keep, for every character of the
copy, the source span it stands for. Detectors run on the copy, and a hit whose
source span differs from plain text is mapped back and added, unless it
overlaps a base span of its kind.

Offsets are code points, ends exclusive. Every scan is linear in the text.

Defined cases: a null text has no spans; rows with equal or null identifiers
are separate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_slices, pick, ship_package

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The contract's detectors.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters of other scripts that look like an ASCII character.
HOMOGLYPHS = dict(zip(
    "АВСЕНІЈКМОРЅТХУасеіјорѕхуԁһԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ" "ıɑɡ" "․‧。｡٫•·" "‐‑‒–—−﹣" "⁺﹢" "﹫",
    "ABCEHIJKMOPSTXYaceijopsxydhqw" "ABEZHIKMNOPTYXovp" "iag" "......." "-------" "++" "@",
    strict=True,
))
# Spelled digits of the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Spellings of the signs.
SIGN_WORDS = {"at": "@", "arroba": "@", "arobase": "@", "dot": ".", "punto": ".", "point": ".", "punkt": ".", "plus": "+", "dash": "-", "hyphen": "-", "minus": "-", "underscore": "_"}
INVISIBLE = set("­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿")

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_SIGN = "|".join(SIGN_WORDS)
#: A sign in brackets, with or without space around: (at), [ dot ], {@}, <.>
BRACKETED = re.compile(rf"[ \t]{{0,3}}{_OPEN}[ \t]{{0,2}}(?:({_SIGN})|([@.+_-]))[ \t]{{0,2}}{_CLOSE}[ \t]{{0,3}}", re.I)
_LABEL = r"[A-Za-z0-9-]"
_AT, _DOT = "at|arroba|arobase", "dot|punto|point|punkt"
#: `local at host dot tld`, the sign spelled or not: only the whole shape counts, as `at` is also a plain word.
SPACED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}((?:[ \t]+(?:{_DOT})[ \t]+{_LABEL}{{1,63}}){{0,4}})"
    rf"([ \t]+(?:{_AT}|@)[ \t]+|@[ \t]*|[ \t]+@){_LABEL}{{1,63}}"
    rf"((?:(?:[ \t]+(?:{_DOT})[ \t]+|\.){_LABEL}{{1,63}}){{0,8}}(?:[ \t]+(?:{_DOT})[ \t]+|\.)[A-Za-z]{{2,24}})(?![A-Za-z0-9-])",
    re.I,
)
_WORD_DIGITS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Runs of spelled digits (with digits and signs between): at least four tokens.
SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?:plus|\+)[ \t]*)?(?:(?:{_WORD_DIGITS}|[0-9]++)(?![^\W\d_])(?:[ \t]+(?:{_DOT}|dash|hyphen|minus)[ \t]+|[ \t,.()-]{{0,3}})){{4,}}", re.I
)
_SPELLED_PART = re.compile(rf"({_WORD_DIGITS})|(dot|point|punto|punkt)|(dash|hyphen|minus)|(plus)|([0-9])|([ \t,]+)|(.)", re.I | re.S)
_ANY_WORD = re.compile(rf"(?<![^\W\d_])(?:{_WORD_DIGITS})(?![^\W\d_])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(t: str) -> list[Span]:
    """Leftmost, non-overlapping: each ``@`` takes the whole run of local characters before it, back to the last hit's end."""
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL_END.match(t, start - 1):
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = t.find("@", last)
    return out


def ips(t: str) -> list[Span]:
    if t.count(".") < 3:
        return []
    return [m.span() for m in _runs(IP, t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]


def _runs(pattern: re.Pattern, t: str) -> Iterator[re.Match]:
    """Matches of a pattern that opens with a digit run: a failing start skips its whole run, so long runs cost linear time."""
    at, n = 0, len(t)
    while at < n:
        d = DIGITS.search(t, at)
        if not d:
            return
        m = pattern.match(t, d.start())
        if m:
            yield m
            at = m.end()
        else:
            at = d.start()
            while at < n and "0" <= t[at] <= "9":
                at += 1


def cards(t: str) -> list[Span]:
    out = []
    for m in CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(t: str) -> list[Span]:
    if "+" not in t:
        return []
    return [m.span() for m in PHONE.finditer(t) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(t: str) -> dict[str, list[Span]]:
    return {k: f(t) for k, f in DETECTORS.items()}


class Copy:
    """A rewritten text; character i stands for source characters ``at[i]`` to ``to[i]``."""

    def __init__(self, text: str, at: list[int] | range, to: list[int] | range):
        self.text, self.at, self.to = text, at, to

    def span(self, s: Span) -> Span:
        return self.at[s[0]], self.to[s[1] - 1]

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Copy:
        """Replace spans (rising, apart); every new character stands for its span's whole source."""
        if not edits:
            return self
        text, at, to, last = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a])
            at.extend(self.at[last:a])
            to.extend(self.to[last:a])
            if new:
                text.append(new)
                at.extend([self.at[a]] * len(new))
                to.extend([self.to[b - 1]] * len(new))
            last = b
        return Copy("".join(text), at, to)


def homoglyphs(c: Copy) -> Copy:
    """Look-alike, full-width and other compatibility digits and letters to ASCII; invisible characters away."""
    edits = []
    for i, ch in enumerate(c.text):
        if ch < "\x80":
            continue
        if ch in INVISIBLE:
            edits.append((i, i + 1, ""))
        elif ch in HOMOGLYPHS:
            edits.append((i, i + 1, HOMOGLYPHS[ch]))
        elif (d := unicodedata.decimal(ch, None)) is not None:
            edits.append((i, i + 1, str(d)))
        elif (n := unicodedata.normalize("NFKC", ch)) != ch and n.isascii() and n:
            edits.append((i, i + 1, n))
    return c.rewritten(edits)


def _low(word: str) -> str:
    """Lower case as the patterns compare it: a dotted capital I is one i."""
    return word.replace("İ", "i").lower()


def bracketed(c: Copy) -> Copy:
    return c.rewritten([(*m.span(), SIGN_WORDS[_low(m[1])] if m[1] else m[2]) for m in BRACKETED.finditer(c.text)])


def spaced(c: Copy) -> Copy:
    """``name at host dot tld``: the words of a whole address become signs."""
    edits = []
    for m in SPACED.finditer(c.text):
        for g in (1, 2, 3):
            for w in re.finditer(r"[ \t]*(?:[ \t](dot|punto|point|punkt|at|arroba|arobase)[ \t]|([@.]))[ \t]*", m[g], re.I):
                edits.append((m.start(g) + w.start(), m.start(g) + w.end(), SIGN_WORDS[_low(w[1])] if w[1] else w[2]))
    return c.rewritten(edits)


_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:[ \t]+(?:{_DOT})[ \t]+|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DOT_WORD = re.compile(r"[ \t]+[a-z]+[ \t]+", re.I)


def dotted(c: Copy) -> Copy:
    """``192 dot 168 dot 0 dot 1``."""
    return c.rewritten([(m.start() + w.start(), m.start() + w.end(), ".") for m in _DOTTED.finditer(c.text) for w in _DOT_WORD.finditer(m.group())])


def spelled(c: Copy) -> Copy:
    """Runs of spelled digits become digits; the spaces between them go."""
    edits = []
    for m in SPELLED.finditer(c.text):
        if not _ANY_WORD.search(m.group()):
            continue
        body = m.group().rstrip(" \t,.(-")
        for p in _SPELLED_PART.finditer(body):
            a, b = m.start() + p.start(), m.start() + p.end()
            if p[1]:
                edits.append((a, b, DIGIT_WORDS[_low(p[1])]))
            elif p[2] or p[3] or p[4]:
                edits.append((a, b, "." if p[2] else "-" if p[3] else "+"))
            elif p[6]:
                edits.append((a, b, ""))
    return c.rewritten(edits)


#: Characters beyond the letters of western European languages (ª and º count: they stand for a and o).
_STRANGE = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿŒœ¡¿«»]")
#: What every rewriting by ``spaced`` or ``dotted`` needs: a spelled dot or an @ next to white space, or `at` before a host.
_SIGNS = re.compile(rf"[ \t](?:(?:{_DOT})[ \t]|@|(?:{_AT})[ \t]+{_LABEL}+(?:\.{_LABEL}|[ \t]+(?:{_DOT})[ \t]))|@[ \t]", re.I)


def hints(t: str) -> tuple[bool, bool, bool]:
    """May the text hold odd characters, disguised signs, spelled digits? Each is a condition that its rewriting cannot do without."""
    signs = "[" in t or "(" in t or "{" in t or "<" in t
    signs = bool(signs and BRACKETED.search(t)) or bool(_SIGNS.search(t))
    return bool(_STRANGE.search(t)), signs, bool(_ANY_WORD.search(t))


class Cover:
    """Spans of which none lies in another, by start and so by end; tells whether a span lies in one of them."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for s in spans:
            self.add(s)

    def __contains__(self, span: Span) -> bool:
        i = bisect_right(self.starts, span[0]) - 1
        return i >= 0 and self.ends[i] >= span[1]

    def add(self, span: Span) -> None:
        if span in self:
            return
        lo, hi = bisect_left(self.starts, span[0]), bisect_right(self.ends, span[1])
        hi = max(lo, hi)  # those between lie in the new span
        self.starts[lo:hi], self.ends[lo:hi] = [span[0]], [span[1]]


def disguised(t: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised copies show; one that lies in a span of its kind adds nothing."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    strange, signs, digits = hints(t)
    if not (strange or signs or digits):
        return out
    copies = [Copy(t, range(len(t)), range(1, len(t) + 1))]
    if strange:
        copies.append(homoglyphs(copies[0]))
        _, signs, digits = hints(copies[-1].text)
    plain = copies[-1]
    if signs:
        copies.append(dotted(spaced(bracketed(plain))))
    if digits:
        copies.append(spelled(plain))
        if signs:
            copies.append(spelled(bracketed(plain)))
    seen = {k: Cover(v) for k, v in base.items()}
    for copy in copies[1:]:
        if copy.text == t:
            continue
        for kind, spans in detect(copy.text).items():
            for s in spans:
                a, b = copy.span(s)
                if t[a:b] != copy.text[s[0] : s[1]] and (a, b) not in seen[kind]:
                    out[kind].append((a, b))
                    seen[kind].add((a, b))
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans`` (base and added) and ``n_added`` of every document."""
    ship_package(docs.sparkSession)
    rows = docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = {k: [] for k in KINDS}
        for part, _ in doc_slices(batches, "t"):
            cols: list[list] = [[] for _ in range(7)]
            for text in part["t"].to_pylist():
                base = detect(text) if text else nothing
                more = disguised(text, base) if text else nothing
                every = {k: base[k] + more[k] for k in KINDS}
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, more.values()))]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    schema = rows.drop("t").schema
    for c in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(find, schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long"))
