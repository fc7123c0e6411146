"""Personal data in plain and in disguised form, as spans of the source text.

A small transducer reads the text once and writes a normal form together with the source
position of every character it wrote: look-alike letters and digits, spelled digits, and
disguised at signs and dots.  The same detectors run on both forms, and what they find in the
normal form is carried back through the positions.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.common import rows_with

KINDS = ("email", "ip", "card", "phone")

# The forms of the identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins, so nothing is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Look-alikes of Latin letters in Cyrillic and Greek, and words for digits.
HOMOGLYPHS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονια",
        "ABESIJKMHOPCTYXaeijopcyxsdqwABEZHIKMNOPTYXovia",
        strict=True,
    )
)
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
}
AT = re.compile(r"\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}", re.I)
DOT = re.compile(r"\s{0,2}[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s{0,2}", re.I)
#: Without brackets only whole addresses are taken: a bare "at" needs a bare "dot" after it.
BARE = re.compile(
    r"(?<![\w.%+-])(?:[\w%+-]{1,64} dot ){0,3}[\w.%+-]{1,64}(?:@| at (?=[\w.-]{1,255} dot ))"
    r"[\w-]{1,63}(?:(?: dot |\.)[\w-]{1,63}){1,8}(?![\w-])",
    re.I,
)
WORD = "|".join(DIGIT_WORDS)
DIGIT = rf"(?:{WORD}|[0-9])(?!\w)"
#: Runs of digits and words for digits; commas stand only between single ones.
SPELLED = re.compile(
    rf"(?<!\w)(?:(?:plus|\+) ?)?(?:{WORD}|[0-9]++)(?!\w)(?:[ -]{{1,2}}(?:{WORD}|[0-9]++)(?!\w)|(?<![0-9][0-9])[ ,-]{{1,2}}{DIGIT})+", re.I
)
SPELLED_LEAST = 7
#: One number of an address of four: a run of digits, or up to three digits with a word among them.
NUMBER = (
    rf"(?:[0-9]{{1,3}}(?!\w)|{DIGIT}|(?=(?:[0-9]{{1,2}}[ ,-]{{1,2}}){{0,2}}(?:{WORD})(?!\w))"
    rf"(?:{DIGIT}(?:[ ,-]{{1,2}}{DIGIT}){{1,2}}|[0-9]{{2}}[ ,-]{{1,2}}{DIGIT}|{DIGIT}[ ,-]{{1,2}}[0-9]{{2}}(?!\w)))"
)
DOTTED = re.compile(rf"(?<![\w.]){NUMBER}(?:(?: dot |\.){NUMBER}){{3}}", re.I)
LETTER = re.compile("[a-z]", re.I)
SPELLED_PART = re.compile(rf"(plus ?)|({WORD})|([ ,-]{{1,2}}(?={WORD}|[0-9]))", re.I)
DOTTED_PART = re.compile(rf"( dot )|({WORD})|([ ,-]{{1,2}}(?={WORD}|[0-9]))", re.I)
HINTS = re.compile(r"[\[({<]\s?(?:at|@|dot|punkt|point|punto|\.)\s?[\])}>]| dot \w", re.I)
DIGIT_WORD = re.compile(WORD, re.I)


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            free = domain.end()
            found.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1)
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end (exclusive) and kind of every plain identifier, by start, then kind."""
    found = [(*span, "email") for span in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((*m.span(), "card"))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


ALIKE: dict[str, str] = dict(HOMOGLYPHS)


def alike(character: str) -> str:
    """The ASCII character that ``character`` looks like, else itself."""
    if character not in ALIKE:
        plain = unicodedata.normalize("NFKC", character)
        digit = unicodedata.digit(character, None)
        looks = len(plain) == 1 and plain.isascii()
        ALIKE[character] = plain if looks else character if digit is None else str(digit)
    return ALIKE[character]


class Transducer:
    """Texts as parts: each copies a range of the source or writes something else for it."""

    def __init__(self, text: str):
        self.out: list[str] = list(text)
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replace what ``pattern`` matches; a replacement stands for all of its source."""
        text, out, starts, ends, at = self.text(), [], [], [], 0
        for m in pattern.finditer(text):
            new = write(m)
            if new is None:
                continue
            low, high = m.span()
            out += self.out[at:low]
            starts += self.starts[at:low]
            ends += self.ends[at:low]
            out += new
            starts += [self.starts[low]] * len(new)
            ends += [self.ends[high - 1]] * len(new)
            at = high
        self.out, self.starts, self.ends = out + self.out[at:], starts + self.starts[at:], ends + self.ends[at:]

    def text(self) -> str:
        return "".join(self.out)


def _aligned(transducer: Transducer, pattern: re.Pattern, inner: re.Pattern, write, taken=LETTER.search) -> None:
    """Rewrite only inside what ``pattern`` matches and ``taken`` accepts, part by part, so that
    positions stay fine."""
    inside = [m.span() for m in pattern.finditer(transducer.text()) if taken(m[0])]
    if not inside:
        return
    at = iter(inside)
    low, high = next(at)

    def within(m: re.Match) -> str | None:
        nonlocal low, high
        while m.start() >= high:
            low, high = next(at, (1 << 62, 1 << 62))
        return write(m) if m.start() >= low and m.end() <= high else None

    transducer.rewrite(inner, within)


ADDRESS_PART = re.compile(r" (at|dot) ", re.I)


def is_spelled(run: str) -> bool:
    """At least seven digits in all, and a word among them."""
    return bool(LETTER.search(run)) and len(DIGITS.findall(run)) + len(DIGIT_WORD.findall(run)) >= SPELLED_LEAST


def normalised(text: str) -> Transducer | None:
    """The normal form of ``text``; None where it has nothing to undo."""
    odd = not text.isascii() and any(alike(c) != c for c in set(text) if not c.isascii())
    hinted = HINTS.search(text)
    spelled = any(is_spelled(m[0]) for m in SPELLED.finditer(text))
    dotted = any(LETTER.search(m[0]) for m in DOTTED.finditer(text))
    if not (odd or hinted or spelled or dotted):
        return None
    done = Transducer(text)
    if odd:
        done.out = [c if c.isascii() else alike(c) for c in done.out]
    if hinted:
        done.rewrite(AT, lambda m: "@")
        done.rewrite(DOT, lambda m: ".")
        _aligned(done, BARE, ADDRESS_PART, lambda m: "@" if m[1].lower() == "at" else ".")
    if odd or hinted or dotted:
        _aligned(done, DOTTED, DOTTED_PART, lambda p: "." if p[1] else DIGIT_WORDS[p[2].lower()] if p[2] else "")
    if odd or spelled:
        _aligned(done, SPELLED, SPELLED_PART, lambda p: "+" if p[1] else DIGIT_WORDS[p[2].lower()] if p[2] else "", is_spelled)
    return done


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The plain identifiers of a text, and all of them: the plain ones and those that only
    the normal form shows and that touch no plain one of their kind."""
    base = detect(text or "")
    done = normalised(text) if text else None
    if done is None:
        return base, base
    every = list(base)
    taken = {k: [s for s in base if s[2] == k] for k in KINDS}
    for low, high, kind in detect(done.text()):
        start, end = done.starts[low], done.ends[high - 1]
        if text[start:end] == "".join(done.out[low:high]):
            continue  # plain already: base decides on it
        if not any(start < e and s < end for s, e, _ in taken[kind]):
            every.append((start, end, kind))
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def rendered(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the ``spans`` of every whole text of ``docs`` (kind, start, end in code
    points, end exclusive), and ``base``: the same without the disguised ones, as text.

    A null or empty text has none.  Repeated rows give repeated result rows; further columns
    are ignored.
    """

    def rows(ids, texts):
        base, every = zip(*map(spans, texts), strict=True) if texts else ((), ())
        return [
            ids,
            [rendered(b) for b in base],
            [[{"kind": k, "start": s, "end": e} for s, e, k in found] for found in every],
        ]

    return rows_with(
        docs,
        {"doc_id": "doc_id", "text": "text"},
        "doc_id bigint, base string, spans array<struct<kind: string, start: bigint, end: bigint>>",
        rows,
    )


def op9_pii_offsets(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans")
    )
