"""Personal data by pattern, and disguised personal data by offset-preserving deobfuscation.

Base kinds are patterns over the whole text: email, ip, card and phone. Disguised identifiers are found by three transducers, one after the
other: look-alike characters become ASCII and invisible ones go, two or more spelled digits in a row become digits, and words for at, dot and
plus become their signs. Each keeps its edits as places of its output and input, so what the same patterns find in the
normalised text is mapped back, edit by edit, to the characters of the source. A span is added if an edit lies in it and no base span of
its kind holds it; base spans always stay.

Each pattern is one left-to-right pass whatever the text: runs are taken whole, and an email is looked for at its @ and not at
each character before it. Each text is read on its own in one narrow stage: no shuffle.

What counts as a disguise: a bracketed at or dot word anywhere; a bare dot word between spaces; a bare at word only where the name behind it
has a dot word too, so that "at" in prose stays; plus before a digit. A span that ends within a run of spelled digits covers the run.

Defined cases: null text counts as empty; null doc_id stays null; rows are reported one by one, repeated or not; a very long text is
scanned whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.text import slices

KINDS = ("email", "ip", "card", "phone")
#: Digits of a card and of a phone number; the largest part of an ip address.
CARD_DIGITS, PHONE_DIGITS, IP_PART = (16, 19), (8, 15), 255

#: Letters of other scripts that look like these, dots, dashes.
ALIKE = ("аеорсухіјѕԁһӏԛԝ" "АВЕКМНОРСТХУІЈЅ" "οαινρυκ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "。‧" "‐‑‒–—−", "aeopcyxijsdhlqw" "ABEKMHOPCTXYIJS" "oaivpuk" "ABEZHIKMNOPTYX" ".." "------")
#: Characters that show nothing: soft hyphen, zero-width space, non-joiner, joiner, word joiner, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits 0 to 9 as words.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
AT, DOT, PLUS = "at|arobase|arroba", "dot|point|punkt|punto", "plus"


def _look_alikes() -> dict[str, str]:
    """Other characters that are compatible with one of ASCII, by Unicode's own rule, and the look-alikes above."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 .@+-_()[]{}%"
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for r in (range(0xA0, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800)) for c in r)
    return {c: form for c, form in forms if form in plain and len(form) == 1} | dict(zip(*ALIKE, strict=True))


LOOK_ALIKES = _look_alikes()
DIGIT_OF = {word: str(k) for words in DIGIT_WORDS for k, word in enumerate(words.split())}

#: Patterns of the transducers, in a form that engines without look-around take too.
_DIGIT = "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w))).replace("é", "[éÉ]").replace("ü", "[üÜ]")
_SHUT = lambda words: rf" {{0,2}}[\[({{<] {{0,2}}(?:{words}) {{0,2}}[\])}}>] {{0,2}}"
_BARE_DOT = rf" {{1,2}}(?:{DOT}) {{1,2}}"
SPELLED = rf"(?i)\b(?:{_DIGIT})\b(?:(?:[ ,-]{{1,2}}|[.]|{_BARE_DOT})(?:{_DIGIT})\b)+"
SIGNS = rf"(?i){_SHUT(AT)}|{_SHUT(DOT)}| {{1,2}}(?:{AT}) {{1,2}}[a-z0-9.-]{{1,253}}(?:{_BARE_DOT}|{_SHUT(DOT)})|{_BARE_DOT}|\b{PLUS} {{1,2}}[0-9]"

_FOLD = str.maketrans(LOOK_ALIKES | dict.fromkeys(INVISIBLE, ""))
_FOLD_FROM = {*LOOK_ALIKES, *INVISIBLE}
#: A text without these has no sign words to change: a bare at needs a dot word behind it.
_SIGN_WORDS, _SHUT_AT = (*DOT.split("|"), PLUS), re.compile(r"[\[({<] {0,2}(?:at|ar)")
_SPELLED, _SIGNS = re.compile(SPELLED, re.ASCII), re.compile(SIGNS, re.ASCII)
_WORD, _LABEL = re.compile("[.]|[^ .,-]+"), re.compile(rf"(?i)^ +(?:{AT}) +([a-z0-9.-]+)(?: |[\[({{<])", re.ASCII)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile("[0-9]+")


def _email(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        # The characters before the @, read backwards from it: they hold no @, so each is read once.
        begin, step = at, 64
        while begin > done:
            back = text[max(done, begin - step) : begin][::-1]
            n = _LOCAL_END.match(back).end()
            begin, step = begin - n, step * 2
            if n < len(back):
                break
        if begin < at:
            done = m.end()
            yield begin, done


def _ip(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = list(_PART.finditer(text, *m.span()))
            for k in range(0, len(parts) - 3, 4):
                own = [p[0].lstrip("0") for p in parts[k : k + 4]]
                if all(len(p) <= 3 and int(p or 0) <= IP_PART for p in own):
                    yield parts[k].start(), parts[k + 3].end()


def _digits(s: str) -> str:
    return s.translate(_NO_SIGNS)


_NO_SIGNS = str.maketrans("", "", " ().-+")


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _card(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            yield m.span()


def _phone(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
            yield m.span()


FIND: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


class Edits:
    """Places of a transducer's edits in its output and its input. An edit of equal lengths maps character by character."""

    def __init__(self) -> None:
        self.out, self.out_end, self.begin, self.end = array("q"), array("q"), array("q"), array("q")

    def add(self, out: int, length: int, begin: int, end: int) -> None:
        for places, at in ((self.out, out), (self.out_end, out + length), (self.begin, begin), (self.end, end)):
            places.append(at)

    def _place(self, at: int, after: int) -> int:
        """Where the output's character at a place begins in the input (after 0) or ends (after 1)."""
        k = bisect_right(self.out, at) - 1
        if k < 0:
            return at + after
        if at >= self.out_end[k]:
            return self.end[k] + at - self.out_end[k] + after
        if self.out_end[k] - self.out[k] == self.end[k] - self.begin[k]:
            return self.begin[k] + at - self.out[k] + after
        return self.end[k] if after else self.begin[k]

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return self._place(begin, 0), self._place(end - 1, 1)

    def within(self, begin: int, end: int) -> bool:
        k = bisect_left(self.out, end) - 1
        return k >= 0 and (self.out_end[k] > begin or self.out[k] > begin)


def _rewritten(text: str, pattern: re.Pattern, change: Callable[[str], str]) -> tuple[str, Edits]:
    pieces, edits, at, out = [], Edits(), 0, 0
    for m in pattern.finditer(text):
        new = change(m[0])
        out += m.start() - at
        pieces += [text[at : m.start()], new]
        edits.add(out, len(new), *m.span())
        out, at = out + len(new), m.end()
    return ("".join([*pieces, text[at:]]) if pieces else text), edits


def _sign(found: str) -> str:
    low = found.lower()
    if low.startswith(PLUS):
        return "+" + found[-1]
    label = _LABEL.match(found)
    if label:
        return f"@{label[1]}."
    return "@" if low.strip(" [](){}<>") in AT.split("|") else "."


def _spelled(found: str) -> str:
    return "".join(DIGIT_OF.get(w.lower(), ".") for w in _WORD.findall(found))


def _normalised(text: str) -> tuple[str, list[Edits]]:
    """The text behind all transducers, and the edits of those that found any."""
    stages, normal = [], text
    strange = set() if text.isascii() else set(text) & _FOLD_FROM
    if strange:
        hidden, alike = strange & set(INVISIBLE), strange - set(INVISIBLE)
        folded = "|".join(f"[{re.escape(''.join(sorted(c)))}]+" for c in (alike, hidden) if c)
        stages.append((re.compile(folded), lambda s: s.translate(_FOLD)))
    stages.append((_SPELLED, _spelled))
    stages.append((_SIGNS, _sign))
    done = []
    for pattern, change in stages:
        if pattern is _SIGNS:
            low = normal.lower()
            if not (any(w in low for w in _SIGN_WORDS) or _SHUT_AT.search(low)):
                continue
        normal, edits = _rewritten(normal, pattern, change)
        if edits.out:
            done.append(edits)
    return normal, done


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, begin, end, disguised, identifier) of a text by kind, begin and end; places are code points of the text, end exclusive."""
    base = {kind: list(f(text)) for kind, f in FIND.items()}
    spans = {kind: [(b, e, False, text[b:e]) for b, e in found] for kind, found in base.items()}
    normal, stages = _normalised(text)
    if stages:
        for kind, f in FIND.items():
            known, more = base[kind], set()
            for begin, end in f(normal):
                b, e, edited = begin, end, False
                for edits in reversed(stages):
                    edited = edited or edits.within(b, e)
                    b, e = edits.source(b, e)
                k = bisect_right(known, (b, len(text) + 1)) - 1
                if edited and not (k >= 0 and known[k][1] >= e):
                    more.add((b, e, True, normal[begin:end]))
            spans[kind] = sorted([*spans[kind], *more])
    return [(kind, *s) for kind in KINDS for s in spans[kind]]


_SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_()), ("identifier", pa.string())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN]
    for batch in batches:
        for begin, end in slices(batch.column("text")):
            rows = batch.slice(begin, end - begin)
            spans = [[dict(zip(names, s, strict=True)) for s in find(t)] if t else [] for t in rows.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "spans": pa.array(spans, pa.list_(_SPAN))})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, begin, end, disguised, identifier in plain characters) for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found, "doc_id long, spans array<struct<kind string, begin int, end int, disguised boolean, identifier string>>")


def joined(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def counted(found: DataFrame) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans as text, of what scan() returns."""
    base = F.filter("spans", lambda s: ~s["disguised"])
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"))
