"""Secret scan by pattern and by sliding-window Shannon entropy, in DataFrame functions only.

Base kinds are patterns over the whole text: assign, access and hex. The entropy kinds look at candidate strings (runs of
token characters with a digit), one character class at a time: a window of fixed length slides over the
candidate, its character counts change by one in and one out, and with them the sum of c*log2(c), so each step costs
a constant amount of arithmetic: counts are five bits each in a few longs. A window whose characters are all of the class
and whose entropy log2(W) - sum/W reaches the class's threshold is hot; hot windows that touch or overlap make a span. Base
spans always stay.

The allow-list has two parts. Words and paths that it names inside a candidate cut it there: no window goes across
them, and what stands beside them is looked at like any other string. A candidate that is an allowed form as a whole gives no entropy
spans.

A long candidate is cut into pieces that overlap by a window less one character, so that each window lies in one piece
and no state grows with the candidate; spans that meet at the pieces' ends are joined. Work is proportional to the text.
One narrow stage: no shuffle, no Python, each text on its own.

Defined cases: null text counts as empty; null doc_id stays null; rows are reported one by one, repeated or not; a very
long text or candidate is scanned whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: pattern, and the smallest length of the group that decides (0: the whole match).
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: kind: characters of the class, window, entropy in bits from which a window is hot.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 4.0),
}
#: Forms of a whole candidate with no secret in it: test vectors, UUIDs, numbers, and identifiers with words. A pair is a form and
#: what it must not hold. No pattern repeats a group that may be given back: matchers do that by recursion, as deep as the text is long.
ALLOW: tuple[str | tuple[str, str], ...] = (
    r"(?i)^(.)\1+$|^(0123456789|abcdefghij|1234567890)",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9_=+/-]+$",
    (r"^[a-z][a-z_-]*[0-9]*$", r"[_-][_-]"),
)
#: Words and paths that cut a candidate. Possessive: what is taken is never given back, in a loop and not by recursion.
ALLOW_INSIDE = (r"(?i:example|sample|placeholder|dummy|changeme|lorem)(?:[_=-]|(?i:key))*+", r"(?:/[a-z]++){3,}+/?+")

#: Begins of windows that a piece of a candidate holds; rows of a block whose places are added up at once.
PIECE, BLOCK = 256, 256
#: Counts of five bits in a long.
_PER_LONG = 12

_SPANS = "array<struct<begin:int,end:int>>"


def _once(c: Column, build: Callable[[Column], Column]) -> Column:
    """build(c) with c computed once."""
    return F.transform(F.array(c), build)[0]


def _running(lengths: Column) -> Column:
    """(begin, end) of stretches of these (gap, length) laid end to end, gap first. Blocks keep every array that grows small."""
    at = lambda a, x: a["at"] + x["gap"] + x["length"]
    end = lambda a, x, more: F.struct((more + a["at"] + x["gap"]).alias("begin"), (more + at(a, x)).alias("end"))
    within = lambda block: F.aggregate(
        block,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")),
        lambda a, x: F.struct(at(a, x).alias("at"), F.concat(a["spans"], F.array(end(a, x, F.lit(0)))).alias("spans")),
    )
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: within(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["begin"] + by).alias("begin"), (s["end"] + by).alias("end")))
    joined = lambda found: F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("spans")),
        lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["spans"], F.array(moved(b["spans"], a["at"]))).alias("spans")),
        lambda a: F.flatten(a["spans"]),
    )
    return _once(lengths, lambda all_: F.when(F.size(all_) > 0, joined(blocks(all_))).otherwise(F.array().cast(_SPANS)))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(begin, end, part) of the leftmost non-overlapping matches, in code points; part: the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The pieces between the matches give their places: piece, match, piece, match, ...
    lengths = F.zip_with(whole, F.split(text, pattern, -1), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("length")))
    placed = _running(F.filter(lengths, lambda x: x["length"].isNotNull()))  # the last piece has no match behind it
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.zip_with(placed, parts, lambda s, part: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), part.alias("part")))
    # Most texts have no match: one look, and nothing more for them.
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<begin:int,end:int,part:string>>"))


def _between(m: Column, pattern: str) -> Column:
    """(begin, part) of what stands between the pattern's matches in a candidate."""
    parts = F.split(m["part"], pattern, -1)
    whole = F.regexp_extract_all(m["part"], F.lit(pattern), F.lit(0))
    lengths = F.zip_with(parts, whole, lambda p, x: F.struct(F.lit(0).alias("gap"), (F.length(p) + F.coalesce(F.length(x), F.lit(0))).alias("length")))
    cut = F.zip_with(_running(lengths), parts, lambda s, p: F.struct((m["begin"] + s["begin"]).alias("begin"), p.alias("part")))
    return F.when(m["part"].rlike(pattern), cut).otherwise(F.array(F.struct(m["begin"].alias("begin"), m["part"].alias("part"))))


def _hot_spans(piece: Column, offset: Column, alphabet: str, window: int, threshold: float) -> Column:
    """Spans of a piece's hot windows, by incremental counts; offset: where the piece begins."""
    longs = len(alphabet) // _PER_LONG + 1  # code 0: outside the class
    code = [alphabet.find(chr(i)) + 1 for i in range(128)]
    codes = F.transform(F.split(piece, ""), lambda c: F.element_at(F.lit(code), F.ascii(c) % 128 + 1))
    terms = F.lit([n * math.log2(n) if n else 0.0 for n in range(window + 1)])
    shift = lambda c: (c % _PER_LONG * 5).cast("int")
    one = lambda c, k: F.when(F.floor(c / _PER_LONG) == k, F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(F.lit(0).cast("long"))

    def count(a: Column, c: Column) -> Column:
        chosen = a["n0"]
        for k in range(1, longs):
            chosen = F.when(F.floor(c / _PER_LONG) == k, a[f"n{k}"]).otherwise(chosen)
        return F.call_function("shiftright", chosen, shift(c)).bitwiseAND(F.lit(31)).cast("int")

    def moved(a: Column, x: Column, now: Column, left: Column) -> Column:
        """One character in, one out; out is -1 while the first window fills."""
        gone = x["gone"] >= 0
        change = F.element_at(terms, now + 2) - F.element_at(terms, now + 1) + F.when(gone, F.element_at(terms, F.greatest(left, F.lit(1))) - F.element_at(terms, left + 1)).otherwise(F.lit(0.0))
        counts = {f"n{k}": a[f"n{k}"] + one(x["code"], k) - F.when(gone, one(x["gone"], k)).otherwise(F.lit(0).cast("long")) for k in range(longs)}
        same = x["gone"] == x["code"]
        total = a["total"] + F.when(same, F.lit(0.0)).otherwise(change)
        clean = F.when(x["code"] == 0, F.lit(0)).otherwise(a["clean"] + 1)  # characters of the class up to here
        return F.struct(*(F.when(same, a[k]).otherwise(v).alias(k) for k, v in counts.items()), total.alias("total"), clean.alias("clean"))

    def opened(a: Column, b: Column, end: Column) -> Column:
        hot = (b["clean"] >= window) & (F.lit(math.log2(window)) - b["total"] / window >= threshold - 1e-9)
        begin = end - window
        joins = a["end"] >= begin
        closed = F.when(hot & ~joins & (a["end"] >= 0), F.concat(a["spans"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end"))))).otherwise(a["spans"])
        return F.struct(
            *(b[f"n{k}"].alias(f"n{k}") for k in range(longs)), b["total"].alias("total"), b["clean"].alias("clean"),
            F.when(hot & ~joins, begin).otherwise(a["begin"]).alias("begin"), F.when(hot, end).otherwise(a["end"]).alias("end"), closed.alias("spans"),
        )

    def step(a: Column, x: Column) -> Column:
        counted = _once(F.struct(count(a, x["code"]).alias("now"), F.when(x["gone"] >= 0, count(a, x["gone"])).otherwise(F.lit(0)).alias("left")), lambda n: moved(a, x, n["now"], n["left"]))
        return _once(counted, lambda b: opened(a, b, x["end"]))

    zero = [F.lit(0).cast("long").alias(f"n{k}") for k in range(longs)]
    start = F.struct(*zero, F.lit(0.0).alias("total"), F.lit(0).alias("clean"), F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.array().cast(_SPANS).alias("spans"))
    indexed = lambda all_: F.transform(all_, lambda c, i: F.struct(c.alias("code"), F.when(i >= window, F.get(all_, i - window)).otherwise(F.lit(-1)).alias("gone"), (i + 1).alias("end")))
    last = lambda a: F.when(a["end"] >= 0, F.concat(a["spans"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end"))))).otherwise(a["spans"])
    spans = F.aggregate(_once(codes, indexed), start, step, last)
    return F.transform(spans, lambda s: F.struct((offset + s["begin"]).alias("begin"), (offset + s["end"]).alias("end")))


def hot_spans(candidate: Column, alphabet: str, window: int, threshold: float, piece: int = PIECE) -> Column:
    """(begin, end) of the spans of a candidate's hot windows; the candidate is of ASCII characters."""
    pieces = F.regexp_extract_all(candidate, F.lit(f"(?s)(?=(.{{1,{piece + window - 1}}})).{{1,{piece}}}"), F.lit(1))
    found = F.transform(pieces, lambda p, i: _hot_spans(p, i * piece, alphabet, window, threshold))

    def joined(spans: Column) -> Column:
        """Spans in order: one begins where it lies beyond the one before, and ends where the next lies beyond it."""
        begins = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] < s["begin"]))
        ends = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["begin"] > s["end"]))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["begin"].alias("begin"), e["end"].alias("end")))

    return _once(F.flatten(found), joined)


def _entropy_spans(candidates: Column, kind: str, order: int) -> Column:
    alphabet, window, threshold = CLASSES[kind]
    span = lambda m, s: F.struct((m["begin"] + s["begin"]).alias("begin"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (m["begin"] + s["end"]).alias("end"))
    return F.flatten(F.transform(candidates, lambda m: F.transform(hot_spans(m["part"], alphabet, window, threshold), lambda s: span(m, s))))


def _allowed(part: Column, forms: tuple[str | tuple[str, str], ...]) -> Column:
    held = F.lit(False)
    for form in forms:
        held = held | (part.rlike(form) if isinstance(form, str) else part.rlike(form[0]) & ~part.rlike(form[1]))
    return held


def scan(docs: DataFrame, allow: tuple[str | tuple[str, str], ...] = ALLOW, allow_inside: tuple[str, ...] = ALLOW_INSIDE) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        kept = F.filter(_matches(F.col("text"), pattern, group), lambda m: F.length(m["part"]) >= least)
        rows = rows.withColumn(kind, F.transform(kept, lambda m: F.struct(m["begin"].alias("begin"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"))))
        named.append(kind)
    candidates = F.filter(_matches(F.col("text"), CANDIDATE), lambda m: m["part"].rlike("[0-9]") & ~_allowed(m["part"], allow))
    if allow_inside:
        cut = F.flatten(F.transform(candidates, lambda m: _between(m, "|".join(f"(?:{p})" for p in allow_inside))))
        candidates = F.filter(cut, lambda m: F.length(m["part"]) >= min(w for _, w, _ in CLASSES.values()))
    rows = rows.withColumn("candidates", candidates)
    for order, kind in enumerate(CLASSES, len(BASE)):
        rows = rows.withColumn(kind, _entropy_spans(F.col("candidates"), kind, order))
    joined = lambda kinds: F.array_join(F.transform(F.array_sort(F.concat(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in named),
        F.sha2(joined(named), 256).alias("base_sha256"),
        joined([*named, *CLASSES]).alias("spans"),
        (sum((F.size(k) for k in CLASSES), F.lit(0))).cast("long").alias("n_entropy"),
    )
