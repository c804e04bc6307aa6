"""Secret scanning on the JVM: pattern kinds, and a sliding entropy window over candidate strings. Built-in functions only.

Positions come without a search for each match: splitting a text at a pattern gives the gaps between its matches, so running sums of
the lengths of gaps and matches are the ends. The entropy of a window of WINDOW characters is kept by counts, which lie packed in a few numbers:
a character that enters or leaves changes one count, and with it one term of sum(c * log2(c)), from which the Shannon entropy follows.

No pattern repeats a group, as Java's regular expressions would match that by recursion, which long texts don't bear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy window, its length in characters, and the bits a character from which a window counts, by class.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW, HEX_BITS, MIXED_BITS = 20, 3.0, 3.8

#: Candidates that are no secrets whatever their entropy: words and numbers alone, UUIDs, documented examples and filler.
ALLOWED = (
    r"^[A-Za-z]+$", r"^[0-9_+/-]+={0,2}$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{4}|0123456789|abcdefgh",
)
#: Nor are paths and dashed words: parts that are letters with up to four digits after them (the last one may be digits alone). They match the first two patterns and not the third.
PATH = (r"^/?[A-Za-z][A-Za-z0-9/_-]*$", r"^/?[A-Za-z]+[0-9]{0,4}[/_-]", r"[0-9]{5}|[0-9][A-Za-z]|[/_-][0-9]+[/_-]")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Elements summed at a time, characters of a block that is redacted at a time, bits of a packed count and counts in a number.
_BLOCK, _PIECE, _BITS, _PACKED = 256, 4096, 5, 12
REDACTED = "[REDACTED]"


def running_sum(a: Column) -> Column:
    """Inclusive running sums of an array of bigint, in blocks so that the work stays near linear. a should be a plain column."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<bigint>")
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x))
    inner = F.transform(blocks, lambda block: F.aggregate(block, none, grow))
    zero = F.array(F.lit(0).cast("bigint"))
    # Sums before each block, carried beside the finished blocks.
    joined = F.aggregate(
        inner, F.struct(F.lit(0).cast("bigint").alias("before"), F.array().cast("array<array<bigint>>").alias("done")),
        lambda acc, block: F.struct(
            (acc["before"] + F.coalesce(F.try_element_at(block, F.lit(-1)), F.lit(0).cast("bigint"))).alias("before"),
            F.concat(acc["done"], F.array(F.transform(block, lambda v: v + acc["before"]))).alias("done"),
        ), lambda acc: F.flatten(acc["done"]),
    )
    return F.when(F.size(a) > 0, joined).otherwise(F.slice(zero, 1, 0))


def window_entropy(text: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of any WINDOW successive characters of an ASCII candidate; 0 if it's shorter."""
    index = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    # Each element has the character that enters and the one that leaves, by the number its count lies in and the place there; none leaves the first windows.
    at = lambda i: F.struct(F.floor((i - 1) / _PACKED).cast("int").alias("w"), ((i - 1) % _PACKED * _BITS).cast("int").alias("s"))
    moves = F.zip_with(F.transform(F.filter(index, lambda i: i > 0), at), F.concat(F.array_repeat(at(F.lit(0)), WINDOW), F.transform(F.filter(index, lambda i: i > 0), at)), lambda into, out: F.struct(into.alias("i"), out.alias("o")))
    moves = F.filter(moves, lambda m: m["i"].isNotNull())
    counts = F.array_repeat(F.lit(0).cast("bigint"), -(-len(_ALPHABET) // _PACKED))
    # The shifts take no columns in the Python functions.
    up = lambda x, n: F.call_function("shiftleft", x, n)
    down = lambda x, n: F.call_function("shiftright", x, n).bitwiseAND(F.lit((1 << _BITS) - 1))
    one = F.lit(1).cast("bigint")

    def step(acc: Column, m: Column) -> Column:
        before = down(F.get(acc["c"], m["i"]["w"]), m["i"]["s"])
        leaves = m["o"]["w"] >= 0
        leaving = F.when(leaves, down(F.get(acc["c"], m["o"]["w"]), m["o"]["s"])).otherwise(F.lit(0).cast("bigint"))
        changed = F.when(m["i"] == m["o"], F.lit(0.0)).otherwise(term(before + 1) - term(before) + term(leaving - 1) - term(leaving))
        total, n = acc["s"] + changed, acc["n"] + 1
        bits = F.when(n >= WINDOW, F.log2(F.lit(float(WINDOW))) - total / WINDOW).otherwise(F.lit(0.0))
        none = F.lit(0).cast("bigint")
        now = F.transform(acc["c"], lambda c, k: c + F.when(k == m["i"]["w"], up(one, m["i"]["s"])).otherwise(none) - F.when(leaves & (k == m["o"]["w"]), up(one, m["o"]["s"])).otherwise(none))
        return F.struct(now.alias("c"), total.alias("s"), n.alias("n"), F.greatest(acc["b"], bits).alias("b"))

    start = F.struct(counts.alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("b"))
    return F.aggregate(moves, start, step, lambda acc: acc["b"])


def suspicious(candidate: Column) -> Column:
    """Whether the entropy of a candidate is that of a key, by its character class, and no allow-list pattern has it."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed |= candidate.rlike(pattern)
    allowed |= candidate.rlike(PATH[0]) & candidate.rlike(PATH[1]) & ~candidate.rlike(PATH[2])
    bits = F.when(candidate.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= bits)


def _free(names: list[str]) -> str:
    """A prefix that no name has."""
    prefix = "__s"
    while any(c.lower().startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def _spans(df: DataFrame, text: str, x: str) -> DataFrame:
    """df with the column f"{x}spans" array<struct<start,ord,kind,end,hide>> of the texts, which aren't null, ordered by start and kind; x is a prefix of no column.
    hide is where the secret itself begins: of an assignment at its value."""
    names, t = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{text}`")
    none, numbers = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    assigned = t.contains("=") | t.contains(":")
    m = [F.col(f"{x}m{k}") for k in range(4)]
    found = df.select(
        *names,
        F.when(assigned, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0))).otherwise(none).alias(f"{x}m0"),
        F.when(t.contains("AKIA"), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0))).otherwise(none).alias(f"{x}m1"),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)).alias(f"{x}m2"),
        F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias(f"{x}m3"),
    )

    def lengths(k: int, pattern: str) -> Column:
        gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(m[k]))
        return F.when(F.size(m[k]) > 0, F.zip_with(gaps, m[k], lambda g, v: (F.length(g) + F.length(v)).cast("bigint"))).otherwise(numbers)

    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    # Of an assignment the value's length decides, of a candidate its entropy.
    values = F.when(F.size(m[0]) > 0, F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v).cast("bigint"))).otherwise(numbers)
    measured = found.select(*names, *m, *(lengths(k, p).alias(f"{x}l{k}") for k, p in enumerate(patterns)), values.alias(f"{x}v"), F.transform(m[3], suspicious).alias(f"{x}g"))

    def spans(k: int) -> Column:
        ends = running_sum(F.col(f"{x}l{k}"))
        span = lambda e, v, hidden: F.struct((e - F.length(v)).alias("start"), F.lit(k).alias("ord"), F.lit(KINDS[k]).alias("kind"), e.alias("end"), (e - hidden).alias("hide"))
        out = F.zip_with(ends, m[k], lambda e, v: span(e, v, F.length(v)))
        if k == 0:
            ended = F.zip_with(ends, F.col(f"{x}v"), lambda e, n: F.struct(e.alias("e"), n.alias("n")))
            out = F.zip_with(ended, m[k], lambda e, v: F.when(e["n"] >= 6, span(e["e"], v, e["n"])))
        elif k == 3:
            out = F.zip_with(out, F.col(f"{x}g"), lambda v, ok: F.when(ok, v))
        nothing = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,hide:bigint>>")
        return F.when(F.size(m[k]) > 0, F.filter(out, lambda v: v.isNotNull()) if k in (0, 3) else out).otherwise(nothing)

    return measured.select(*names, F.array_sort(F.concat(*(spans(k) for k in range(4)))).alias(f"{x}spans"))


def find_secrets(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All secret spans of every whole text.

    Returns the columns named in keep and spans array<struct<start,ord,kind,end,hide>>: code points from 0, end exclusive, ordered by start and
    kind; hide is where the secret begins, of an assignment its value. The kinds assign, access and hex are the base patterns; entropy spans come on top and take none away.
    A null or empty text has no spans; repeated rows give repeated results; other columns of df don't matter. Each row is worked on alone, so nothing is shuffled."""
    x = _free([*keep, text_col])
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(f"{x}t"))
    return _spans(rows, f"{x}t", f"{x}_").select(*(F.col(f"`{c}`") for c in keep), F.col(f"{x}_spans").alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _hidden(text: Column, spans: Column) -> Column:
    """text with what spans hide replaced by REDACTED. It goes by blocks of characters, so that a place in a text is never counted from its beginning."""

    def block(piece: Column, k: Column) -> Column:
        base = (k * _PIECE).cast("bigint")
        inside = F.filter(spans, lambda s: (s["hide"] < base + _PIECE) & (s["end"] > base))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, (acc["at"] - base + 1).cast("int"), (s["hide"] - acc["at"]).cast("int"))
            # What begins in a hidden stretch, or in a block before, has its mark already.
            new = F.when((s["hide"] >= base) & (s["hide"] >= acc["at"]), F.concat(acc["out"], F.array(gap, F.lit(REDACTED)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

        rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.when(acc["at"] < base + _PIECE, F.substring(piece, (acc["at"] - base + 1).cast("int"), F.lit(_PIECE))).otherwise(F.lit("")))), "")
        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.when(F.size(inside) > 0, F.aggregate(inside, start, step, rest)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(pieces, block), "")).otherwise(text)


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with what the spans of find_secrets hide in text_col replaced by [REDACTED], all columns and rows kept; keys of assignments stay. A null or empty text stays as it is.

    Spans that overlap are replaced as one. Helper columns take names that df doesn't have."""
    x = _free(df.columns)
    spanned = _spans(df.withColumn(f"{x}t", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), f"{x}t", f"{x}_")
    # By hide, so that a value within a longer string doesn't come before it.
    ordered = F.array_sort(F.transform(F.col(f"{x}_spans"), lambda s: F.struct(s["hide"].alias("hide"), s["end"].alias("end"))))
    spanned = spanned.select(*(F.col(f"`{c}`") for c in df.columns), ordered.alias(f"{x}h"))
    return spanned.select(*(_hidden(F.col(f"`{c}`"), F.col(f"{x}h")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))
