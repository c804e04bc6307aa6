"""Benchmark decontamination with built-in functions: windows of words and of templates, joined by hash, then checked slot by slot.

A template is a text in which each number, name and unit is replaced by a typed placeholder. A question whose numbers and names were
changed keeps its template, so windows of the template are joined as windows of the plain words are. What stood in the slots must then
correspond: one value of the item to one value of the document and back, over all windows of an alignment. A second form of the template has
one placeholder for a run of names and for a number with its unit. Alignments that lie near each other are added up, as a value or
word more or less moves what comes after it. Items too short for a window have one of their whole length.

No pattern repeats a group but possessively, which Java matches without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import stored
from lamina.llm.native import covered, paired

#: Words of a window, windows in line that make an exact match (13 words), and the share of an item's tokens that windows of a template match must cover.
WIDTH, EXACT_WINDOWS, TEMPLATE_SHARE = 8, 6, 0.8
#: Half of the windows of a template match must have so many tokens that are the same in item and document, words or slot values: slots alone match any others. Of shorter windows half of the tokens must be.
SAME = 2
#: Items of fewer tokens are found only as whole texts.
ANYWHERE = 4
#: Tokens by which alignments may differ that are added up.
DRIFT = 8

#: Words that count as units.
UNITS = (
    "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilograms", "ounce",
    "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degrees", "mph", "kmh",
)

#: Rows and bytes of benchmark windows that are broadcast, and keys of texts that are read again; with more, they are joined by a shuffle. Matches aren't affected.
MAX_BROADCAST, MAX_BYTES = 2_000_000, 128 << 20

_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*+|\p{L}+"
#: Kinds of tokens: words as such, and what has a placeholder.
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: The forms of windows.
WORDS, TEMPLATE, MERGED = 0, 1, 2
_FORMS = {WORDS: "a", TEMPLATE: "b", MERGED: "c"}


def _kind(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    number = ((first >= "0") & (first <= "9")) | ((first >= "\u0080") & token.rlike(r"^\p{N}"))
    return F.when(number, NUMBER).when(token != F.lower(token), NAME).when(token.isin(*UNITS), UNIT).otherwise(WORD)


def _tokens(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Tokens and their hashes: the columns of keep, __t, __kinds, __starts (of merged tokens, places among all), __a1, __b1 and __c1 (hashes of words and of both templates)."""
    found = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), F.lit(0)).alias("__t"))
    told = found.select(*keep, "__t", F.transform("__t", lambda x: F.struct(F.xxhash64(F.lower(x)).alias("a"), _kind(x).alias("k"))).alias("__u"))
    # By transform, as Spark would put a plain extraction into the functions below, to be done again for each element.
    told = told.select(*keep, "__t", F.transform("__u", lambda u: u["k"]).alias("__kinds"), F.transform("__u", lambda u: u["a"]).alias("__a1"), F.transform("__u", lambda u: F.when(u["k"] == WORD, u["a"]).otherwise(u["k"].cast("bigint"))).alias("__b1"))
    before = lambda i: F.when(i > 0, F.get("__kinds", i - 1)).otherwise(WORD)
    goes_on = lambda k, i: ((k == NAME) & (before(i) == NAME)) | ((k == UNIT) & (before(i) == NUMBER))
    starts = F.filter(F.transform("__kinds", lambda k, i: F.when((k == WORD) | (k == NUMBER) | ~goes_on(k, i), i)), lambda i: i.isNotNull())
    told = told.select(*keep, "__t", "__kinds", starts.alias("__starts"), "__a1", "__b1")
    return told.select(*keep, "__t", "__kinds", "__starts", "__a1", "__b1", F.transform("__starts", lambda i: F.get("__b1", i)).alias("__c1"))


def _paired(hashes: Column, distance: int, form: int) -> Column:
    """As paired(), with the form in the hashes of whole windows."""
    if 2 * distance < WIDTH or form == WORDS:
        return paired(hashes, distance)
    return F.transform(paired(hashes, distance), lambda h: h.bitwiseXOR(F.lit(0x1F83D9ABFB41BD6B * form % (1 << 63))))


def windows(df: DataFrame, text_col: str, keep: tuple[str, ...], short: tuple[tuple[int, int], ...] = (), tokens: bool = False) -> DataFrame:
    """The windows of every whole text: the columns of keep, and for each window __h, __at, __form, __w (its width), __n (windows of that form and width) and __size (tokens of the text, merged ones for that form).

    They are those of WIDTH tokens, and those of the forms and widths in short. With tokens, each row has __t, __kinds and __starts (see _tokens) as well, which is for short texts."""
    h = _tokens(df, text_col, keep)
    h = h.select(*keep, F.struct(F.size("__t").alias("t"), F.size("__starts").alias("m")).alias("__sizes"), *(("__t", "__kinds", "__starts") if tokens else ()), "__a1", "__b1", "__c1")
    held = [*keep, "__sizes", *(("__t", "__kinds", "__starts") if tokens else ())]
    brief = lambda form, w: F.transform(
        F.filter(F.transform(f"__{_FORMS[form]}1", lambda _, i: i), lambda i: i <= F.size(f"__{_FORMS[form]}1") - w), lambda i: F.xxhash64(F.slice(f"__{_FORMS[form]}1", i + 1, F.lit(w)), F.lit(form))
    )
    h = h.select(*held, "__a1", "__b1", "__c1", *(brief(form, w).alias(f"__s{k}") for k, (form, w) in enumerate(short)))
    extra = [f"__s{k}" for k in range(len(short))]
    for k in (1, 2, 4):
        h = h.select(*held, *extra, *(_paired(F.col(f"__{x}{k}"), k, form).alias(f"__{x}{2 * k}") for form, x in _FORMS.items()))
    # An array of the hashes of all forms; the place in it says which.
    arrays, sections = ["__a8", "__b8", "__c8", *extra], [(WORDS, WIDTH), (TEMPLATE, WIDTH), (MERGED, WIDTH), *short]
    placed = h.select(*held, F.array(*(F.size(x) for x in arrays)).alias("__k"), F.concat(*arrays).alias("__hs"))
    # The outer form, as for the other one Spark infers a filter that computes the arrays again from the text, nested in each other.
    out = placed.select(*held, "__k", F.posexplode_outer("__hs").alias("__i", "__h")).where("__h IS NOT NULL")
    # From the last section to the first: the place in it, and what the section is.
    at, which = F.col("__i"), F.lit(0)
    for n in range(1, len(sections)):
        first = sum((F.get("__k", F.lit(j)) for j in range(1, n)), F.get("__k", F.lit(0)))
        at, which = F.when(F.col("__i") >= first, F.col("__i") - first).otherwise(at), F.when(F.col("__i") >= first, n).otherwise(which)
    of = lambda values: F.get(F.array(*(F.lit(v) for v in values)), which)
    form = of([s[0] for s in sections])
    size = F.when(form == MERGED, F.col("__sizes")["m"]).otherwise(F.col("__sizes")["t"])
    return out.select(*held, "__h", at.alias("__at"), form.alias("__form"), of([s[1] for s in sections]).alias("__w"), F.get("__k", which).alias("__n"), size.alias("__size")).drop("__sizes")


def _slots(form: Column, at: Column, width: Column, mark: bool = False) -> Column:
    """What stands in the slots of the window at a place of __t, __kinds and __starts, in lower case and order, with nothing between merged tokens. With mark, a run of names at either end of the text, which may go on in another, begins with < or >."""
    merged, last = form == MERGED, F.size("__starts") - 1
    begin = lambda j: F.when(merged, F.get("__starts", j)).otherwise(j)
    end = lambda j: F.when(merged, F.coalesce(F.get("__starts", j + 1), F.size("__t"))).otherwise(j + 1)
    kind = lambda j: F.get("__kinds", begin(j))
    value = lambda j: F.lower(F.array_join(F.slice("__t", begin(j) + 1, end(j) - begin(j)), ""))
    edge = lambda j: F.when(merged & (kind(j) == NAME) & (j == 0), "<").when(merged & (kind(j) == NAME) & (j == last), ">").otherwise("")
    return F.transform(F.filter(F.sequence(at, at + width - 1), lambda j: kind(j) != WORD), lambda j: F.concat(edge(j), value(j)) if mark else value(j))


def _consistent(pairs: Column) -> Column:
    """Whether there is one value of the item for each of the document, and the other way round. Marked values (see leaks) need only end or begin with their own value, and with no other."""
    edge = lambda p: p["i"].startswith("<") | p["i"].startswith(">")
    size = lambda f: F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: ~edge(p)), f)))
    n = F.size(F.filter(pairs, lambda p: ~edge(p)))
    touches = lambda e, p: F.when(e["i"].startswith("<"), e["d"].endswith(p["d"])).otherwise(e["d"].startswith(p["d"]))
    fits = F.forall(pairs, lambda e: ~edge(e) | F.forall(pairs, lambda p: edge(p) | ((p["i"] == F.translate(e["i"], "<>", "")) == touches(e, p))))
    return (size(lambda p: p["i"]) == n) & (size(lambda p: p["d"]) == n) & fits


def _added(shifts: Column) -> Column:
    """Alignments, the largest first, added up as long as their slots correspond: the windows at, those of them that tell, pairs."""

    def step(acc: Column, x: Column) -> Column:
        union = lambda c: F.array_union(acc[c], x[c])
        more = F.struct(union("at").alias("at"), union("telling").alias("telling"), union("pairs").alias("pairs"))
        return F.when(_consistent(more["pairs"]), more).otherwise(acc)

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("at"), none.alias("telling"), F.array().cast("array<struct<i:string,d:string>>").alias("pairs"))
    return F.aggregate(shifts, start, step)


def leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The benchmark items that stand in each document, exactly or with other numbers, names and units.

    Returns one row for each document and item: the columns named id_col and item_col, kind string (exact or template), n_windows long and share double (of
    the item's windows). Exact: EXACT_WINDOWS windows of WIDTH words (all of a shorter item's) match in line, in any case and punctuation. Template: template
    windows, of plain or of merged tokens, cover at least TEMPLATE_SHARE of the item's tokens on alignments up to DRIFT tokens apart, slot values correspond one to one, and in half of these
    windows SAME tokens are the same, so that rows of numbers or capitals aren't taken for each other. An item of fewer than WIDTH tokens has one window of its whole length, of which as a template half of the tokens, SAME
    at least, must be words; with fewer than ANYWHERE tokens it's found only where it is the whole document. Null and empty texts match nothing; repeated rows of an id count once;
    rows with a null id on either side are matched as one document or item; other columns don't matter.

    Documents aren't shuffled for the join while the benchmark has at most MAX_BROADCAST windows of MAX_BYTES in all; only matches are grouped, by document, item and alignment. A window's row has no more than its hash and place:
    what stands in the slots is read again from the texts that may hold a template."""
    questions = benchmark.select(F.col(item_col).alias("__item"), F.col(item_text_col).alias("__text"))
    # The forms and widths of short items; at most three for each width under WIDTH.
    counted = _tokens(questions, "__text", ()).select(F.explode(F.array(*(F.struct(F.lit(form).alias("form"), F.size(f"__{x}1").alias("w")) for form, x in _FORMS.items()))).alias("s"))
    short = tuple(sorted((r.form, r.w) for r in counted.select("s.*").where(f"w > 0 AND w < {WIDTH}").distinct().collect()))
    form, width = F.col("__form"), F.col("__w")
    items = windows(questions, "__text", ("__item",), short, tokens=True).withColumn("__item_slots", _slots(form, F.col("__at"), width, mark=True))
    plain = width - F.size("__item_slots")
    whole = (F.col("__n") == 1) & ((form == WORDS) | ((plain >= SAME) & (2 * plain >= width)))
    items = items.where((width == WIDTH) | whole).select("__item", "__h", "__form", "__w", F.col("__at").alias("__item_at"), F.col("__n").alias("__item_n"), "__item_slots").distinct()
    bound = items.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("__item_slots", "")) + 128).alias("b")).first()
    small = bound.n <= MAX_BROADCAST and (bound.b or 0) <= MAX_BYTES
    # Texts are known by a hash beside their id, as an id may have several.
    texts = documents.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).withColumn("__th", F.xxhash64("__text"))
    found = windows(texts, "__text", ("__doc", "__th"), short).select("__doc", "__th", "__h", "__at", "__size")
    joined = found.join(F.broadcast(items) if small else items, "__h").where((width >= ANYWHERE) | (width == F.col("__size")))
    matched = stored(joined.select("__doc", "__th", "__item", "__form", "__w", "__at", "__item_at", "__item_n", F.when(form != WORDS, F.col("__item_slots")).alias("__item_slots")), "matched")
    # Of templates those that cover enough of an item on any alignment are read again for what stands in their slots.
    covers = matched.where(form != WORDS).groupBy("__doc", "__item", "__form").agg(F.array_sort(F.collect_set("__item_at")).alias("at"), F.max("__item_n").alias("of"))
    covers = covers.where(covered(F.col("at"), WIDTH) >= TEMPLATE_SHARE * (F.col("of") + WIDTH - 1)).select(*(F.col(f"__{c}").alias(f"__c_{c}") for c in ("doc", "item", "form")))
    same = [F.col(f"__{c}").eqNullSafe(F.col(f"__c_{c}")) for c in ("doc", "item", "form")]
    window = F.struct("__form", "__w", "__at", "__item_at", "__item_n", "__item_slots")
    wanted = matched.where(form != WORDS).join(covers, same[0] & same[1] & same[2], "left_semi").groupBy("__doc", "__th", "__item").agg(F.collect_set(window).alias("__x"))
    wanted = stored(wanted.select(F.col("__doc").alias("__w_doc"), F.col("__th").alias("__w_th"), "__item", "__x"), "templates")
    # Only the texts that are read again are dealt out.
    keys = wanted.select("__w_doc", "__w_th").distinct()
    same = F.col("__doc").eqNullSafe(F.col("__w_doc")) & (F.col("__th") == F.col("__w_th"))
    some = texts.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys, same, "left_semi")
    read = some.join(wanted, same)
    told = _tokens(read, "__text", ("__doc", "__item", "__x")).select("__doc", "__item", "__t", "__kinds", "__starts", "__x")
    pairs = lambda m: F.zip_with(m["__item_slots"], _slots(m["__form"], m["__at"], m["__w"]), lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    told = told.select("__doc", "__item", F.explode(F.transform("__x", lambda m: F.struct(*(m[c].alias(c) for c in ("__form", "__w", "__at", "__item_at", "__item_n")), pairs(m).alias("__pairs")))).alias("m"))
    columns = ("__doc", "__item", "__form", "__w", "__at", "__item_at", "__item_n", "__pairs")
    lined = told.select("__doc", "__item", "m.*").select(*columns).union(matched.where(form == WORDS).withColumn("__pairs", F.lit(None).cast("array<struct<i:string,d:string>>")).select(*columns))
    lined = lined.select("__doc", "__item", "__form", "__w", (F.col("__at") - F.col("__item_at")).alias("__shift"), "__item_at", "__item_n", "__pairs")
    equal = width - F.size(F.filter("__pairs", lambda p: F.translate(p["i"], "<>", "") != p["d"]))
    telling = equal >= F.when(width < WIDTH, F.greatest(F.lit(SAME), F.ceil(width / 2))).otherwise(SAME)
    grouped = lined.groupBy("__doc", "__item", "__form", "__shift").agg(
        F.collect_set("__item_at").alias("at"), F.max("__item_n").alias("__of"), F.collect_set(F.when(telling, F.col("__item_at"))).alias("telling"), F.array_distinct(F.flatten(F.collect_set("__pairs"))).alias("pairs")
    )
    # Alignments in bands that overlap by half, so that any two of up to DRIFT tokens apart share one; those of words stay alone. One that contradicts itself adds nothing to any.
    words, band = F.col("__form") == WORDS, F.floor(F.col("__shift") / DRIFT)
    exact = words & (F.size("at") >= F.least(F.col("__of"), F.lit(EXACT_WINDOWS)))
    kept = grouped.where(exact | (~words & _consistent(F.col("pairs")))).select("*", F.explode(F.when(words, F.array(band)).otherwise(F.array(band, band + 1))).alias("__band"))
    banded = kept.groupBy("__doc", "__item", "__form", "__band").agg(
        F.max("__of").alias("__of"), F.max(F.size("at")).alias("most"), F.reverse(F.array_sort(F.collect_list(F.struct(F.size("at").alias("n"), F.col("__shift").alias("shift"), "at", "telling", "pairs")))).alias("shifts")
    )
    summed = banded.select("__doc", "__item", words.alias("exact"), "__of", "most", _added(F.col("shifts")).alias("a")).select("__doc", "__item", "exact", "__of", "most", F.array_sort("a.at").alias("at"), F.size("a.telling").alias("telling"))
    enough = (covered(F.col("at"), WIDTH) >= TEMPLATE_SHARE * (F.col("__of") + WIDTH - 1)) & (2 * F.col("telling") >= F.size("at"))
    good = summed.where(F.col("exact") | enough).withColumn("n", F.when(F.col("exact"), F.col("most")).otherwise(F.size("at")).cast("long")).withColumn("share", F.col("n") / F.col("__of"))
    best = good.groupBy("__doc", "__item").agg(F.max(F.struct("exact", "n", "share")).alias("b"))
    return best.select(F.col("__doc").alias(id_col), F.col("__item").alias(item_col), F.when(F.col("b.exact"), "exact").otherwise("template").alias("kind"), F.col("b.n").alias("n_windows"), F.col("b.share").alias("share"))
