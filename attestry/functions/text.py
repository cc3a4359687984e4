"""Text primitives as Column functions: everything here stays in generated or interpreted JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import lexicon as L


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one other, those, and letters that fold to several: full case folding, by Python's own tables."""
    folds = {c: f for c in map(chr, (k for k in range(128, 0x110000) if not 0xD800 <= k < 0xE000)) if (f := c.casefold()) != c}
    single = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folds.items() if len(f) > 1}


_FOLDED, _TO, _LONGER = _folds()


def casefold(text: Column) -> Column:
    """Full case folding, final sigma, ligatures and ß among it. Plain ASCII takes the short way, letters that become several a table."""
    table = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])
    single = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _FOLDED, "abcdefghijklmnopqrstuvwxyz" + _TO)
    longer = let(table, lambda t: F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(t, c), c)), ""))
    return F.when(~text.rlike("[^\\x00-\\x7F]"), F.lower(text)).when(text.rlike(f"[{''.join(_LONGER)}]"), longer).otherwise(single)


def round_half_even(value: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals (0 to 6) by its exact binary value, halves to the even neighbour.

    |value| is m / 2^s with whole m and s; m * 10^digits divided by 2^s leaves a whole part and a rest that is compared with half of
    2^s, all in whole decimals. Doubles whose neighbours are further apart than the last decimal stay as they are, as do NaN and infinities.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    size = F.abs(value)
    shift = F.lit(53) - F.floor(F.log2(size)).cast("int")
    two = lambda s: whole(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(s, F.lit(60)))) * whole(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(s - 60, F.lit(0))))

    def exact(x: Column) -> Column:
        whole_part = F.call_function("div", x.p, x.d)
        rest = x.p - whole(whole_part) * x.d
        up = (rest * 2 > x.d) | ((rest * 2 == x.d) & (whole_part % 2 == 1))
        return (whole_part + up.cast("long")).cast("double") / F.lit(float(10**digits))

    parts = F.struct((whole((size * F.pow(F.lit(2.0), shift)).cast("long")) * whole(F.lit(10**digits))).alias("p"), two(shift).alias("d"))
    rounded = F.when(size < 0.25 / 10**digits, F.lit(0.0)).otherwise(let(parts, exact))
    return F.when(F.isnan(value) | (size * 10**digits >= 2.0**53), value).otherwise(F.when(value < 0, -rounded).otherwise(rounded))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{L.SPACE}]+", " "))


def normalize(text: Column) -> Column:
    """The key by which texts or labels count as equal: case folded, white space collapsed."""
    return collapse(casefold(text))


def strip(text: Column, signs: str = L.SPACE) -> Column:
    """Without the leading and trailing characters of a regex class; trim() knows blanks only."""
    return F.regexp_replace(text, rf"^[{signs}]+|[{signs}]+$", "")


def lines(text: Column, keep_ends: bool = True) -> Column:
    """Lines by all eleven line ends, a CR with LF as one."""
    ends = rf"(?:\r\n|[{L.LINE_END}])"
    whole = found(text, rf"[^{L.LINE_END}]*{ends}|[^{L.LINE_END}]+")
    return whole if keep_ends else F.transform(whole, lambda x: F.regexp_replace(x, rf"{ends}$", ""))


def ascii_bounds(pattern: str) -> str:
    """A pattern of ASCII words whose bounds are those of ASCII, as in RE2: to Java's own, letters beyond it belong to a word."""
    return re.sub(r"\\b(?=[\w(])", r"(?<!\\w)", pattern).replace(r"\b", r"(?!\w)")


def words(text: Column) -> Column:
    return found(text, L.WORD)


def sentences(text: Column) -> Column:
    return found(text, L.SENTENCE)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda would compute a captured expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of strings, in order, joined by a space; none if it is shorter."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))

    return let(tokens, of)


def times(text: Column) -> Column:
    return found(text, L.TIME)


def dates(text: Column) -> Column:
    return found(text, L.DATE)


def references(text: Column) -> Column:
    return found(text, L.REFERENCE)


def anchors(text: Column) -> Column:
    """Times, dates and reference ids of a text, each once."""
    return F.array_distinct(F.concat(times(text), dates(text), references(text)))


def numbers(text: Column) -> Column:
    return F.array_distinct(found(text, L.NUMBER))


def expand_contractions(text: Column) -> Column:
    """Case folded, with not written out, so that polarity reads alike; white space collapsed."""
    text = F.replace(casefold(text), F.lit("’"), F.lit("'"))
    for pattern, to in ((r"\b(can't|cannot)\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not")):
        text = F.regexp_replace(text, pattern, to)
    return collapse(text)


def stem(word: Column) -> Column:
    """Irregular forms by table, else -ing, -ed or -s off longer words."""
    table = F.create_map(*[F.lit(x) for pair in L.IRREGULAR.items() for x in pair])
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    regular = (
        F.when(word.endswith("ing") & (F.length(word) > 5), cut(3)).when(word.endswith("ed") & (F.length(word) > 4), cut(2)).when(word.endswith("s") & (F.length(word) > 3), cut(1)).otherwise(word)
    )
    return F.coalesce(F.try_element_at(table, word), regular)


def stems(text: Column) -> Column:
    """Distinct stems of a text's content words."""
    content = F.filter(found(expand_contractions(text), "[a-z]+"), lambda w: ~w.isin(L.STOP_WORDS))
    return F.array_distinct(F.transform(content, stem))


def clauses(normal: Column) -> Column:
    """Clauses of a text that expand_contractions() has been over."""
    return F.filter(F.transform(F.split(normal, L.CLAUSE_END), lambda c: strip(c)), lambda c: c != "")


def negative(clause: Column) -> Column:
    return F.regexp_replace(clause, L.NEGATIVE_QUALIFIER, "").rlike(L.NEGATIVE)


def related(a: Column, b: Column) -> Column:
    """Two sets of stems with two in common that are 0.6 of the smaller set."""
    common = F.size(F.array_intersect(a, b))
    return (common >= 2) & (common / F.greatest(F.lit(1), F.least(F.size(a), F.size(b))) >= 0.6)


def identity_stripped(text: Column) -> Column:
    """Words of a text once dates, times, ids, initials and two-word names are their kinds."""
    for pattern, kind in ((L.DATE, "VALUE"), (L.TIME, "VALUE"), (L.REFERENCE, "RECORD"), (L.INITIALS, "CONTACT"), (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "PERSON")):
        text = F.regexp_replace(text, pattern, kind)
    return words(F.lower(text))


def author_request(text: Column) -> Column:
    """A request about writing the log itself, which is no fact of the note."""
    return strip(text, ' \\t\\r\\n"“”').rlike(L.AUTHOR_REQUEST)


def direct_control(text: Column) -> Column:
    """An embedded command at the start; reported ones pass."""
    return F.regexp_replace(text, '^[ \\t\\r\\n"“”]+', "").rlike("(?i)^(?:" + L.CONTROL + ")")


def find(needle: Column, text: Column, at: Column | int = 0) -> Column:
    """Zero-based position of the first match from ``at`` on, -1 if there is none."""
    return F.call_function("locate", needle, text, F.lit(at) + 1) - 1


def quoted(text: Column) -> Column:
    """A regex that matches a text as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def running(values: Column, zero: int = 0, join=lambda a, b: a + b) -> Column:
    """What ``join`` makes of all values before each; one element more than ``values``, for all of them.

    By blocks of 64, blocks of 64 blocks, and those again by 64: an element is at most 63 steps of each size and one for each 262,144
    values before it, so a million values cost some hundred million short steps and nothing is copied from element to element.
    """
    all_ = lambda part: F.aggregate(part, F.lit(zero), join)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v), 6)), lambda b: all_(F.slice(v, b * 64 + 1, F.lit(64))))
    part = lambda v, k, shift: all_(F.slice(v, F.shiftleft(F.shiftright(k, shift + 6), 6) + 1, F.shiftright(k, shift).bitwiseAND(63)))

    def of(v: Column) -> Column:
        upto = lambda one, two, three, k: join(join(join(all_(F.slice(three, F.lit(1), F.shiftright(k, 18))), part(two, k, 12)), part(one, k, 6)), part(v, k, 0))
        return let(blocks(v), lambda one: let(blocks(one), lambda two: let(blocks(two), lambda three: F.transform(F.sequence(F.lit(0), F.size(v)), lambda k: upto(one, two, three, k)))))

    return let(values, of)


def first_index(n: Column, test) -> Column:
    """The least index below ``n`` for which ``test`` holds, ``n`` if for none: by halves, as it holds for all behind it too."""
    halved = lambda x, mid: F.when(test(mid), F.struct(x.lo.alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), x.hi.alias("hi")))
    step = lambda x, _: F.when(x.lo < x.hi, halved(x, F.shiftright(x.lo + x.hi, 1))).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda x: x.lo)


def occurrences(text: Column, quote: Column) -> Column:
    """Zero-based starts of every occurrence, overlapping ones too; none for an empty or longer quote.

    A look-ahead for the quote cuts the text where it begins: every piece but the first is one, and the first if
    the text begins with it.
    """
    pieces = F.transform(F.split(text, F.concat(F.lit("(?="), quoted(quote), F.lit(")")), -1), F.length)
    begins = let(running(pieces), lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
    found = F.filter(begins, lambda i, k: (k > 0) | F.startswith(text, quote))
    return F.when((F.length(quote) > 0) & (F.length(text) >= F.length(quote)), found).otherwise(F.array().cast("array<int>"))


def separate_occurrences(text: Column, quote: Column) -> Column:
    """Zero-based starts of occurrences that don't overlap, from the left: the lengths between quotes, summed."""
    size = F.length(quote)
    ends = let(F.transform(F.split(text, quoted(quote), -1), F.length), lambda n: running(F.transform(n, lambda x: x + size)))
    # Each piece but the last is followed by a quote; the sums count one more for it.
    found = let(ends, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 2), lambda x: x - size))
    return F.when(size > 0, found).otherwise(F.array().cast("array<int>"))


def escape_markdown(text: Column) -> Column:
    """Text that HTML and Markdown both show as it is."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+.!|-])", r"\\$1")


def context(text: Column, at: Column, length: Column, around: int = 100) -> Column:
    """The stretch ``around`` characters to both sides of a find."""
    start = F.greatest(at - around, F.lit(0))
    return F.substring(text, start + 1, at + length + around - start)
