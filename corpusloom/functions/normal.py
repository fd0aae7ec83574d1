"""Unicode normal forms as column expressions, JVM-side. The tables are built by rule from Python's Unicode data.

Text of ASCII characters is passed through. In other text, characters that stand for one other are translated in one pass; what stands for several, and letters
with separate accents, are looked up once for each that is met and replaced throughout. Characters that either side's Unicode version doesn't know stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SYLLABLES = range(0xAC00, 0xD7A4)
_CHARS = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and c not in _SYLLABLES and unicodedata.category(chr(c)) not in ("Cn", "Co")]
_MARKS = {c: unicodedata.combining(c) for c in _CHARS if unicodedata.combining(c)}
_COMPOSED = {c: unicodedata.normalize("NFKC", c) for c in _CHARS if not unicodedata.is_normalized("NFKC", c)}
_BARE = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if x not in _MARKS) for c in _CHARS if not unicodedata.is_normalized("NFKD", c) or c in _MARKS}
_CANONICAL = {c: unicodedata.normalize("NFD", c) for c in _CHARS if not unicodedata.is_normalized("NFD", c) and unicodedata.is_normalized("NFC", c)}
_PAIRS = {unicodedata.normalize("NFC", d[:-1]) + d[-1]: c for c, d in _CANONICAL.items()}
_HANGUL = "".join(map(chr, _SYLLABLES))


def _ranges(chars: Iterable[str]) -> str:
    """Inside of a character class: runs of neighbouring code points."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


#: Whatever may change by what stands before it: marks, second halves of composed letters, vowels and final consonants of Hangul.
FOLLOWER = "[\\x{300}-\\x{10ffff}&&[" + _ranges({*_MARKS, *(p[1] for p in _PAIRS), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}) + "]]"
OTHER = "[^\\x00-\\x7f]"


def _table(entries: dict[str, str]) -> Column:
    return F.lit("".join(f"\0{k}\1{v}" for k, v in entries.items()) + "\0")


def _look_up(table: Column, key: Column) -> Column:
    """The value of a key, empty if there is none."""
    return F.split_part(F.split_part(table, F.concat(F.lit("\0"), key, F.lit("\1")), F.lit(2)), F.lit("\0"), F.lit(1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _replace_each(text: Column, found: Column, new: Callable[[Column], Column]) -> Column:
    return F.aggregate(found, text, lambda t, c: F.replace(t, c, new(c)))


def _mapped(text: Column, entries: dict[str, str], gone: Iterable[str] = ()) -> Column:
    """Each character that has an entry as what it stands for; those in gone are left out."""
    one = {k: v for k, v in entries.items() if len(v) == 1}
    many = {k: v for k, v in entries.items() if len(v) > 1}
    met = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(OTHER), F.lit(0))), lambda c: F.translate(c, "".join(many), "") == "")
    # what has no counterpart in the second list of translate is left out
    return _let(F.translate(text, "".join([*one, *gone]), "".join(one.values())), lambda t: _replace_each(t, met(t), lambda c: _look_up(_table(many), c)))


def _class(c: Column) -> Column:
    """Combining class, 0 for what is no mark."""
    return F.ascii(_look_up(_table({m: chr(k) for m, k in _MARKS.items()}), c))


def _pair(first: Column, c: Column) -> Column:
    """What two characters compose to, empty if they don't."""
    a, b = F.ascii(first), F.ascii(c)
    vowel = a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
    final = a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
    at = F.when(vowel, ((a - 0x1100) * 21 + b - 0x1161) * 28).when(final, a - 0xAC00 + b - 0x11A7)
    return F.when(at.isNotNull(), F.substring(F.lit(_HANGUL), at + 1, F.lit(1))).otherwise(_look_up(_table(_PAIRS), F.concat(first, c)))


def _cluster(cluster: Column) -> Column:
    """A base and what follows it: taken apart, marks in canonical order, composed again pair by pair."""
    chars = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    apart = F.flatten(F.transform(chars(cluster), lambda c: _let(_look_up(_table(_CANONICAL), c), lambda d: F.when(d == "", F.array(c)).otherwise(chars(d)))))
    ranked = F.transform(apart, lambda c, i: F.struct(_class(c).alias("k"), i.alias("i"), c.alias("c")))
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<run:int,k:int,i:int,c:string>>").alias("out"))
    run = lambda s, x: s["run"] + F.when(x["k"] == 0, 1).otherwise(0)
    step = lambda s, x: F.struct(run(s, x).alias("run"), F.concat(s["out"], F.array(F.struct(run(s, x).alias("run"), x["k"].alias("k"), x["i"].alias("i"), x["c"].alias("c")))).cast("array<struct<run:int,k:int,i:int,c:string>>").alias("out"))
    ordered = F.array_sort(F.aggregate(ranked, start, step, lambda s: s["out"]))  # marks stay behind their base; equal classes keep their order
    state = lambda done, base, marks, last: F.struct(done.alias("done"), base.alias("base"), marks.alias("marks"), last.alias("last"))

    def compose_step(s: Column, x: Column) -> Column:
        free = (s["base"] != "") & ((s["marks"] == "") | (s["last"] < x["k"]))
        apart = F.when(x["k"] == 0, state(F.concat(s["done"], s["base"], s["marks"]), x["c"], F.lit(""), F.lit(0))).otherwise(state(s["done"], s["base"], F.concat(s["marks"], x["c"]), x["k"]))
        return _let(F.when(free, _pair(s["base"], x["c"])).otherwise(""), lambda p: F.when(p != "", state(s["done"], p, s["marks"], s["last"])).otherwise(apart))

    return F.aggregate(ordered, state(F.lit(""), F.lit(""), F.lit(""), F.lit(0)), compose_step, lambda s: F.concat(s["done"], s["base"], s["marks"]))


def _compose_clusters(text: Column) -> Column:
    """Longest clusters first: what they become is in normal form, and so is every part of it, so that shorter ones don't touch it."""
    met = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?:(?!{FOLLOWER}).)?{FOLLOWER}+"), F.lit(0)))
    longest = F.transform(F.array_sort(F.transform(met, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda x: x["c"])
    return _replace_each(text, longest, _cluster)


def nfkc(text: Column) -> Column:
    """Compatibility composition; null for null."""
    return F.when(text.rlike(OTHER), _let(_mapped(text, _COMPOSED), lambda t: F.when(t.rlike(FOLLOWER), _compose_clusters(t)).otherwise(t))).otherwise(text)


def bare(text: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks; syllables of Hangul, whose parts are no marks, stay whole. Null for null."""
    one_or_more = {k: v for k, v in _BARE.items() if v}
    return F.when(text.rlike(OTHER), _mapped(text, one_or_more, [k for k, v in _BARE.items() if not v])).otherwise(text)
