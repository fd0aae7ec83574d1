"""Personal data by a semi-Markov conditional random field over whole-span features.

Base spans are fixed patterns. The model then reads every region of a text that can hold an entity (neighbouring words with a
digit or an at sign; elsewhere every segment is outside, so regions decode alone without changing the result). A region
is cut into runs of digits, runs of letters and single symbols. Candidate segments are bounded entities: at most MAX_TOKENS tokens and
MAX_CHARS characters, either one word around an at sign or 7 to 24 digits in at most 7 groups without letters. They get a type and
a score from features of the whole span, outside tokens score zero, and dynamic programming over segment ends picks
boundaries and types together. Weights are fitted by maximum likelihood (forward-backward over segments) on generated
examples and look-alikes (dates, times, versions, amounts), on the driver, the same every time. Segments clear of base spans are added to them.

Defined cases: null text is empty; repeated rows stay repeated; texts are read whole, and the work is linear in their length: every pattern scans
a run of digits or letters once, and spans are compared in order of their starts; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty
from .spans import clear_of

#: The kinds in their listed order and their patterns. An address is found from its at sign (see emails), and possessive runs of an
#: IP start where a run of digits does: both match what the plain patterns match, leftmost and without overlap, but read a run once.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS, MAX_CHARS = 24, 254  # the longest entity
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS = 7, 24, 7  # of an entity without an at sign
TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\S")
TRIGGER = re.compile(r"[0-9@]\S*")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The plain pattern's matches: before each at sign the run of local characters that no earlier match has, after it a domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; kind as its place in KINDS."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if text.count(".") >= 3:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:  # 19 digits with separators at most
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = 0
            for c in m[0]:
                n += "0" <= c <= "9"
                if n > 15:
                    break
            if 10 <= n <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words, one space apart, that each hold a digit or an at sign."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        a = m.start()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        if end >= 0 and a == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if end >= 0:
            yield start, end
        start, end = a, m.end()
    if end >= 0:
        yield start, end


_GROUPS = re.compile(r"[0-9]+")
_DATED = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-./])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[01]?[0-9]\2(?:19|20)[0-9]{2})(?![0-9])")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PHONE_CHARS = re.compile(r"\+?[0-9().\x20-]+")


def span_features(span: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate span and the characters beside it."""
    digits = digits_of(span)
    n = len(digits)
    groups = "-".join(str(len(g)) for g in _GROUPS.findall(span)) if n < 24 else "long"
    at = span.count("@")
    out = ["bias", f"digits:{min(n, 20)}", f"letters:{any(c.isalpha() for c in span)}", f"at:{min(at, 2)}"]
    if n < MOST_DIGITS and not at and (m := _DATED.search(span)):
        out.append(f"dated:{m.start() > 0}:{span[0] == '+'}")
    if at == 1:
        local, _, domain = span.partition("@")
        out.append(f"mail:{bool(_LOCAL.fullmatch(local))}:{bool(_DOMAIN.fullmatch(domain))}:{domain.rsplit('.', 1)[-1].isalpha()}")
    elif not out[2].endswith("True"):
        out.append(f"groups:{groups}")
        out.append(f"luhn:{14 <= n <= 19 and luhn(digits)}:{n >= 13}")
        dots = span.count(".")
        out.append(f"octets:{dots == 3 and len(span) - n == 3 and groups.count('-') == 3 and _octets(span)}")
        out.append(f"phone:{bool(_PHONE_CHARS.fullmatch(span))}:{span[0] == '+'}:{span.count('(') == span.count(')')}:{10 <= n <= 15}")
        out.append(f"split:{'-'.join(sorted(set(span) - set('0123456789')))[:8]}")
    else:
        out.append("words")
    out.append(f"ends:{span[0].isalnum() or span[0] in '+('}:{span[-1].isalnum()}")
    goes_on = after[:1].isalnum() or after[:1] == "@" or (after[:1] in ("-", ".") and after[1:].isalnum())
    out.append(f"edge:{before.isalnum() or before in '.-@+'}:{goes_on}:{at == 1}")
    return out


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """A region's tokens, and its candidate segments (first token, token after the last, features)."""
    tokens = [(m.start(), m.end()) for m in TOKENS.finditer(text, start, end)]
    digit = [text[a] in "0123456789" for a, _ in tokens]
    found = []
    for i, (a, e) in enumerate(tokens):
        first = text[a]
        if not (first.isalnum() or first in "+(_"):
            continue
        digits, groups, at, letters, odd, last = 0, 0, 0, False, False, e
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            c, b = tokens[j]
            if b - a > MAX_CHARS or (at or letters) and c > last:
                break  # an address is one word
            sign = text[c]
            if digit[j]:
                digits += b - c
                groups += 1
            elif sign == "@":
                at += 1
            elif sign.isalpha():
                letters = True
            else:
                odd = odd or sign not in "().-/" and j > i  # only an address can have other symbols
            if at > 1 or c > last and odd:
                break
            last = b
            number = not letters and not odd and digit[j] and LEAST_DIGITS <= digits <= MOST_DIGITS and groups <= MOST_GROUPS
            if b - a >= 7 and (at and text[b - 1].isalnum() or not at and number):
                found.append((i, j + 1, span_features(text[a:b], text[a - 1] if a else " ", text[b : b + 2])))
    return tokens, found


def _score(weights: dict[str, list[float]], features: list[str]) -> list[float]:
    total = [0.0] * len(KINDS)
    for f in features:
        w = weights.get(f)
        if w is not None:
            for k in range(len(KINDS)):
                total[k] += w[k]
    return total


def decode(text: str, start: int, end: int, weights) -> list[tuple[int, int, int]]:
    """The best cut of a region: (start, kind, end) of its entities."""
    tokens, cands = segments(text, start, end)
    n = len(tokens)
    ending: list[list] = [[] for _ in range(n + 1)]
    for i, j, feats in cands:
        scores = _score(weights, feats)
        k = max(range(len(KINDS)), key=scores.__getitem__)
        if scores[k] > 0:
            ending[j].append((i, k, scores[k]))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ending[j]:
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((tokens[i][0], k, tokens[j - 1][1]))
            j = i
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values))


def _gradient(n: int, cands, gold: set[tuple[int, int, int]], weights, step: float) -> None:
    """One ascent step of the log-likelihood of a region's true cut."""
    ending: list[list] = [[] for _ in range(n + 1)]
    scored = [(i, j, f, _score(weights, f)) for i, j, f in cands]
    for c in scored:
        ending[c[1]].append(c)
    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, _, _, sc in ending[j] for s in sc)])
    rest = [0.0] * (n + 1)
    starting: list[list] = [[] for _ in range(n + 1)]
    for c in scored:
        starting[c[0]].append(c)
    for i in range(n - 1, -1, -1):
        rest[i] = _log_sum([rest[i + 1], *(rest[j] + s for _, j, _, sc in starting[i] for s in sc)])
    for i, j, feats, sc in scored:
        for k in range(len(KINDS)):
            p = math.exp(min(0.0, ahead[i] + sc[k] + rest[j] - ahead[n]))
            d = step * (((i, j, k) in gold) - p)
            if abs(d) > 1e-6:
                for f in feats:
                    weights.setdefault(f, [0.0] * len(KINDS))[k] += d


def _with_check_digit(rng: random.Random, n: int, valid: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    good = next(d for d in "0123456789" if luhn(body + d))
    return body + (good if valid else rng.choice([d for d in "0123456789" if d != good]))


def examples(seed: int = 7, n: int = 600) -> list[tuple[str, int, int, int]]:
    """(text, kind or -1, start, end): one generated entity, or a look-alike, in a little context."""
    rng, out = random.Random(seed), []
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdeghilmnoprstuvwy") for _ in range(rng.randint(2, 8)))
    for x in range(n):
        kind, form = x % 6, rng.randrange(6)
        if kind == 0:
            host = rng.choice([f"mail{num(1)}.{word()}.com", f"{word()}.org", f"{word()}-{word()}.{rng.choice(['net', 'de', 'es'])}"])
            s = rng.choice([f"{word()}.{num(2)}", f"{word()}_{word()}", word(), f"{word()}+{word()}", f"{word()}{num(3)}"]) + "@" + host
        elif kind == 1:
            s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == 2:
            d = _with_check_digit(rng, rng.choice([16, 16, 16, 15, 19]), True)
            sep = ["", " ", "-", ".", "", " "][form]
            s = sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) != 15 else f"{d[:4]}{sep}{d[4:10]}{sep}{d[10:]}"
        elif kind == 3:
            s = [f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{rng.choice(['49', '33', '34', '44'])} {num(3)} {num(7)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(2)} {num(4)} {num(4)}"][form]
        else:  # look-alikes
            s = [f"{num(4)}-{num(2)}-{num(2)}", f"{rng.randint(256, 999)}.{num(2)}.{num(1)}.{num(2)}", _with_check_digit(rng, 16, False), num(rng.randint(1, 9)), f"v{num(1)}.{num(2)}.{num(1)}", f"@{word()}"][form]
            if rng.random() < 0.25:
                s = "".join(rng.choice("0123456789abcdef") for _ in range(40))
                s = s[:9] + num(11) + s[9:]
            elif rng.random() < 0.4:
                y, mo, d, h = f"{rng.choice(['19', '20'])}{num(2)}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}", f"{rng.randint(0, 23):02}"
                c = rng.choice("-./")
                s = [f"{y}{c}{mo}{c}{d} {h}:{num(2)}", f"{y}{c}{mo}{c}{d} {h}", f"{y}.{mo}.{d}.{h}", f"{d}{c}{mo}{c}{y} {h}.{num(2)}", f"{y}{c}{mo}{c}{d} {y}{c}{mo}{c}{d}", f"{y}{mo}{d} {h}{num(2)}"][form]
            elif rng.random() < 0.5:
                s = [f"{num(1)},{num(3)},{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(8)}{word()}{num(6)}", f"{num(5)}-{num(3)}", f"#{num(6)}/{num(4)}", f"{num(3)} {num(4)} {num(2)}"][form]
            kind = -1
        lead, tail = rng.choice([word() + " ", word() + " (", "", word() + ': "']), rng.choice([" " + word(), ".", ",", "!!", "%%%", '"', ""])
        out.append((lead + s + tail, kind if kind < 4 else -1, len(lead), len(lead) + len(s)))
    return out


@lru_cache(1)
def trained(epochs: int = 8) -> dict[str, list[float]]:
    """The fitted weights: feature -> one weight for each kind."""
    weights: dict[str, list[float]] = {}
    ready = []
    for text, kind, a, b in examples():
        for start, end in regions(text):
            tokens, cands = segments(text, start, end)
            at = {s: i for i, (s, _) in enumerate(tokens)}
            to = {e: i + 1 for i, (_, e) in enumerate(tokens)}
            gold = {(at[a], to[b], kind)} if kind >= 0 and a in at and b in to else set()
            ready.append((len(tokens), cands, gold))
    rng = random.Random(11)
    for epoch in range(epochs):
        rng.shuffle(ready)
        for n, cands, gold in ready:
            _gradient(n, cands, gold, weights, 0.3 / (1 + epoch * 0.3))
    return weights


def all_spans(text: str, weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those that the model adds."""
    base = base_spans(text)
    added = []
    for start, end in regions(text):
        if end - start >= 7:
            added += decode(text, start, end, weights)
    added = clear_of(base, added)
    return base, sorted(base + added) if added else base


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base spans' counts and digest, spans (all of them) and n_added for every row of docs."""
    bounded_batches(docs.sparkSession)
    weights = trained()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = all_spans(t, weights) if "@" in t or any(c in t for c in "0123456789") else ([], [])
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col(key), F.pandas_udf(run, FOUND)(text_or_empty(text)).alias("s")).select(key, "s.*")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
