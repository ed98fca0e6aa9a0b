"""Personal data by a semi-Markov conditional random field.

Base spans come from the fixed patterns.  Around digits and address-like words
that no base span explains, a zone of text is cut into tokens and every segment
of tokens that could be an entity is scored as a whole (digit count, grouping,
check digit, separators, context words, clean ends).  A dynamic programme over
the tokens picks boundaries and types of a whole zone at once; only the length of
a segment is bounded, neither a zone nor the entities in it.  Every search takes
time in proportion to the text, whatever its tokens are.  The weights are
fitted here, by the conditional log-likelihood of zones that a small generator
writes; no row of any table is learned from.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans.  An address is found from its "@": the name is
# the run of NAME before it, DOMAIN what follows.  A run of digits that no address
# begins with has none further on, so IP looks at the start of a run only.
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Most tokens of a segment, and most characters: the longest address that mail takes and its signs.
SEGMENT_TOKENS = 24
SEGMENT_CHARS = 320
CONTEXT = 28
#: Log-odds that a decoded path must have over the path without entities, an entity.
MARGIN = 1.0

_DIGIT = re.compile(r"[0-9]")
#: What opens a zone: seven digits with few signs between, or groups of hex and colons,
_NUMBERS = re.compile(
    r"\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}"
    r"|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
)
#: and a written-out "at" after a name and before words with dots.
_WRITTEN_AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT|@|arobase)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|\x20@\x20?|@\x20")
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?[\[({]?\x20?(?:\.|dot|DOT|point|punkt|punto)\x20?[\])}]?\x20?[A-Za-z0-9-]++){1,3}")
_MAYBE_ADDRESS = re.compile(r"@\x20|\x20@|[\[({]\x20?(?:at|AT|@|arobase)\x20?[\])}]|[\x20\[({](?:dot|DOT|point|punkt|punto)[\x20\])}]")
_SHAPE = str.maketrans("012345678", "9" * 9)
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\w\s]|\s|\w")
_TLD = frozenset("com org net de fr es io edu gov co uk info eu us ch at it".split())
_AT, _DOT = frozenset(("at", "@", "arobase")), frozenset((".", "dot", "point", "punkt", "punto"))
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|kontakt|correo|courriel|write to|reach|adresse|mailto", re.I),
    "ip": re.compile(r"\bip\b|ipv6|host|server|addr|network|netz|réseau|red\b", re.I),
    "card": re.compile(r"card|visa|master|credit|kredit|carte|tarjeta|amex|payment", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|mobil|cell|fax|ruf|handy|téléphone|teléfono|móvil|whatsapp|sms", re.I),
}
_NEGATIVE = re.compile(r"order|invoice|isbn|version|id\b|no\.|nr\.|ref|sku|date|datum|bestell|commande|pedido|ticket|serial|build|row|page", re.I)


_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = []
    at, free = text.find("@"), 0  # the next name starts at ``free`` or later
    while at >= 0:
        name = at - free - len(text[free:at].rstrip(NAME))
        if name and (m := DOMAIN.match(text, at + 1)):
            out.append((0, at - name, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


@lru_cache(maxsize=1 << 16)
def _number_features(kind: int, shape: str, zero: bool, checks: bool) -> tuple[str, ...] | None:
    """Features of a card or phone number; ``shape`` has 9 for each digit, ``zero``
    says whether the first is 0 and ``checks`` whether Luhn's rule holds."""
    if not (shape[0] in "9(" or shape[0] == "+" and kind == 3) or shape[-1] != "9" or not re.fullmatch(r"\+?[9\x20().\-/]+", shape):
        return None
    n = shape.count("9")
    if kind == 2 and not 13 <= n <= 19 or kind == 3 and not 7 <= n <= 15:
        return None
    groups = [len(g) for g in re.findall("9+", shape)]
    seps = set(shape) - {"9"}
    out = [f"n{n}" if n in (7, 8, 9, 10, 11, 12, 16) else "n-other", f"groups{min(5, len(groups))}"]
    if kind == 2:
        out += ["luhn" if checks else "no-luhn", "fours" if groups[:3] == [4, 4, 4] else "one" if len(groups) == 1 else "odd-groups"]
    else:
        out.append("parens" if re.match(r"(\+9{1,3}\x20?)?\(9{2,5}\)", shape) else "no-parens")
        out.append("3-3-4" if groups in ([3, 3, 4], [1, 3, 3, 4]) else "3-4" if groups == [3, 4] else "date" if groups in ([4, 2, 2], [2, 2, 4]) else "twos" if set(groups) == {2} else "others")
        out.append("area0" if zero else "area")
        out.append("luhn16" if n >= 13 and checks else "-")
    out.append("sep" + ("mixed" if len(seps) > 1 else seps.pop() if seps else "0"))
    return tuple(out)


def _address_features(span: str) -> list[str] | None:
    tokens = [t.lower() for t in _TOKEN.findall(span) if not t.isspace()]
    signs = [t for t in tokens if t not in "[](){}"]
    at = [i for i, t in enumerate(signs) if t in _AT and 0 < i < len(signs) - 1]
    if len(at) != 1 or not 0 < at[0] < len(signs) - 3 or not any(t in _DOT for t in signs[at[0] + 2 :]) or not signs[-1].isalpha() or signs[-1] in _DOT:
        return None
    if not span[0].isalnum() or not span[-1].isalnum():
        return None
    dots = [i for i, t in enumerate(signs) if t in _DOT and i > at[0]]
    if any(b - a < 2 for a, b in zip([at[0], *dots], [*dots, len(signs)], strict=True)):
        return None
    bare_at = "@" not in signs and not re.search(r"[\[({]\s?(at|arobase)\s?[\])}]", span, re.I)
    if bare_at and all(signs[i] == "." for i in dots) or re.search(r"\.\s|\s\.", span):
        return None  # "look at this.example" and ends of sentences
    out = ["tld" if signs[-1] in _TLD else "odd-tld", "brackets" if any(c in "[({" for c in span) else "bare"]
    out.append("sign" if "@" in signs else "word-at")
    out.append("word-dot" if any(t in _DOT and t != "." for t in signs) else "sign-dot")
    name = span.split("@")[0].split("[")[0].split("(")[0].split("{")[0].split(" at ")[0].split(" AT ")[0].strip()
    out.append("name-spaced" if " " in name else "name-whole")
    out.append("long" if len(tokens) > 14 else "short")
    return out


def _group_features(span: str, left: str, after: str) -> list[str] | None:
    if span.count(":") < 3 or not re.fullmatch(r"[0-9A-Fa-f:]+", span) or re.match("[0-9A-Za-z:]", left) or re.match(":?[0-9A-Za-z]|::", after):
        return None
    groups = span.split(":")
    out = [f"groups{min(8, len(groups))}" if "" not in groups else "compressed", "hex" if re.search("[A-Fa-f]", span) else "decimal"]
    out.append("all2" if all(len(g) == 2 for g in groups) else "mixed")
    out.append("long-group" if max(map(len, groups)) > 2 else "short-groups")
    return out


@lru_cache(maxsize=1 << 12)
def _before_features(kind: int, before: str) -> tuple[str, ...]:
    """Features of the characters before a span."""
    out = ["context" if _CONTEXT[KINDS[kind]].search(before) else "no-context"]
    if _NEGATIVE.search(before):
        out.append("negative")
    left = before[-1:]
    out.append("left-clean" if not left or left.isspace() or left in "([{\"':;,=<" else "left-joined")
    return tuple(out)


def _kind_features(kind: int, text: str, start: int, end: int) -> list[str] | None:
    """Names of the whole-span features; None where the span can't be of the kind."""
    span = text[start:end]
    if kind == 0:
        own = _address_features(span)
    elif kind == 1:
        own = _group_features(span, text[start - 1 : start], text[end : end + 2])
    else:
        shape = span.translate(_SHAPE)
        n = shape.count("9")
        own = _number_features(kind, shape, span[shape.find("9")] == "0", n >= 13 and luhn(_digits(span)))
        if own is not None:
            own = [*own, "plus" if span[0] == "+" else "after-plus" if "+" in text[max(0, start - 4) : start] else "no-plus"]
    if own is None:
        return None
    right = text[end : end + 1]
    clean = "right-clean" if not right or right.isspace() or right in ")]}\"',;.!?>:" else "right-joined"
    return [f"{KINDS[kind]}:{x}" for x in ("bias", *own, *_before_features(kind, text[max(0, start - CONTEXT) : start]), clean)]


def _bounds(text: str, start: int, end: int) -> list[int]:
    """Token boundaries of a zone."""
    bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    if bounds[-1] != end:
        bounds.append(end)
    return bounds


def _candidates(text: str, bounds: list[int]) -> Iterator[tuple[int, int, int, list[str]]]:
    """Candidate segments of a zone (from, to, kind, features)."""
    tokens = [text[a:b] for a, b in zip(bounds, bounds[1:])]
    digits, colons, ats = [0], [0], [0]  # before each boundary; what a kind must have is counted before its features are
    for t in tokens:
        digits.append(digits[-1] + len(_DIGIT.findall(t)))
        colons.append(colons[-1] + (t == ":"))
        ats.append(ats[-1] + (t.lower() in _AT))
    for i, first in enumerate(tokens):
        if first.isspace():
            continue
        for j in range(i + 1, min(len(bounds), i + SEGMENT_TOKENS + 1)):
            n = bounds[j] - bounds[i]
            if n > SEGMENT_CHARS:
                break
            if n < 6 or tokens[j - 1].isspace():
                continue
            many = digits[j] - digits[i]
            for kind, may in enumerate((ats[j] > ats[i], colons[j] - colons[i] >= 3, 13 <= many <= 19, 7 <= many <= 15)):
                if may and (f := _kind_features(kind, text, bounds[i], bounds[j])) is not None:
                    yield i, j, kind, f


def lattice(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
    """Token boundaries of a zone, and its candidate segments (from, to, kind, features)."""
    bounds = _bounds(text, start, end)
    return bounds, list(_candidates(text, bounds))


def _forward(n: int, segments, scores) -> list[float]:
    """Log-sums over paths to each boundary."""
    at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (i, j, _, _), s in zip(segments, scores, strict=True):
        at[j].append((i, s))
    a = [0.0] * n
    for j in range(1, n):
        a[j] = _total([a[j - 1], *(a[i] + s for i, s in at[j])])
    return a


def decode(n: int, segments, scores) -> list[int]:
    """Places of the segments on the best path."""
    at: list[list[int]] = [[] for _ in range(n)]
    for k, (_, j, _, _) in enumerate(segments):
        at[j].append(k)
    best, back = [0.0] * n, [-1] * n
    for j in range(1, n):
        best[j] = best[j - 1]
        for k in at[j]:
            s = best[segments[k][0]] + scores[k] - MARGIN
            if s > best[j]:
                best[j], back[j] = s, k
    j, out = n - 1, []
    while j > 0:
        k = back[j]
        if k < 0:
            j -= 1
        else:
            out.append(k)
            j = segments[k][0]
    return out[::-1]


def _generated(seed: int, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the spans (kind, start, end) in them."""
    r = random.Random(seed)
    syllables = "an er the on in ti es re at ou el la de un que der sch lich ion ment".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        x = r.choice("3456") + d(r.choice((14, 14, 14, 13)))
        x += next(c for c in "0123456789" if luhn(x + c))
        s = r.choice(("", " ", "-", ".", "/"))
        return s.join(x[i : i + 4] for i in range(0, len(x), 4)) if len(x) == 16 else x

    def mail() -> str:
        at = r.choice((" [at] ", " (at) ", "[at]", "(at)", " at ", " @ ", " {at} ", "@ ", " AT "))
        dot = r.choice((" [dot] ", " (dot) ", "[dot]", " dot ", " DOT ", "(dot)")) if at.strip() not in ("@",) or r.random() < 0.5 else "."
        if at.strip()[0] in "[({" and r.random() < 0.3:
            dot = "."
        name = word() + r.choice(("", d(2), "." + word(), "_" + word()))
        return name + at + r.choice((word(), "mail" + d(1), word() + dot + word())) + dot + r.choice(sorted(_TLD))

    phones = (
        lambda: f"({r.randint(200, 999)}) {d(3)}-{d(4)}", lambda: f"{r.randint(200, 999)}-{d(3)}-{d(4)}", lambda: f"{r.randint(200, 999)}.{d(3)}.{d(4)}",
        lambda: f"{r.randint(200, 999)} {d(3)} {d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"00{d(2)} {d(3)} {d(7)}", lambda: f"0{d(3)}/{d(7)}",
        lambda: f"1-{r.randint(200, 999)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"({r.randint(200, 999)}){d(3)}-{d(4)}",
        lambda: f"+{d(1)} ({r.randint(200, 999)}) {d(3)}-{d(4)}", lambda: f"+{d(1)} ({r.randint(200, 999)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}",
    )
    ips = (lambda: ":".join(hexa(4) for _ in range(8)), lambda: ":".join(hexa(r.randint(1, 4)) for _ in range(4)) + "::" + hexa(r.randint(1, 4)), lambda: "fe80::" + ":".join(hexa(4) for _ in range(4)))
    none = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", lambda: f"{r.randint(0, 23):02}:{d(2)}:{d(2)}:{d(2)}",
        lambda: d(r.randint(7, 12)), lambda: d(16), lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{r.randint(1900, 2000)}-{r.randint(2001, 2030)}", lambda: f"{d(1)}.{d(2)}.{d(4)}", lambda: f"978-3-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()} dot {word()} {word()}", lambda: ":".join(hexa(2) for _ in range(6)), lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)} {d(2)}.{d(2)}",
    )
    cue = {0: ("mail", "contact", "email:"), 1: ("ip", "host", "server:"), 2: ("card", "visa", "credit card:"), 3: ("tel", "phone", "call", "mobile:")}
    for _ in range(n):
        parts, spans, at = [], [], 0

        def put(s: str) -> None:
            nonlocal at
            parts.append(s)
            at += len(s)

        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(1, 5)):
                put(word() + " ")
            kind = r.choice((0, 0, 1, 2, 3, 3, 4, 4, 4))
            if kind == 4:
                if r.random() < 0.4:
                    put(r.choice(("order ", "ref ", "isbn ", "version ", "id ", "date ")))
                put(r.choice(none)() + " ")
                continue
            if r.random() < 0.5:
                put(r.choice(cue[kind]) + " ")
            s = mail() if kind == 0 else r.choice(ips)() if kind == 1 else card() if kind == 2 else r.choice(phones)()
            spans.append((kind, at, at + len(s)))
            put(s)
            put(r.choice((" ", ". ", ", ", "\n")))
            if s[0] == "+" and r.random() < 0.7:  # digits that a greedy pattern would run on into
                put(r.choice((f"{d(3)}.{d(2)}.{d(3)}.{d(2)} ", f"{d(8)} ", f"{d(4)} {d(4)} {d(4)} ")))
        for _ in range(r.randint(1, 4)):
            put(word() + " ")
        yield "".join(parts), spans


@lru_cache(maxsize=4)
def fitted(seed: int = 7, texts: int = 500, rounds: int = 8, rate: float = 0.25, decay: float = 1e-3) -> dict[str, float]:
    """Weights by gradient ascent on the conditional log-likelihood."""
    zones = []
    for text, spans in _generated(seed, texts):
        for start, end in zones_of(text, []):
            bounds, segments = lattice(text, start, end)
            gold = {(s, e, k) for k, s, e in spans}
            if segments:
                zones.append((len(bounds), segments, [(bounds[i], bounds[j], k) in gold for i, j, k, _ in segments]))
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(zones)
        for n, segments, gold in zones:
            scores = [sum(w.get(f, 0.0) for f in fs) for _, _, _, fs in segments]
            a = _forward(n, segments, scores)
            mirrored = [(n - 1 - j, n - 1 - i, k, f) for i, j, k, f in segments]
            b = _forward(n, mirrored, scores)
            z = a[n - 1]
            grad: dict[str, float] = {}
            for (i, j, _, fs), s, told in zip(segments, scores, gold, strict=True):
                p = math.exp(a[i] + s + b[n - 1 - j] - z)
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + told - p
            for f, g in grad.items():
                g -= decay * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(g2[f])
    return w


def _total(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _openings(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may hold numbers or written-out addresses, by their start."""
    if _DIGIT.search(text) or "::" in text:
        yield from (m.span() for m in _NUMBERS.finditer(text))
    if _MAYBE_ADDRESS.search(text):
        free = 0
        for m in _WRITTEN_AT.finditer(text):
            start = free + len(text[free : m.start()].rstrip(NAME))
            if start < m.start() and (after := _WRITTEN_DOMAIN.match(text, m.end())):
                yield start, after.end()
            free = m.start() + 1


def zones_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of the text that the base spans don't explain and may hold more;
    those that overlap are one."""
    whole: list[list[int]] = []
    for start, end in sorted(_openings(text)):
        if whole and start < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end])
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[int, int]] = []
    k = 0
    for start, end in whole:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        at = k
        while at < len(taken) and taken[at][0] < end:  # what of it no base span covers
            if taken[at][0] - start >= 6:
                out.append((start, taken[at][0]))
            start = max(start, taken[at][1])
            at += 1
        if end - start >= 6:
            out.append((start, end))
    return out


def find_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added) spans of a text; added ones don't overlap base ones."""
    base = base_spans(text)
    added = []
    for start, end in zones_of(text, base):
        bounds, segments, scores = _bounds(text, start, end), [], []
        for i, j, kind, fs in _candidates(text, bounds):
            s = sum(weights.get(f, 0.0) for f in fs)
            if s > MARGIN:  # no other is on a best path; a long zone's needn't be held
                segments.append((i, j, kind, ()))
                scores.append(s)
        added += [(segments[k][2], bounds[segments[k][0]], bounds[segments[k][1]]) for k in decode(len(bounds), segments, scores)]
    return base, added


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the number of base spans by kind
    (n_email, n_ip, n_card, n_phone), base_sha256, spans (base and added, as
    kind:start:end in code points) and n_added.

    Null and empty texts have no spans.  Rows that repeat a doc_id stay apart.
    Long texts are searched whole, in time that grows with their length alone;
    an added span has SEGMENT_TOKENS tokens and SEGMENT_CHARS characters at most.
    Other columns, whatever their names, aren't read.  No rows give no rows.
    """
    weights = dict(fitted()) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for t in rows.column(1):
                base, added = find_spans(t.as_py() or "", weights)
                n = np.bincount([k for k, _, _ in base], minlength=4).tolist() if base else [0] * 4
                out.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added), len(added)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; all
    columns are kept, null texts stay null.  Of overlapping spans the first
    counts, and the text up to the end of the last is replaced."""
    weights = dict(fitted()) if weights is None else weights

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not text:
                return text
            base, added = find_spans(text, weights)
            out, at = [], 0
            for start, end, kind in sorted((s, e, k) for k, s, e in base + added):
                if start >= at:
                    out += [text[at:start], f"<{KINDS[kind]}>"]
                at = max(at, end)
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", clean(F.col("text").cast("string")))
