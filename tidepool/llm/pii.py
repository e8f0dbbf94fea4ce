"""Operator 9: personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds (email, ip, card, phone); of digit groups beside each other every run that
may be a phone or a card is proposed. Those that meet the strict form of their
kind are taken as they are. Every other candidate is described by format and context features, scored by boosted trees, and
selected where its calibrated probability reaches the kind's threshold, which is set for a stated precision on held-out examples.
Of selected candidates that overlap each other or a strict span of any kind, the more probable stays (ties: the earlier, the longer).

The trees are trained here, on examples made by rule from a fixed seed (`examples`): forms that the strict patterns miss - other
phone and card groupings, numbers beside each other, addresses written with "at", IPv6 - among dates, versions, amounts and numbers of other kinds. The
model's size is fixed by its parameters.

Offsets are code points, ends exclusive. Null texts count as empty ones; repeated rows each give a row; an empty table gives an
empty one; `redact` keeps all other columns whatever their names. Texts are read whole, each scan being linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_of, lean, spread, table, text_blocks
from .boosting import Boosted, calibrate, threshold

KINDS = ("email", "ip", "card", "phone")
#: Held-out precision that the thresholds are set for.
PRECISION = 0.995
#: Characters of context on each side.
AROUND = 24

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Generators of candidates beyond the strict forms.
WORDED = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*+ ?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}+){1,4}", re.I)
SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
#: Endings of addresses that are met most.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "eu", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "co")
#: Digit groups that touch no letter, and what may stand between two groups of one number.
GROUP = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?![A-Za-z])")
GAP = re.compile(r"[\x20()./-]{1,2}")
#: Digits of a number of each kind.
SIZES = {"phone": (7, 15), "card": (13, 19)}
WORDS = {
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|tél|teléfono|llame|anruf)", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)", re.I),
    "card": re.compile(r"\b(?:card|visa|master|amex|credit|debit|carte|tarjeta|karte)", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|addr|from|login|ssh|node)", re.I),
    "other": re.compile(r"\b(?:isbn|order|invoice|version|date|page|vol|id|no|ref|price|total|part|serial|uhr|am|pm|usd|eur)\b|[$€£#%]", re.I),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The strict spans: by kind as listed, then by start; leftmost, not overlapping within a kind."""
    out: list[Span] = []
    floor = 0
    at = text.find("@")
    while at >= 0:
        # Local parts hold no "@", so that each "@" has one run to its left; a match cannot start before the last one's end.
        run = text[floor:at]
        start = floor + len(run.rstrip(LOCAL))
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """What may be personal data besides the strict spans; the spans may overlap, and one stretch may be of several kinds."""
    out: list[Span] = []
    low = text.lower()
    if "at" in low and any(x in low for x in ("(at)", "[at]", "{at}", " dot ", "(dot)", "[dot]", "{dot}")):
        out += [("email", *m.span()) for m in WORDED.finditer(text)]
    if DIGIT.search(text):
        if ":" in text:
            out += [("ip", *m.span()) for m in SIX.finditer(text) if DIGIT.search(m[0])]
        out += numbers(text)
    return out


def numbers(text: str) -> list[Span]:
    """All runs of consecutive digit groups with a phone's or a card's count of digits, so that numbers beside each other are each proposed;
    a run has 19 groups at most. A bracket and, for phones, a plus before the first group belong to it."""
    out: list[Span] = []
    groups = [m.span() for m in GROUP.finditer(text)]
    joined = [b[0] - a[1] <= 2 and GAP.fullmatch(text, a[1], b[0]) is not None for a, b in pairwise(groups)]
    most = max(hi for _, hi in SIZES.values())
    for i, (first, _) in enumerate(groups):
        n, j = 0, i
        start = first - 1 if text[first - 1 : first] == "(" and not text[first - 2 : first - 1].isalnum() else first
        while n <= most:
            n += groups[j][1] - groups[j][0]
            for kind, (lo, hi) in SIZES.items():
                if lo <= n <= hi:
                    plus = kind == "phone" and start > 0 and text[start - 1] == "+"
                    out.append((kind, start - plus, groups[j][1]))
            if j + 1 == len(groups) or not joined[j]:
                break
            j += 1
    return out


#: The digit group that a number goes on with on either side.
LAST = re.compile(r"(\+?\(?[0-9]+)([\x20()./-]{1,2})$")
NEXT = re.compile(r"^([\x20()./-]{1,2})([0-9]+)")


def _beside(side: re.Pattern, context: str) -> tuple[float, float, float]:
    """Digits of the group beside a number (0: there is none), what is between, and whether a plus stands there."""
    m = side.search(context)
    if not m:
        return 0.0, -1.0, 0.0
    group, gap = (m[1], m[2]) if side is LAST else (m[2], m[1])
    return float(sum("0" <= c <= "9" for c in group)), float(" ./-()".index(gap[0]) + 6 * (len(gap) > 1)), float("+" in group)


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", s)
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, float(luhn(digits)) if digits else 0.0,
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), s.count(":"), float("::" in s),
        float(s.startswith("00")), float(s.startswith("0")), int(digits[0]) if digits else -1, sum(c.isalpha() for c in s),
        s.lower().count("at)") + s.lower().count("at]") + s.lower().count("at}"), s.lower().count("dot"),
        *(float(bool(w.search(before))) for w in WORDS.values()), float(bool(WORDS["other"].search(after))),
        float(before[-1:].isspace() or not before), float(before[-1:] in "$€£#=_"), float(after[:1] in "%€$"),
        float(s.startswith("+")), float(re.split(r"[^a-z]+", s.lower())[-1] in ENDINGS), float("." in s.split(" ")[0]), *_beside(LAST, before), *_beside(NEXT, after), len({c for c in s if not c.isalnum()}),
    ]


def examples(n: int, seed: int) -> tuple[list[str], list[Span], np.ndarray]:
    """n texts made by rule, a candidate span in each, and whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(*"aeinorstl") for _ in range(int(rng.integers(2, 9))))
    prose = lambda k: " ".join(word() for _ in range(k))

    def card(k: int) -> str:
        head = pick("4", "5", "34", "37", "6011", "36", "", "") + num(k)
        head = head[: k - 1]
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def grouped(d: str, sizes: tuple[int, ...], by: str) -> str:
        out, i = [], 0
        for k in sizes:
            out.append(d[i : i + k])
            i += k
        return by.join(x for x in out if x)

    def beside() -> tuple[str, Span, bool] | None:
        """Two numbers beside each other, or one before a word that begins with a digit; a run of groups that is one of them or not."""
        parts = []
        for _ in range(2):
            kind = pick("phone", "phone", "card", "card", "ip", "other")
            by = pick(" ", "-")
            s = {
                "phone": lambda: pick(f"+{pick('1', '33', '49')} ({num(3)}) {num(3)}-{num(4)}", f"+1-{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"),
                "card": lambda: pick(card(16), card(16), grouped(card(16), (4, 4, 4, 4), by), grouped(card(15), (4, 6, 5), by)),
                "ip": lambda: ".".join(str(int(rng.integers(1, 256))) for _ in range(4)),
                "other": lambda: pick(num(int(rng.integers(1, 7))), num(16), num(12), f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}th", f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"FR{num(2)} {num(4)} {num(4)} {num(4)}"),
            }[kind]()
            parts.append((kind, s))
        text = f"{prose(3)} {pick('', '', 'tel ', 'card ', 'host ')}"
        true = []
        for kind, s in parts:
            true += [(kind, len(text), len(text) + len(s))] if kind in SIZES else []
            text += s + " "
        text += prose(3)
        found = numbers(text)
        good = bool(rng.integers(2))
        found = [s for s in found if (s in true) == good]
        return (text, pick(*found), good) if found else None

    texts, spans, y = [], [], []
    while len(texts) < n:
        if not rng.integers(3):
            if made := beside():
                texts.append(made[0])
                spans.append(made[1])
                y.append(made[2])
            continue
        kind, good = pick(*KINDS), bool(rng.integers(2))
        hint = pick(True, True, False)
        if kind == "phone":
            a, b = num(3), num(4)
            forms = [f"({num(3)}) {a}-{b}", f"{num(3)}-{a}-{b}", f"{num(3)}.{a}.{b}", f"{num(3)} {a} {b}", f"({num(3)}) {a} {b}", f"0{num(3)} {num(6)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(2)}/{num(7)}", f"00{pick('33', '34', '49', '1')} {num(2)} {num(3)} {num(4)}", f"00{pick('33', '34', '49')} {num(3)} {num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{pick('6', '7', '9')}{num(2)} {num(2)} {num(2)} {num(2)}"]
            bare = good and not rng.integers(5)  # plain digits are a phone's where the words before say so
            others = [num(int(rng.integers(7, 16))), num(10), f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}.{num(2)}.{pick('19', '20')}{num(2)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)} {num(5)}", f"{num(4)} {num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(2)} {num(1)} {num(4)} {num(2)}", card(15), grouped(card(15), (4, 6, 5), pick(" ", "-")), grouped(card(14), (4, 6, 4), " ")]
            s = num(10) if bare else pick(*(forms if good else others))
            said = ["tel", "phone", "call", "call me on", "mobile", "fax", "Tel.", "whatsapp", "telefon", "phone number"]
            lead = pick(*said) if bare or good and (hint or s[0] not in "(0") else pick("order", "invoice", "id", "isbn", "card", "amex", "on", word(), word()) if not good else word()
        elif kind == "card":
            s = pick(grouped(card(15), (4, 6, 5), pick(" ", "-")), card(15), grouped(card(16), (4, 4, 4, 4), pick(". ", "/", ".")), grouped(card(14), (4, 6, 4), " ")) if good else pick(num(13), num(14), num(17), num(19), f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(8)} {num(8)}")
            lead = pick("card", "visa", "credit card", "amex", "tarjeta") if good else pick("order", "serial", word(), word())
        elif kind == "ip":
            h = lambda: pick(*"0123456789abcdef") + "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(1, 4))))
            s = pick(":".join(h() for _ in range(8)), f"{h()}:{h()}::{h()}", f"fe80::{h()}:{h()}", f"2001:db8:{h()}::{h()}") if good else pick(f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:", ":".join(num(2) for _ in range(4)))
            lead = pick("host", "ip", "server", word()) if good else pick("at", "time", word(), "am")
        else:
            local = pick(f"{word()}.{word()}", f"{word()}{num(2)}", word(), f"{word()}_{word()}", f"{word()}.{word()}{num(1)}")
            site = pick(word(), f"{word()}-{word()}", f"{word()}{num(1)}")
            if good:
                by = pick(" (at) ", " [at] ", "(at)", "[at]", "{at}", " {at} ", " at ", " at ")
                dots = (" dot ", " [dot] ", " (dot) ") if by == " at " else (" (dot) ", " [dot] ", " dot ", "(dot)", "[dot]", ".", ".")
                dot = pick(*dots)
                s = local + by + site + dot + pick(pick(*ENDINGS), pick("com", "org", "net"), f"co{dot}uk", f"{word()}{dot}{pick(*ENDINGS)}")
            else:
                s = pick(f"{word()} at {site}.{word()}", f"{word()} at {site}.{pick(*ENDINGS)}", f"{word()} at {word()}. {word()}", f"{word()} at {word()} . {word()}", f"{word()} at {word()} dot {word()}x", f"{word()} at {word()} dot {word()}x")
            if s.startswith(".") or not WORDED.fullmatch(s):
                continue
            lead = pick("email", "contact", "write", "write to", "mail", word(), word()) if good else word()
            if rng.integers(6) == 0:
                s = s.upper()
        text = f"{prose(3)} {lead}{pick(' ', ': ')}{s} {prose(3)}"
        at = text.index(s)
        texts.append(text)
        spans.append((kind, at, at + len(s)))
        y.append(good)
    return texts, spans, np.array(y, float)


class Selector:
    """The trained trees, the calibration, and a threshold for each kind."""

    def __init__(self, n: int = 12_000, precision: float = PRECISION, seed: int = 7):
        texts, spans, y = examples(n, seed)
        x = np.array([features(t, s) for t, s in zip(texts, spans, strict=True)])
        fit, held = slice(0, n * 2 // 3), slice(n * 2 // 3, n)
        self.model = Boosted(rounds=60, depth=4).fit(x[fit], y[fit])
        scores = self.model.score(x[held])
        self.slope, self.offset = calibrate(scores, y[held])
        p = self._probability(scores)
        kinds = x[held][:, 0].astype(int)
        self.least = [max(0.5, threshold(p[kinds == k], y[held][kinds == k], precision)) for k in range(len(KINDS))]

    def _probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """All spans: the strict ones and the selected candidates that overlap none of them."""
        found = candidates(text)
        if not found:
            return base
        # Spans that look alike with all their context are scored once, in blocks of bounded size.
        alike: dict[tuple[str, str, int], int] = {}
        place, new = np.empty(len(found), np.int64), []
        for i, (kind, a, b) in enumerate(found):
            lo = max(0, a - AROUND)
            key = (kind, text[lo : b + AROUND], (a - lo) << 32 | (b - a))
            if (at := alike.get(key)) is None:
                at = alike[key] = len(new)
                new.append(found[i])
            place[i] = at
        prob = np.concatenate([self._probability(self.model.score(np.array([features(text, s) for s in new[i : i + 20_000]]))) for i in range(0, len(new), 20_000)])[place]
        ranked = sorted(((-p, s[1], s[1] - s[2], s) for p, s in zip(prob, found, strict=True) if p >= self.least[KINDS.index(s[0])]), key=lambda r: r[:3])
        kept: list[Span] = []
        taken = sorted((a, b) for _, a, b in base)
        import bisect

        for _, _, _, s in ranked:
            i = bisect.bisect_left(taken, (s[1], -1))
            # Strict spans of different kinds may overlap each other, so that a few to the left are looked at.
            if any(a < s[2] and s[1] < b for a, b in taken[max(0, i - len(KINDS)) : i + 1]):
                continue
            kept.append(s)
            bisect.insort(taken, (s[1], s[2]))
        return sorted([*base, *kept], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


@lru_cache(1)
def selector() -> Selector:
    return Selector()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) by kind as listed, then by start; a row for each row of `docs`."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])
    chosen = docs.sparkSession.sparkContext.broadcast(selector())  # of fixed size

    def shown(spans: list[Span]) -> list[dict]:
        return [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            base = [base_spans(t) for t in texts]
            spans = [chosen.value.select(t, b) for t, b in zip(texts, base, strict=True)]
            yield batch_of(schema, part.column(0), [shown(b) for b in base], [shown(s) for s in spans])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return spread(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(lean(run), f"doc_id bigint, base {kind}, spans {kind}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first span's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in `text` masked; a null text stays null, and a column n_chars follows the text."""
    chosen = docs.sparkSession.sparkContext.broadcast(selector())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            new = []
            for t, known in zip(texts, part.column(names.index("text")).is_valid().to_pylist(), strict=True):
                spans = chosen.value.select(t, base_spans(t))
                new.append((masked(t, spans) if spans else t) if known else None)
            columns = part.columns
            i = names.index("text")
            columns[i] = pa.array(new, part.schema.field(i).type)
            if "n_chars" in names:
                j = names.index("n_chars")
                columns[j] = pa.array([None if t is None else len(t) for t in new], part.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return spread(docs).mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
