"""Personal data: patterns propose spans, checksums confirm them, context words
adjust the score.

Every span has a score: what its pattern and checksum are worth, more where a word nearby
speaks for the kind, less where one speaks against it. Base kinds (email, ip, card, phone)
are reported with their score whenever their own test holds. The method adds ``pan`` (card
numbers by Luhn inside longer runs of numbers, which the base kind drops), ``iban``
(mod 97), ``ssn`` (a shape with many accidental hits), ``key`` (secrets with a known
beginning, and private key blocks) and ``secret`` (long runs of letters and digits that look
drawn at random); these are reported if their score reaches ``THRESHOLD``, so context
decides about each of them. Patterns are written so that scanning is linear in the text: runs are entered only
at their start, and emails are found from their ``@``.

Defined cases: a null text is empty; texts are scanned whole; repeated rows stay
separate rows; an empty table gives an empty result; other columns are ignored by
``scan`` and kept by ``redact``. Spans count code points, their end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("pan", "iban", "ssn", "key", "secret")
CONTEXT_CHARS, FOR, AGAINST, THRESHOLD = 40, 0.3, 0.35, 0.6

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PAN = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9])")
SECRET_ENTROPY = 3.0  # bits a character; words and numbers that are written out have less
# By kind: what a confirmed span is worth, and the words that speak for and against it.
_KINDS = {
    "email": (0.9, r"e-?mail|contact|write", r"example"),
    "ip": (0.7, r"ip|host|server|address", r"version|release|section"),
    "card": (0.8, r"card|visa|master|credit|karte|carte|tarjeta", r"order|serial|isbn|invoice"),
    "phone": (0.8, r"phone|tel|call|mobile|fax", r"part|serial"),
    "pan": (0.6, r"card|visa|master|credit|karte|carte|tarjeta", r"order|serial|isbn|invoice"),
    "iban": (0.7, r"iban|account|konto|compte|cuenta|bank", r"order|serial|part"),
    "ssn": (0.4, r"ssn|social security", r"order|serial|part"),
    "key": (0.9, r"key|token|secret|credential", r"dummy|placeholder"),
    "secret": (0.4, r"api[ _-]?key|key|token|secret|password|passwd|pwd|bearer|credential|auth", r"sha1|sha256|md5|checksum|digest|commit|revision"),
}
_CONTEXT = {kind: tuple(re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.I) for words in both) for kind, (_, *both) in _KINDS.items()}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without spaces, digit by digit."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        for d in str(int(ch, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found = list(emails(text))
    if not re.search("[0-9]", text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def random_looking(run: str) -> bool:
    """Letters and digits, as mixed as drawn ones are."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= SECRET_ENTROPY


def iban_length(run: str) -> int:
    """How much of a run is an IBAN: words behind it may have been taken along. 0: nothing."""
    while True:
        if 15 <= len(run.replace(" ", "")) <= 34 and mod97(run.replace(" ", "")):
            return len(run)
        if " " not in run:
            return 0
        run = run.rpartition(" ")[0]


def proposed(text: str, base: list[Span]) -> list[Span]:
    """Spans of the added kinds that their own check confirms, by kind."""
    out: list[Span] = []
    if re.search("[0-9]{4}", text):
        cards = {at for kind, a, b in base if kind == "card" for at in range(a, b)}
        out += [("pan", *m.span()) for m in _PAN.finditer(text) if m.start() not in cards and luhn(re.sub("[ -]", "", m.group()))]
    if re.search("[0-9]{2}", text):
        out += [("iban", m.start(), m.start() + n) for m in _IBAN.finditer(text) if (n := iban_length(m.group()))]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text) if not re.match("000|666|9..|...-00|.*-0000", m.group())]
    out += [("key", *m.span()) for m in _KEY.finditer(text)]
    out += [("secret", *m.span()) for m in _SECRET.finditer(text) if random_looking(m.group())]
    return out


def score(text: str, span: Span) -> float:
    """What a confirmed span is worth, with the words around it."""
    kind, a, b = span
    near = text[max(0, a - CONTEXT_CHARS) : a] + "\n" + text[b : b + CONTEXT_CHARS]
    speaks_for, against = _CONTEXT[kind]
    return round(min(1.0, max(0.0, _KINDS[kind][0] + FOR * bool(speaks_for.search(near)) - AGAINST * bool(against.search(near)))), 2)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the added ones whose score reaches the threshold."""
    base = base_spans(text)
    return base, [s for s in proposed(text, base) if score(text, s) >= THRESHOLD]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the counts by base kind, the digest of the base spans, all spans, their scores
    in the same order, and how many there are (``n_found``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1):
                base, added = find(t.as_py() or "")
                kinds = [k for k, _, _ in base]
                said = _joined(base)
                scores = ",".join(f"{score(t.as_py(), s):.2f}" for s in base + added)
                rows.append((*(kinds.count(k) for k in BASE_KINDS), len(base + added), hashlib.sha256(said.encode()).hexdigest(), _joined(base + added), scores))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])],
                [key, *(f"n_{k}" for k in BASE_KINDS), "n_found", "base_sha256", "spans", "scores"],
            )

    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", n_found long, base_sha256 string, spans string, scores string"
    return source.mapInArrow(task, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets."""

    def blank(t: str) -> str:
        base, added = find(t)
        out, done = [], 0
        for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [t[done:a], f"[{kind}]"]
                done = b
        return "".join([*out, t[done:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [None if t is None else blank(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(task, docs.schema)
