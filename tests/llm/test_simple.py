"""op3, op5 and op6 against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspan.llm import chat, pii, quality, queries

from .cases import documents, odd_texts

WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def check_quality(rows, texts):
    for r in rows:
        n, chars, symbols, dup, rep = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_quality(rows, texts)


def test_quality_odd(spark):
    texts = [*odd_texts(), "a b c a b c", "a a a a", "x\ny\nx\n \nx", "a b c d"]
    docs = documents(spark, texts).withColumns({"measured": F.lit(1), "fail_bits": F.lit("x")})
    check_quality(quality.verdicts(quality.ledger(docs), "v2").collect(), texts)
    assert quality.keep(docs).columns == docs.columns
    assert quality.ledger(docs.limit(0)).count() == 0


def test_quality_ablations(spark):
    rows = [(0, 0), (1, 1), (2, 1), (3, 3), (4, 2)]
    ledger = spark.createDataFrame(rows, "doc_id long, fail_bits long")
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(ledger, "base").collect()}
    assert got == {"few_words": (3, 2), "repeated_windows": (2, 1)}


def plain_spans(text):
    """The contract's expressions, tried as they stand."""
    t, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.b@-+0129 ()_é\n", max_size=60))
def test_base_spans_any(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op5_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS]


def test_pii_recall():
    """Planted among words: nine of ten are found at least, and words alone give nothing."""
    rng = random.Random(6)
    words = ["the", "of", "nd", "rthou", "heitheit", "ciónado", "Retionly", "42", "1,000", "x-ray", "2024"]
    filler = lambda: " ".join(rng.choices(words, k=40))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def iban():
        bank = digits(18)
        return next(c for k in range(2, 99) if pii.mod97(c := f"DE{k:02d}{bank}"))

    makers = {
        "email": lambda: f"{filler()[:3].strip()}.{digits(2)}@mail{digits(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "iban": iban, "ssn": lambda: f"ssn {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "card": lambda: next(c for c in (digits(16) for _ in range(1000)) if pii.luhn(c)), "secret": lambda: f'token = "{rng.randbytes(20).hex()}"', "key": lambda: "ghp_" + rng.randbytes(18).hex(),
    }
    for kind, make in makers.items():
        found = sum(any(k in (kind, "pan" if kind == "card" else kind) for part in pii.find(f"{filler()} {make()} {filler()}") for k, _, _ in part) for _ in range(100))
        assert found >= 90, (kind, found)
    assert not any(part for _ in range(200) for part in pii.find(filler()))


def test_pii_checks_and_context(spark):
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    base, added = pii.find("IBAN GB82 WEST 1234 5698 7654 32, no ssn: 123-45-6789, é a@b.co")
    assert [k for k, _, _ in added] == ["iban", "ssn"] and ("email", 57, 63) in base
    assert pii.find("order 123-45-6789 of parts")[1] == []
    # context decides about each added kind, for and against
    number, hexes = "GB82WEST12345698765432", hashlib.sha1(b"x").hexdigest()
    assert pii.find(f"see {number} .")[1] and not pii.find(f"part {number} .")[1]
    assert pii.find(f'token = "{hexes}"')[1] == [("secret", 9, 49)] and not pii.find(f"commit {hexes} of")[1] and not pii.find(f"see {hexes} of")[1]
    assert pii.find("AKIA" + "A1B2" * 4)[1] and not pii.find("dummy " + "AKIA" + "A1B2" * 4)[1]
    assert pii.score("card 4111 1111 1111 1111", ("card", 5, 24)) > pii.score("order 4111 1111 1111 1111", ("card", 6, 25))
    docs = documents(spark, [*odd_texts(), "mail a@b.co or 4111 1111 1111 1111"]).withColumn("spans", F.lit(1))
    out = pii.scan(docs).collect()
    assert len(out) == docs.count() and out[0].spans == ""
    assert pii.redact(docs).orderBy(F.desc("doc_id")).first().text == "mail [email] or [card]"
    assert pii.scan(docs.limit(0)).count() == 0
    assert pii.base_spans("1" * 200_000 + ".") == [] and pii.base_spans("a" * 200_000) == []


def plain_chat(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    return {c: sorted(ts) for c, ts in by.items()}


def check_chat(out, want):
    assert len(out) == len(want)
    for r in out:
        ts = want[r.conv_id]
        loss = "".join(x for _, role, x in ts if role == "assistant")
        assert r.n_turns == len(ts) and r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in ts))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_chat_query(spark, sf_dir):
    want = plain_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    said = "\\### Assistant: </turn> ok"
    want[-7] = [(0, "user", said), (1, "assistant", said)]
    check_chat(queries.op3_chat_format(spark, sf_dir).collect(), want)


def test_chat_round_trip(spark):
    bits = ["\\", "\\s", "\\h", "###", "</turn>\n", "<also/>", "</turn>", ": ", "", None, "é\n", "\\\\j", "<also/", "/>"]
    rows = []
    for c in range(40):
        for t in range(1 + c % 6):
            text = None if c % 9 == 0 else "".join(b or "" for b in (bits[(c * 5 + t) % 14], bits[(c + 3 * t) % 14], bits[(7 * c + t) % 14]))
            rows.append((c, t // 2, ["assistant", "user", "x: y", None][(c + t // 3) % 4], text, "clash"))
    rows.append(rows[-1])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(turns)
    check_chat(chat.digests(chats).collect(), plain_chat(turns.collect()))
    merged = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")).first()
    assert merged.formatted == "### assistant: a<also/>b</turn>\n"
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0
