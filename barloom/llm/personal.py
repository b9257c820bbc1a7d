"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` and cues of account numbers. A small
parser at each anchor expands to the full span and validates it. An anchor inside a span of its kind is passed over, which
gives leftmost, non-overlapping spans; a span that fails validation is dropped with its characters.

Base kinds: email, ip (parts up to 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits). Added kinds: account (IBAN: country,
check digits, 11 to 30 letters or digits, in groups or not, remainder 1 modulo 97) and login (user information in a URL,
``scheme://user@host`` or ``scheme://user:password@host``). Spans are (kind, start, end) in code points, end exclusive.
Null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import arrow_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: what stands in for a span
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "account": "<ACCOUNT>", "login": "<LOGIN>"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
ACCOUNT_CUE = re.compile(r"[\s:.#]*")
LOGIN = re.compile(r"[^\s/?#@\"'<>]+@")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", "IBAN", *DIGITS):
        found.add_word(anchor, (len(anchor), anchor if anchor not in DIGITS else "0"))
    found.make_automaton()
    return found


ANCHORS = _anchors()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = ip_run = card_end = phone_end = login_end = account_end = 0
    for last, (length, anchor) in ANCHORS.iter(text):
        at = last - length + 1
        if anchor == "0":
            if at >= card_end:
                if m := CARD.match(text, at):
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
            if at >= ip_end and at >= ip_run:
                if m := ADDRESS.match(text, at):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                        out.append(("ip", at, ip_end))
                else:  # no later start in this run of digits does better
                    ip_run = RUN.match(text, at).end()
        elif anchor == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append(("email", start, email_end))
        elif anchor == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out.append(("phone", at, phone_end))
        elif anchor == "://":
            if at >= login_end and (m := LOGIN.match(text, last + 1)):
                start = at
                while start > login_end and text[start - 1] in SCHEME:
                    start -= 1
                if start < at:
                    login_end = m.end()
                    out.append(("login", start, login_end))
        elif at >= account_end:
            start = ACCOUNT_CUE.match(text, last + 1).end()
            m = ACCOUNT.match(text, start)
            while m and not iban(m.group()) and " " in m.group():  # a word behind the number is no part of it
                m = ACCOUNT.match(text[:start + m.group().rindex(" ")], start)
            if m and iban(m.group()):
                account_end = m.end()
                out.append(("account", start, account_end))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind's mask; overlapping spans become the first one's mask."""
    spans = find(text)
    if not spans:
        return text
    parts, last, held = [], 0, None
    for kind, start, end in [*spans, (None, len(text) + 1, 0)]:
        if held and start < held[2]:
            held = (held[0], held[1], max(held[2], end))
            continue
        if held:
            parts += [text[last:held[1]], MASKS[held[0]]]
            last = held[2]
        held = (kind, start, end)
    parts.append(text[last:])
    return "".join(parts)


FIGURES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        if rows:
            got = arrow_rows(FIGURES, rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *got.columns], names=["doc_id", *got.schema.names])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans and all spans as text. No exchange."""
    return docs.select("doc_id", "text").mapInArrow(_figures, T.StructType([
        docs.schema["doc_id"], *T._parse_datatype_string(FIGURES).fields]))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("_p_row"), pa.array(map(masked, batch.column("_p_text").to_pylist()), pa.string())],
                                         names=["_p_row", "_p_text"])


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text."""
    rows = docs.select(F.struct(*docs.columns).alias("_p_row"), F.col(text).cast("string").alias("_p_text"))
    done = rows.mapInArrow(_masked, rows.schema)
    return done.select(*[F.col("_p_text").alias(c) if c == text else F.col(f"_p_row.{c}") for c in docs.columns])
