"""Personal data by anchors that are expanded to their boundaries.

An Aho-Corasick automaton finds, in one pass over a text, what every such datum
must hold: an at-sign, a plus before a digit, two neighbouring digits of a number
or a dotted address, a scheme's ``://``, a cue such as ``iban``.  A small parser
for each anchor's kind then walks to both ends from there and checks what it
finds.  No place is walked twice by one kind: each keeps the end of its last
run, so that a text costs time linear in its length.

All patterns are ASCII, so a text is searched byte by byte and places are turned
into code points afterwards, in texts with findings only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varigrid.llm.common import only

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "hidden_email", "login", "iban", "account")
BASE = 4
#: Bytes of an address before the at-sign.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIDDEN = re.compile(r" ?([a-z0-9-]+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[a-z0-9-]+)+)")
_LOGIN = re.compile(r"[a-z0-9._%+~-]+(?::[^\s/@\"'<>]*)?@[a-z0-9-]+(?:\.[a-z0-9-]+)*")
_IBAN = re.compile(r"[ :=#.]{0,4}([a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30})(?![a-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|num|id))?[ :=#.]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
#: Cues of an account, as they are written in the languages of the corpus.
_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn", "social security")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()

    def add(word: str, kind: str) -> None:
        kinds = found.get(word, (len(word), ()))[1]
        found.add_word(word, (len(word), (*kinds, kind)))

    add("@", "email")
    for a in "0123456789":
        add(f"+{a}", "phone")
        for b in "0123456789":
            add(f"{a}.{b}", "ip")
            for gap in ("", " ", "-"):
                add(f"{a}{gap}{b}", "card")
    for at in ("(at)", "[at]", "{at}"):
        add(at, "hidden_email")
    add("://", "login")
    add("iban", "iban")
    for cue in _CUES:
        add(cue, "account")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _cards_within(t: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Card numbers in a run of digits that is none itself: single groups, or four of four digits."""
    groups = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(t, start, end)]
    i = 0
    while i < len(groups):
        a, b = groups[i]
        if 12 <= b - a <= 19 and luhn(t[a:b]):
            yield a, b
        elif len(four := groups[i : i + 4]) == 4 and all(y - x == 4 for x, y in four) and luhn("".join(t[x:y] for x, y in four)):
            yield a, four[-1][1]
            i += 3
        i += 1


def found_in(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by start and kind, in bytes."""
    t = text.lower().decode("latin-1")  # a letter a byte
    spans: set[tuple[int, int, int]] = set()
    done = dict.fromkeys(KINDS, 0)

    def back(at: int, allowed: frozenset[str], least: int) -> int:
        while at > least and t[at - 1] in allowed:
            at -= 1
        return at

    def email(at: int, end: int) -> None:
        start = back(at, _LOCAL, done["email"])
        if start < at and (m := _DOMAIN.match(t, end)):
            spans.add((start, 0, m.end()))
            done["email"] = m.end()

    def ip(at: int, end: int) -> None:
        if at < done["ip"]:
            return
        m = _CHAIN.match(t, back(at, _DIGITS, done["ip"]))
        done["ip"] = m.end()
        parts, place = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                spans.add((place, 1, place + size))
            place += size + 1

    def card(at: int, end: int) -> None:
        if at < done["card"]:
            return
        m = _NUMBER.match(t, at)
        done["card"] = m.end()
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.add((m.start(), 2, m.end()))
        else:
            spans.update((a, 7, b) for a, b in _cards_within(t, m.start(), m.end()))

    def phone(at: int, end: int) -> None:
        if (m := _PHONE.match(t, at)) and 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
            spans.add((at, 3, m.end()))

    def hidden_email(at: int, end: int) -> None:
        last = at - (at > 0 and t[at - 1] == " ")
        start = back(last, _LOCAL, done["hidden_email"])
        if start < last and (m := _HIDDEN.match(t, end)):
            spans.add((start, 4, m.end()))
            done["hidden_email"] = m.end()

    def login(at: int, end: int) -> None:
        if m := _LOGIN.match(t, end):
            spans.add((end, 5, m.end()))

    def iban(at: int, end: int) -> None:
        if (m := _IBAN.match(t, end)) and _mod_97(m.group(1).replace(" ", "")):
            spans.add((m.start(1), 6, m.end(1)))

    def account(at: int, end: int) -> None:
        if at and "a" <= t[at - 1] <= "z":
            return
        if m := _ACCOUNT.match(t, end):
            spans.add((m.start(1), 7, m.end(1)))

    parsers = {"email": email, "ip": ip, "card": card, "phone": phone, "hidden_email": hidden_email, "login": login, "iban": iban, "account": account}
    for last, (length, kinds) in _automaton().iter(t):
        for kind in kinds:
            parsers[kind](last - length + 1, last + 1)
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _row(text: bytes | None) -> tuple[list[int], str, str]:
    spans = found_in(text) if text else []
    if spans and not text.isascii():
        heads = np.zeros(len(text) + 1, np.int64)
        np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=heads[1:])
        spans = [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]
    base = [s for s in spans if s[1] < BASE]
    counts = np.bincount([k for _, k, _ in base], minlength=BASE).tolist()
    return counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document its personal data: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are those of the four base kinds; ``spans`` has the added ones
    too: addresses with a spelled at-sign, logins in front of a host, account numbers
    after a cue, and card numbers inside longer runs of digits.  Added spans may lie
    over others.

    Each row is judged by itself, so repeated rows repeat their result and an empty
    table gives no rows.  A null or empty text has no spans, no count and the digest
    of an empty string; a null doc_id stays null; texts are searched in whole, in
    linear time; further columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    texts = only(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
