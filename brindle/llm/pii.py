"""Personal data by anchor expansion.

One Aho-Corasick automaton passes over the text and finds anchors: at-signs, the
first digits of numbers, plus signs before digits, schemes and identifier cues in
any case.
From each anchor a deterministic parser walks to the boundaries of the item and
validates it. Nothing else of the text is looked at, so a text without anchors
costs one pass of the automaton.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are the leftmost
non-overlapping matches of the patterns in ``BASE_PATTERNS``, validated, with no
second try inside a match that fails. The method adds

* ``url``: an address behind a scheme that names a person: with a user part
  (``user@host``), a ``mailto:`` or ``tel:`` address, or a bare IP as its host;
* ``account``: behind an identifier cue (``iban``, ``account`` ...) an identifier
  of 6 to 34 letters and digits, at least half of them digits; an IBAN must pass
  its checksum. Groups that follow belong to it as far as it is valid with them;
  an IBAN of its country's length ends there.

Positions are code points, ends exclusive. A null or empty text has no spans.
Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:", "sip:")
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer id", "member id", "patient id")

#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in names.split()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}\[\]]++")
_ID = re.compile(r"(?:[\x20:#=]|\bno\b\.?|\bnumber\b|\bis\b){1,12}([A-Z0-9](?:[\x20-]?[A-Z0-9]){5,41})(?![A-Za-z0-9])")
_USER = re.compile(r"[a-z]+://[^/?#@]+@", re.I)
_IP_HOST = re.compile(r"[a-z]+://([0-9]+(?:\.[0-9]+){3})(?:[:/?#]|$)", re.I)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    digits = sorted(_DIGITS)
    for d in digits:
        a.add_word(f"+{d}", ("phone", 2))
        for e in digits:
            a.add_word(f"{d}.{e}", ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(f"{d}{gap}{e}", ("card", 2 + len(gap)))
    a.add_word("@", ("email", 1))
    for word in SCHEMES:
        a.add_word(word, ("url", len(word)))
    for word in CUES:
        a.add_word(word, ("account", len(word)))
    a.make_automaton()
    return a


_shared: list[ahocorasick.Automaton] = []


_FOLD = {c: c + 32 for c in range(65, 91)}


def _folded(text: str) -> str:
    """*text* in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")  # there may be thousands
    return len(digits) < 4 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _identifier(cue: str, run: str) -> int:
    """Where the identifier at the beginning of *run* ends; 0 if there is none.

    *run* is all groups that could belong to it; ends are tried from the longest on.
    """
    valid = 0
    for end in [len(run), *(i for i in range(len(run) - 1, 5, -1) if run[i] in " -")]:
        found = re.sub(r"[ -]", "", run[:end])
        if len(found) < 6:
            break
        iban = iban_ok(found)
        if iban and IBAN_LENGTHS.get(found[:2]) == len(found):
            return end
        if not valid and (iban or cue != "iban" and len(found) <= 34 and 2 * sum(c in _DIGITS for c in found) >= len(found)):
            valid = end
    return valid


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All (start, kind number, end) of *text*, in that order."""
    if not text:
        return []
    if not _shared:
        _shared.append(_automaton())
    spans: list[tuple[int, int, int]] = []
    past = [0] * len(KINDS)  # where the last match of a kind ended, also of one that failed validation
    for last, (kind, length) in _shared[0].iter(_folded(text)):
        at = last + 1 - length
        if kind == "email":
            start = at
            while start > past[0] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                past[0] = m.end()
                spans.append((start, 0, m.end()))
        elif kind == "ip":
            if at < past[1]:
                continue
            start = at
            while start > past[1] and text[start - 1] in _DIGITS:
                start -= 1
            if m := _IP.match(text, start):
                past[1] = m.end()
                if all(_is_byte(p) for p in m[0].split(".")):
                    spans.append((start, 1, m.end()))
        elif kind == "card":
            if at < past[2]:
                continue
            m = _CARD.match(text, at)
            past[2] = m.end()
            digits = re.sub(r"[ -]", "", m[0]) if m.end() - at <= 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((at, 2, m.end()))
        elif kind == "phone":
            if at >= past[3] and (m := _PHONE.match(text, at)):
                past[3] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append((at, 3, m.end()))
        elif kind == "url":
            if at >= past[4] and (m := _URL.match(text, at)):
                past[4] = m.end()
                found = m[0].rstrip(".,;:!?)")
                if _names_person(found):
                    spans.append((at, 4, at + len(found)))
        elif at >= past[5] and not (at and text[at - 1].isalnum()) and (m := _ID.match(text, last + 1)):
            if size := _identifier(text[at : last + 1].lower(), m[1]):
                past[5] = m.start(1) + size
                spans.append((m.start(1), 5, past[5]))
    spans.sort()
    return spans


def _names_person(address: str) -> bool:
    low = address[:8].lower()
    if low.startswith(("mailto:", "sip:")):
        return bool(re.match(r"[a-z]+:[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", address, re.I))
    if low.startswith("tel:"):
        return sum(c in _DIGITS for c in address) >= 7
    m = _IP_HOST.match(address)
    return bool(_USER.match(address)) or bool(m and all(len(p) < 4 and _is_byte(p) for p in m[1].split(".")))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


_ROW = ", ".join([*(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string", "spans string"])


def _describe(text: str | None) -> tuple:
    spans = find_spans(text or "")
    base = [s for s in spans if s[1] < len(BASE_KINDS)]
    counts = [sum(s[1] == k for s in base) for k in range(len(BASE_KINDS))]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def detect(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of *docs*: the id, counts by base kind, a digest of the base spans, all spans."""

    @F.pandas_udf(_ROW)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_describe(t) for t in texts], columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.select(docs[id_col].alias(id_col), found(docs[text_col]).alias("found")).select(id_col, "found.*")
