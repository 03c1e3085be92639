"""Personal data: anchors found by an Aho-Corasick automaton, expanded and validated by local parsers.

One pass of the automaton over a lower-cased text finds at-signs, plus signs, schemes and identifier cues; each anchor hands over to a
deterministic parser that works outward from it.  Digit runs, the anchors of addresses and card numbers, are found by one
linear pattern.  Every parser reads each character a bounded number of times, so very long texts and runs cost no more
than their length.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are leftmost and non-overlapping within a kind.  The method adds spans of further
kinds and takes none away: ``email_words`` (name [at] host [dot] tld), ``ip6``, ``login`` (user information in a URL),
``iban`` (checked modulo 97), ``account`` (a number or name after an account cue), ``ssn``, ``secret`` (credentials after a cue or in a
well-known form) and ``street`` (a numbered street address).
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_words", "ip6", "login", "iban", "account", "ssn", "secret", "street")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9](?:[ .-]?[0-9])++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I)
_WORDED = re.compile(r"[A-Za-z0-9-]++(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]++)++", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]{1,256}:[^\s/@:]{1,256}@[A-Za-z0-9.-]+")
_IP6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_VALUE = re.compile(r"""(?: ?(?:is|no\.?|nr\.?|number|id|name))?\s{0,2}[:=#]\s{0,2}["']?([A-Za-z0-9][A-Za-z0-9_.\-/+]{3,}+)""", re.I)
_NUMBER = re.compile(r"(?: ?(?:is|no\.?|nr\.?|number|id))?\s{0,2}[:=#]?\s{0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_STREET = re.compile(r"(?:[A-ZÄÖÜÉÈ][\w'-]{1,30} ){1,3}\Z")
_HOUSE = re.compile(r"(?<![\w.])[0-9]{1,5}[a-z]? \Z")
_ENDWORD = re.compile(r"(?!\w)\.?")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+")

_CUES = {
    "@": "at", "+": "plus", "[at]": "words", "(at)": "words", "{at}": "words", "[ at ]": "words", "( at )": "words",
    "://": "scheme", "::": "colons", "iban": "iban", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "username": "account", "login": "account",
    "ssn": "ssn", "social security": "ssn", "password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret",
    "akia": "key", "asia": "key", "ghp_": "key", "gho_": "key", "sk-": "key", "xox": "key",
    " street": "street", " avenue": "street", " road": "street", " lane": "street", " boulevard": "street", " drive": "street",
}


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for cue, kind in _CUES.items():
        made.add_word(cue, (kind, len(cue)))
    made.make_automaton()
    return made


_FOUND: list[ahocorasick.Automaton] = []
_FOLD = {c: c + 32 for c in range(65, 91)}


def _anchors(text: str):
    if not _FOUND:
        _FOUND.append(automaton())
    # lower-casing must not move positions: only where it keeps the length, else A-Z alone
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_FOLD)
    for end, (kind, size) in _FOUND[0].iter(low):
        yield kind, end - size + 1, end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _base_digits(text: str, out: list[tuple[str, int, int]]) -> None:
    """Addresses and cards in the digit runs of a text."""
    for run in _DIGITS.finditer(text):
        s, e = run.span()
        if "." in run[0]:
            # a run of dotted parts splits into groups of four from its left
            if run[0].count(".") >= 3:
                for m in _DOTTED.finditer(text, s, e):
                    parts, at = m[0].split("."), m.start()
                    for k in range(0, len(parts) - 3, 4):
                        own = parts[k : k + 4]
                        end = at + sum(map(len, own)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                            out.append(("ip", at, end))
                        at = end + 1
        if e - s >= 16:
            for m in _CARD.finditer(text, s, e):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))


def _local_start(text: str, at: int, least: int) -> int:
    k = at
    while k > least and text[k - 1] in _LOCAL:
        k -= 1
    return k


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end in code points), by kind as in ``KINDS``, then start."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    _base_digits(text, out)
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, s: int, e: int) -> None:
        out.append((kind, s, e))
        done[kind] = e

    for kind, s, e in _anchors(text):
        if kind == "at":
            start = _local_start(text, s, done["email"])
            if start < s and (m := _DOMAIN.match(text, e)):
                add("email", start, m.end())
        elif kind == "plus":
            if s >= done["phone"] and (m := _PHONE.match(text, s)):
                done["phone"] = m.end()  # one that fails the count is used up all the same
                if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append(("phone", *m.span()))
        elif kind == "words":
            k = s - 1 if s and text[s - 1] == " " else s
            start = _local_start(text, k, done["email_words"])
            if start < k and (m := _AT.match(text, k)) and (m := _WORDED.match(text, m.end()) or _DOMAIN.match(text, m.end())):
                add("email_words", start, m.end())
        elif kind == "scheme":
            if e >= done["login"] and (m := _LOGIN.match(text, e)):
                add("login", e, m.end())
        elif kind == "colons":
            k = s
            while k > max(0, s - 40, done["ip6"]) and (text[k - 1] == ":" or text[k - 1] in "0123456789abcdefABCDEF"):
                k -= 1
            if (m := _IP6.match(text, k)) and m.end() >= e and len(m[0]) >= 6 and m[0].count("::") == 1 and not (k and text[k - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum():
                add("ip6", k, m.end())
        elif kind == "iban":
            if (m := re.compile(r"[\s:=#]{0,4}").match(text, e)) and (n := _IBAN.match(text, m.end())):
                end = n.end()
                while end - n.start() >= 15 and not _iban(text[n.start() : end]):
                    end -= 1
                if end - n.start() >= 15 and n.start() >= done["iban"]:
                    add("iban", n.start(), end)
        elif kind == "account":
            if (s == 0 or not text[s - 1].isalnum()) and ((m := _VALUE.match(text, e)) or (m := _NUMBER.match(text, e))) and m.start(1) >= done["account"]:
                add("account", *m.span(1))
        elif kind == "ssn":
            if (m := re.compile(r"(?: number)?[\s:=#]{0,4}").match(text, e)) and (n := _SSN.match(text, m.end())) and n.start() >= done["ssn"]:
                add("ssn", *n.span())
        elif kind == "secret":
            if (s == 0 or not text[s - 1].isalnum()) and (m := _VALUE.match(text, e)) and m.start(1) >= done["secret"] and any(c.isdigit() for c in m[1]):
                add("secret", *m.span(1))
        elif kind == "key":
            if s >= done["secret"] and (s == 0 or not text[s - 1].isalnum()) and (m := _KEY.match(text, s)):
                add("secret", *m.span())
        elif kind == "street":
            if _ENDWORD.match(text, e) and (m := re.compile(_STREET.pattern).search(text, max(0, s - 96), s + 1) if text[s : s + 1] == " " else None) and (h := _HOUSE.search(text, max(0, m.start() - 8), m.start())) and h.start() >= done["street"]:
                add("street", h.start(), e)
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (order[x[0]], x[1]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: for each row an array of ``kind, start, end``; empty for null or empty text.

    Each row gets a row, repeated rows and null ids too; texts may be of any length (they are taken in slices of bounded size, a
    longer one alone).  Other columns are ignored, whatever their names.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch):
        made = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(x)] for x in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(made, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced as one by the first kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts and digest of base spans, and all spans, of every document; odd rows as in ``find``."""

    def run(batch):
        counts, digests, every = {k: [] for k in BASE}, [], []
        for text in texts(batch):
            found = spans(text)
            base = [x for x in found if x[0] in BASE]
            for k in BASE:
                counts[k].append(sum(x[0] == k for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(found))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return map_arrow(table(spark, sf_dir, "documents").select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
