"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. Each
anchor is expanded by a small deterministic parser that looks left and right from it only as far as its kind's
characters go, then validated. Kinds, in order of listing:

- ``email``: local characters left of an at-sign, dotted labels right of it;
- ``ip``: four dotted numbers of at most 255;
- ``card``: 16 to 19 digits with single spaces or hyphens, passing Luhn's test;
- ``phone``: a plus sign and 8 to 15 digits with punctuation;
- ``url``: a scheme, then everything up to white space or a quote, without closing punctuation;
- ``account``: after a cue such as "IBAN" or "account no.", an account number whose check number holds, in groups of letters
  and digits: of its group ends the one at its country's length, else the last that holds. After other cues than "IBAN" also
  up to nine tokens with a digit each, as many of them as together have 6 to 34 characters.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind; kinds may overlap each other.
A span that fails its test is dropped, and the search goes on behind it.

Defined results: a null text is empty and has no spans; every row is judged by itself, so repeated rows repeat;
a null id is kept; texts are worked whole, in time proportional to their length; an empty table gives an empty
result; masking keeps all other columns and gives null for a null text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

# What anchors an expansion.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "mailto:")
CUES = ("iban", "account number", "account no", "acct", "account id", "routing number", "passport no", "passport number", "tax id", "ssn", "kontonummer", "konto-nr", "numéro de compte", "número de cuenta")

DIGITS = "0123456789"
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"[\x20().0-9-]+")
URL = re.compile(r"[^\s\"'<>`{}|\\^]+")
ACCOUNT = re.compile(r"[\s:#.=-]{0,8}([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[\x20-][A-Za-z0-9]*[0-9][A-Za-z0-9]*){0,8})")
IBAN = re.compile(r"[\s:#.=-]{0,8}([A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){10,30})")
GROUP_END = re.compile(r"[A-Za-z0-9](?![A-Za-z0-9])")

# Characters of an account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban_holds(token: str) -> bool:
    t = re.sub(r"[\s-]", "", token).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def bare(token: str) -> str:
    return re.sub(r"[\x20-]", "", token)


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """The account number that stands at ``at`` or shortly behind it."""
    m = IBAN.match(text, at)
    if m is None:
        return None
    start = m.start(1)
    ends = [e.end() for e in GROUP_END.finditer(text, start, m.end() + 1) if e.end() <= m.end()]
    holds = [e for e in ends if iban_holds(text[start:e])]
    full = [e for e in holds if len(bare(text[start:e])) == IBAN_LENGTHS.get(text[start : start + 2].upper())]
    return (start, (full or holds)[-1]) if holds else None


def account_at(text: str, at: int, cue: str) -> tuple[int, int] | None:
    found = iban_at(text, at)
    if found or cue == "iban":
        return found
    m = ACCOUNT.match(text, at)
    if m is None:
        return None
    start = m.start(1)
    ends = [e.end() for e in GROUP_END.finditer(text, start, m.end() + 1) if e.end() <= m.end() and 6 <= len(bare(text[start : e.end()])) <= 34]
    return (start, ends[-1]) if ends else None


def fold(text: str) -> str:
    """Lower case of the same length, so that places agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Finder:
    def __init__(self) -> None:
        self.anchors = automaton()

    def spans(self, text: str | None) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        if not text:
            return out
        done = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
        for last, (what, length) in self.anchors.iter(fold(text)):
            at = last - length + 1
            if what == "digit":
                if at >= done["ip"]:
                    self.ips(text, at, out, done)
                if at >= done["card"]:
                    m = CHAIN.match(text, at)
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            elif what == "at":
                start = at
                while start > done["email"] and LOCAL_BACK.match(text, start - 1):
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    out["email"].append((start, m.end()))
                    done["email"] = m.end()
                else:
                    done["email"] = max(done["email"], at + 1)  # no local part reaches over an at-sign
            elif what == "plus":
                if at >= done["phone"]:
                    self.phone(text, at, out, done)
            elif what == "scheme":
                if at >= done["url"] and not (at and (text[at - 1].isalnum() or text[at - 1] in "+.-")) and (m := URL.match(text, last + 1)):
                    end = m.end()
                    while end > last + 1 and text[end - 1] in ".,;:!?)]*":
                        end -= 1
                    if end > last + 1:
                        out["url"].append((at, end))
                        done["url"] = end
            elif at >= done["account"] and not (at and text[at - 1].isalnum()) and (span := account_at(text, last + 1, fold(text[at : last + 1]))):
                out["account"].append(span)
                done["account"] = span[1]
        return out

    @staticmethod
    def ips(text: str, at: int, out: dict, done: dict) -> None:
        """All quadruples of one dotted run of numbers; a rest of fewer than four is no match."""
        m = DOTTED.match(text, at)
        done["ip"] = m.end()
        if m[0].count(".") < 3:
            return
        parts, start = m[0].split("."), at
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out["ip"].append((start, end))
            start = end + 1

    @staticmethod
    def phone(text: str, at: int, out: dict, done: dict) -> None:
        if not (at + 1 < len(text) and text[at + 1] in DIGITS and (m := PHONE.match(text, at + 2))):
            return
        end = m.end()
        while end > at + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end < at + 4:  # one character of the run must stand before its last digit
            return
        done["phone"] = end
        if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
            out["phone"].append((at, end))


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<kind> of the four base kinds, n_url, n_account, base_sha256, spans: one row for each row of ``docs``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            found = [finder.spans(t.as_py()) for t in b.column(1)]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([listed(f, KINDS) for f in found], pa.string())], names)

    lean(docs)
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """Each maximal run of overlapping spans becomes the kind of its first span, in brackets."""
    spans = sorted((a, -b, k) for k, v in found.items() for a, b in v)
    parts, at, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, -spans[i][1])
            i += 1
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of its texts replaced; ``n_chars``, if there is such a column, follows the new text."""

    @F.pandas_udf("string")
    def run(texts):  # noqa: ANN001, ANN202
        finder = Finder()
        return texts.map(lambda t: None if t is None else masked(t, finder.spans(t)))

    lean(docs)
    out = docs.withColumn(text, run(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return out
