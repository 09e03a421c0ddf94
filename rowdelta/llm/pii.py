"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and cues such as ``iban`` or ``account``. From each
anchor a local parser expands to the span's boundaries and validates it. Only the first digit of a run is an anchor, and no parser looks at more than
its own span, so the work grows with the text's length whatever it holds. Anchors of a kind are tried from left to right and those
inside an earlier match of that kind are passed over, which gives the leftmost non-overlapping matches of the kind's pattern; a match that fails
validation is dropped and nothing shorter is tried in its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "account", "address", "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[\s:#.=-]{0,3}(?:no|nr|number|id)?[\s:#.=-]{0,3}([0-9][0-9-]{4,22}[0-9])(?![A-Za-z0-9])", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_STREET = re.compile(r"[0-9]{1,5}\x20+(?:[A-Z][a-z]+\x20+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b")
_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")
#: Words that a secret follows, after a sign that assigns it, and beginnings by which well-known keys are told.
_SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "credential")
#: Cues that need no sign before a secret; those above are words of prose too.
_BARE_CUES = ("api_key", "api-key", "api key", "apikey", "access_key", "access key", "private_key", "client_key", "auth_key", "bearer")
_KEY_STARTS = ("akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "eyj", "-----begin ")
_ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,24}[\"']?\x20{0,3}(?:([:=])\x20{0,3}|\x20)([\"']?)([^\s\"'<>,;]{8,})")
_KEY_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_./+=-")
_KEY = re.compile(r"[A-Za-z0-9_./+=-]{16,}")
# A private key block: headers, then base64 in long pieces and a padded last one; up to its end mark pieces of any length may follow, a line each.
_BREAK = r"(?:[\x20\t]*+(?:[\r\n]|\\[nr])\s*+)"
_GAP = r"(?:\s|\\[nr])++"
_PEM = re.compile(
    rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_BREAK}[A-Za-z-]{{3,20}}:[^\r\n\\]{{0,200}})*+"
    rf"(?:{_GAP}[A-Za-z0-9+/]{{32,}}+={{0,2}})*+(?:{_GAP}[A-Za-z0-9+/]{{1,31}}+={{1,2}})?+"
    rf"(?:(?:{_BREAK}[A-Za-z0-9+/]{{1,76}}+={{0,2}})*+(?:{_GAP}[A-Za-z0-9+/]++)?+(?:{_GAP})?+-----END [A-Z ]{{0,40}}PRIVATE KEY-----)?+"
)


def luhn(digits: str) -> bool:
    """Whether the check digit is right: from the right, every second digit is doubled and its digits summed."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@cache
def _anchors():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in ["@", "+", "://", *"0123456789"]:
        machine.add_word(word, word)
    return machine.make_automaton() or machine


@cache
def _cues():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, words in (("account", _CUES), ("secret", _SECRET_CUES), ("bare", _BARE_CUES), ("key", _KEY_STARTS)):
        for word in words:
            machine.add_word(word, (kind, len(word)))
    return machine.make_automaton() or machine


def _lower(text: str) -> str:
    """Lower case with every position kept: a letter whose lower case is several code points stays as it is."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _matches(text: str, at: list[int], pattern: re.Pattern, good: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Matches of ``pattern`` that begin at one of ``at``, from the left and without overlap; those that aren't good are dropped."""
    found, end = [], 0
    for i in at:
        if i >= end and (m := pattern.match(text, i)):
            end = m.end()
            if good(m[0]):
                found.append((i, end))
    return found


def _emails(text: str, at: list[int]) -> list[tuple[int, int]]:
    found, end = [], 0
    for i in at:
        start = i
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if i >= end and start < i and (m := _DOMAIN.match(text, i + 1)):
            found.append((start, end := m.end()))
    return found


def _urls(text: str, at: list[int]) -> list[tuple[int, int]]:
    found, reach = [], 0
    for i in at:
        start = i
        while start > reach and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        if reach <= start < i and (m := _URL.match(text, i)):
            reach = m.end()
            found.append((start, start + len(text[start:reach].rstrip(".,;:!?)"))))
    return found


def _random(value: str) -> bool:
    """Whether a value looks made up by a machine: letters and digits mixed, with several different ones."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 6


def _set(value: str, sign: str | None, quoted: bool) -> bool:
    """Whether a value of letters only is a secret that a sign assigns: capitals inside it, or twelve letters in quotes or after an equals sign."""
    if sign is None or not (value.isascii() and value.isalpha()) or len(set(value)) < 6:
        return False
    return (len(value) >= 12 and (quoted or sign == "=")) or not (value[1:].islower() or value.isupper())


def _cued(text: str, digits: bool) -> dict[str, list[tuple[int, int]]]:
    """Account numbers and secrets, from their cues."""
    found: dict[str, list[tuple[int, int]]] = {"account": [], "secret": []}
    reach = dull = 0
    for end, (kind, size) in _cues().iter(_lower(text)):
        start = end - size + 1
        if kind == "account":
            if digits and (m := _NUMBER.match(text, end + 1)):
                found["account"].append(m.span(1))
            continue
        if start < reach or end + 40 < dull:  # inside a secret, or deep inside a run that is none, which no later start makes one
            continue
        if kind in ("secret", "bare"):
            m = _ASSIGNED.match(text, end + 1)
            if m and m[1] is None and kind == "secret":
                continue
            span = m.span(3) if m else None
            block = m and _set(m[3].rstrip(".!?)"), m[1], bool(m[2]))
        elif start and text[start - 1] in _KEY_PART:
            continue
        else:
            block = _PEM.match(text, start)
            m = block or _KEY.match(text, start)
            span = m.span() if m else None
        if span and (block or _random(text[span[0] : span[1]])):
            found["secret"].append(span)
            reach = span[1]
        elif span:
            dull = span[1]
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text by start, then kind as listed; positions are code points, ends exclusive."""
    marks: dict[str, list[int]] = {"@": [], "+": [], "://": [], "0": []}
    last = -2
    for end, word in _anchors().iter(text):
        if word.isdigit():
            if end > last + 1:
                marks["0"].append(end)
            last = end
        else:
            marks[word].append(end - len(word) + 1)
    digits = lambda s: sum(c.isdigit() for c in s)  # noqa: E731  matches hold ASCII digits only
    spans = {"email": _emails(text, marks["@"])}
    spans["ip"] = _matches(text, marks["0"], _IP, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")))
    spans["card"] = _matches(text, marks["0"], _CARD, lambda s: 14 <= digits(s) <= 19 and luhn(re.sub("[^0-9]", "", s)))
    spans["phone"] = _matches(text, marks["+"], _PHONE, lambda s: 10 <= digits(s) <= 15)
    spans["url"] = _urls(text, marks["://"])
    if marks["0"]:
        spans["iban"] = _matches(text, [i - 2 for i in marks["0"] if i >= 2 and text[i - 2 : i].isupper()], _IBAN, _iban_ok)
        spans["address"] = _matches(text, [max(i, end - 5) for i, end in _runs(text, marks["0"])], _STREET, lambda s: True)
    spans |= _cued(text, bool(marks["0"]))
    order = {k: n for n, k in enumerate(BASE_KINDS + MORE_KINDS)}
    return sorted(((k, a, b) for k, xs in spans.items() for a, b in dict.fromkeys(xs)), key=lambda x: (x[1], order[x[0]], x[2]))


def _runs(text: str, at: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of digits that begin at ``at``."""
    for i in at:
        yield i, _DIGITS.match(text, i).end()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document: doc_id, spans (array of kind, start, end).

    Null texts count as empty and have no spans; null ids, ties and rows that repeat are rows like others; no shuffle.
    """
    at = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(at))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def mask(text: str) -> str:
    """Put a tag such as ``<EMAIL>`` in the place of each span; overlapping spans become one, with the first one's tag."""
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in every text, and the length column, if there is one, brought up to date. Nulls stay null."""
    names = docs.columns
    i = names.index(text_col)
    n = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else mask(x) for x in batch.column(i).to_pylist()]
            columns = list(batch.columns)
            columns[i] = pa.array(texts, columns[i].type)
            if n is not None:
                old = columns[n].to_pylist()
                columns[n] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(docs).mapInArrow(run, docs.schema)
