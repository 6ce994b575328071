"""Secret scans: keyword automaton, regular expressions anchored at hits, checksum validation of what they find."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_rows, no_cache, slices

#: The base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GIT = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
CARD = re.compile(r"(?:card|visa|mastercard)[^0-9\n]{0,24}(\d(?:[ -]?\d){12,18})(?!\d)", re.I | re.A)
IBAN = re.compile(r"iban[^A-Za-z0-9\n]{0,8}([A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])", re.I | re.A)
KINDS = ("assign", "access", "hex", "git", "jwt", "card", "iban")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "git", "gho_": "git", "ghu_": "git", "ghs_": "git", "ghr_": "git", "npm_": "git", "eyj": "jwt", "card": "card", "visa": "card", "iban": "iban"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_automaton = None


def git_sum(body: str) -> str:
    """CRC-32 of a token's body in base 62, six characters."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def luhn(digits: str) -> bool:
    double = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(int(x) for x in digits[-1::-2]) + sum(x - 9 * (x > 9) for x in double)) % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def jwt_ok(head: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


#: kind: its pattern, whether a match is kept, and the group that holds the secret itself.
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8, 1),
    "access": (ACCESS, lambda m: len(m[0]) >= 16, 0),
    "git": (GIT, lambda m: git_sum(m[1]) == m[2], 0),
    "jwt": (JWT, lambda m: jwt_ok(m[1]), 0),
    "card": (CARD, lambda m: luhn(re.sub(r"\D", "", m[1])), 1),
    "iban": (IBAN, lambda m: iban_ok(m[1]), 1),
}


def scan(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's number, end, secret's start, secret's end) in code points, in order.

    Per kind leftmost and non-overlapping: a match that fails its check is passed over as a whole.
    """
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in automaton().iter(low):
        hits.setdefault(kind, []).append(last - size + 1)
    found = []
    for kind, starts in hits.items():
        pattern, keep, group = CHECKS[kind]
        past = 0
        for start in sorted(starts):
            if start >= past and (m := pattern.match(text, start)):
                past = m.end()
                if keep(m):
                    found.append((start, KINDS.index(kind), past, *m.span(group)))
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of base kinds, hash of the base spans, all spans as kind:start:end.

    Null text counts as empty; rows of equal id stay apart; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 24):
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = scan(text or "")
                n = [sum(k == i for _, k, *_ in spans) for i in range(3)]
                base = joined([s for s in spans if s[1] < 3])
                out.append(dict(zip(SCHEMA.names, [key, *n, hashlib.sha256(base.encode()).hexdigest(), joined(spans)], strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with each secret replaced by the mask; secrets that overlap share one."""
    out, past = [], 0
    for a, b in sorted((a, b) for _, _, _, a, b in scan(text)):
        if a >= past:
            out += [text[past:a], mask]
        past = max(past, b)
    return "".join([*out, text[past:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in its text masked; null stays null, every other column and row as it was."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_cache()
        for batch in batches:
            new = pa.array([None if x is None else masked(x, mask) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_rows(docs, run)
