"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at the hits, embedded checksums.

One pass over the texts, no shuffle.  The keywords of all kinds are searched
at once in the ASCII-lower-cased text; a kind's pattern is only tried at the
place of a hit.  Kinds with a checksum inside the secret count only if it is
right.  Runs of hexadecimal digits have no keyword: their prefilter is the
run of 16 itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices

# Keywords, patterns and alphabets of the kinds.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PREFIXED = re.compile(r"(gh[pousr]_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PREFIXED_WORDS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
                  "npm_": "npm"}
AGE = re.compile(r"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
#: In the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "github", "npm", "age"]

SPANS = "array<struct<kind:string,start:long,end:long>>"


def crc_base62(text: str) -> str:
    """CRC-32 of ``text`` as six base-62 digits, as issuers append it to their tokens."""
    value, digits = zlib.crc32(text.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def bech32_checks(prefix: str, data: str) -> bool:
    """Is the checksum of a Bech32 string right?"""
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                check ^= g
    return check == 1


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for word in [*ASSIGN_WORDS, "akia", *PREFIXED_WORDS, "age-secret-key-1"]:
            self.words.add_word(word, word)
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of all secrets of a text, in order."""
        found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        free_assign = free_access = 0        # where the last match of the kind ended, dropped ones too
        for last, word in self.words.iter(lower):
            start = last + 1 - len(word)
            if word in PREFIXED_WORDS:
                m = PREFIXED.match(text, start)
                if m and crc_base62(m[2]) == m[3]:
                    found.append((start, KINDS.index(PREFIXED_WORDS[word]), m.end()))
            elif word == "akia":
                m = ACCESS.match(text, start) if start >= free_access else None
                if m:
                    free_access = m.end()
                    if m.end() - start >= 18:
                        found.append((start, 1, m.end()))
            elif word == "age-secret-key-1":
                m = AGE.match(text, start)
                if m and bech32_checks("age-secret-key-", m[1].lower()):
                    found.append((start, 5, m.end()))
            elif start >= free_assign:
                m = ASSIGN.match(text, start)
                if m:
                    free_assign = m.end()
                    if m.end(2) - m.start(2) >= 12:
                        found.append((start, 0, m.end()))
        return sorted(found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: kind, start and end (code points, end exclusive) of each secret, by start, then kind.

    Base kinds: ``assign`` (keyword, sign, value of 12 or more characters),
    ``access`` (key ids of 18 or more), ``hex`` (runs of 16 or more), each
    leftmost and non-overlapping.  Added kinds, kept only if their checksum
    is right: ``github``, ``npm`` (CRC-32 in base 62), ``age`` (Bech32).  One
    row per input row; null and empty texts have no spans; repeated ids stay;
    an empty table gives no rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in slices(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(kind))],
                                             ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
