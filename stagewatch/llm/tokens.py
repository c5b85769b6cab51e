"""Exact token ids of the tokenizers library, computed once per distinct chunk of a batch.

A text is split at single spaces by Arrow and the chunks are dictionary-encoded;
one pattern cuts all distinct chunks into pre-tokens, and only pre-tokens not
met before go through the library's model.  This gives the library's own ids
because a space is always a token boundary for the two pre-tokenizers handled
here:

* byte-level BPE with the usual contraction/letter/number/other pattern: a
  single space belongs to the chunk after it;
* the lower-casing word BPE, which drops white space.

A text with other characters than line feeds, printable ASCII and Latin
letters, with runs of white space that cross a chunk, or with ``<|`` is cut
only at spaces between two characters that are certainly no white space.  Its
chunks of plain characters go the same way as all others.  The remaining ones
are cut by the library's own normalizer and pre-tokenizer, once per distinct
chunk, into pre-tokens (and special strings), each of which is encoded once.

Only the texts of tokenizers of any other kind go to the library whole.  The
cache stops growing at a fixed number of entries, and a worker keeps the cache
of one tokenizer only.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

KNOWN_LIMIT, LONGEST_KEPT = 400_000, 64
#: Parts chunks that are searched together.  No chunk of plain characters holds it; a pre-token in the
#: library's own spelling has it once in front, a special string twice.
PART = "\x00"

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_BYTE_PIECES = re.compile(rf"{PART}|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+"
                          rf"| ?[^\s{_LETTER}{_NUMBER}{PART}]+|\s+(?![^\s{PART}])|\s+")
_WORD_PIECES = re.compile(rf"{PART}|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}{PART}]+")
#: Texts that cannot be cut at every space.  U+0130 lower-cases to two characters and so is not plain.
_MIXED = r"\s \s|\s $|<\||[^\n -~\x{a1}-\x{12f}\x{131}-\x{17f}]"
_WIDE = re.compile("<\\||[^\n -~\u00a1-\u012f\u0131-\u017f]")
#: No white space, control or format character by any table.
_SOLID = "[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
_CUT = re.compile(f"(?<={_SOLID}) (?={_SOLID})")


def encoder(path: str) -> "Encoder":
    """The encoder of this Python worker for a tokenizer file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def split_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words between single spaces, and where each text's words begin."""
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


def gather(table: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The entries at ``index``, one after the other; ``table`` holds entries of ``sizes`` numbers each."""
    begins = np.cumsum(sizes) - sizes
    taken = sizes[index]
    ends = np.cumsum(taken)
    at = np.repeat(begins[index] - (ends - taken), taken)
    at += np.arange(len(at))
    return table[at]


def sums(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``sizes`` between each two neighbours of ``bounds``."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return before[bounds[1:]] - before[bounds[:-1]]


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def cut_chunks(joined: str, pieces_of: re.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of chunks that each end with ``PART``: distinct pieces, the chunks' pieces in order, where each chunk's begin."""
    coded = pa.array(pieces_of.findall(joined), pa.string()).dictionary_encode()
    distinct, index = strings(coded.dictionary), coded.indices.to_numpy()
    part = distinct.index(PART) if distinct else -1
    ends = np.flatnonzero(index == part)
    return distinct, index[index != part], np.concatenate([[0], ends - np.arange(len(ends))])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind = self._kind(spec)
        self.pieces_of = _BYTE_PIECES if self.kind == "byte" else _WORD_PIECES
        self.alphabet = dict(enumerate(_byte_alphabet()))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("(" + ("|".join(map(re.escape, special)) or "(?!)") + ")")

    def _kind(self, spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        special = all(t["content"].startswith("<|") and " " not in t["content"]
                      and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])
                      for t in spec.get("added_tokens") or [])
        if not special or spec["model"].get("type") != "BPE" or spec.get("truncation") or spec.get("padding"):
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]:
            return "byte"
        parts = pre.get("pretokenizers") or []
        split = parts[0].get("pattern", {}).get("Regex") if len(parts) == 2 else None
        if (split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and parts[0]["invert"]
                and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"]
                and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
            return "word"
        return "whole"

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if piece.isascii() and piece[-1:] > " ":                    # at most one space, at the front
            shown = self.alphabet[32] + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])

    def _learn(self, text: str, found: bytes) -> bytes:
        if len(self.known) < KNOWN_LIMIT and len(text) <= LONGEST_KEPT:
            self.known[text] = found
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of one chunk as little-endian 32-bit numbers."""
        found = self.known.get(chunk)
        if found is not None:
            return found
        if chunk[:1] == PART:
            return self._learn(chunk, self._wide_ids(chunk))
        text = chunk if self.kind == "byte" else chunk.lower()
        if (text[1:] if text[:1] == " " else text).isalpha():       # one word: one pre-token
            return self._learn(chunk, self._piece(text))
        # a pre-token is a chunk too, so that "word" and "word," share their work
        parts = [self.known.get(p) or self._learn(p, self._piece(p)) for p in self.pieces_of.findall(text)]
        return self._learn(chunk, b"".join(parts))

    def _wide_ids(self, key: str) -> bytes:
        """Ids of a special string or of a pre-token in the library's own spelling."""
        if key[1] == PART:
            return self.id_bytes[self.library.token_to_id(key[2:])]
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(key[1:])])

    def _wide_keys(self, chunk: str) -> list[str]:
        """A chunk's special strings and pre-tokens, as the library cuts them."""
        keys = []
        for i, part in enumerate(self.special.split(chunk)):
            if i % 2:
                keys.append(PART + PART + part)
            elif part:
                part = part if self.normalizer is None else self.normalizer.normalize_str(part)
                keys += [PART + shown for shown, _ in self.pre_tokenizer.pre_tokenize_str(part)]
        return keys

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids, a few texts at a time."""
        return [np.array(e.ids, "<u4") for i in range(0, len(texts), 16)
                for e in self.library.encode_batch_fast(texts[i:i + 16], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each text."""
        if self.kind == "whole":
            found = self.whole(texts.to_pylist())
            return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        return self._split(texts)

    def chunks_of(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks of the texts, those with ``PART`` last; the texts' chunks in order; where each text's begin."""
        mixed = pc.match_substring_regex(texts, _MIXED)
        if not pc.any(mixed).as_py():
            return self._single_spaced(texts)
        chunks, index, bounds = self._single_spaced(pc.if_else(mixed, "", texts))
        plain, wide, met, parts = {c: i for i, c in enumerate(chunks)}, {}, {}, []
        for text in texts.filter(mixed).to_pylist():
            part = []
            for i, chunk in enumerate(_CUT.split(text)):
                if i and self.kind == "byte":
                    chunk = " " + chunk
                if chunk not in met:
                    met[chunk] = ([-1 - wide.setdefault(key, len(wide)) for key in self._wide_keys(chunk)]
                                  if _WIDE.search(chunk) else [plain.setdefault(chunk, len(plain))])
                part += met[chunk]
            parts.append(np.array(part, np.int64))
        rows, counts = mixed.to_numpy(zero_copy_only=False), np.diff(bounds)
        rest = index[np.repeat(~rows, counts)]
        counts[rows] = list(map(len, parts))
        here = np.repeat(rows, counts)
        index = np.empty(len(here), np.int64)
        index[~here], index[here] = rest, np.concatenate(parts)
        index[index < 0] = len(plain) - 1 - index[index < 0]
        return [*plain, *wide], index, np.concatenate([[0], np.cumsum(counts)])

    def _single_spaced(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``chunks_of`` texts of plain characters in which every space parts two chunks."""
        words, bounds = split_spaces(texts)
        coded = words.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), strings(coded.dictionary)
        if self.kind == "byte":       # all but the first word of a text have a space before them
            first = words.take(pa.array(bounds[:-1])).dictionary_encode()
            distinct = [" " + w for w in distinct]
            index = index.copy()
            index[bounds[:-1]] = first.indices.to_numpy() + len(distinct)
            distinct += strings(first.dictionary)
        return distinct, index, bounds

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, index, bounds = self.chunks_of(texts)
        plain = len(chunks)
        while plain and chunks[plain - 1][:1] == PART:
            plain -= 1
        joined = PART.join([*chunks[:plain], ""])
        pieces, places, begins = cut_chunks(joined if self.kind == "byte" else joined.lower(), self.pieces_of)
        blobs = list(map(self.known.get, pieces))
        for i in [i for i, blob in enumerate(blobs) if blob is None]:
            blobs[i] = self._learn(pieces[i], b"" if pieces[i] == PART else self._piece(pieces[i]))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ids = gather(np.frombuffer(b"".join(blobs), "<u4"), sizes, places)
        lengths = sums(sizes[places], begins)
        if plain < len(chunks):
            blobs = list(map(self.chunk_ids, chunks[plain:]))
            ids = np.concatenate([ids, np.frombuffer(b"".join(blobs), "<u4")])
            lengths = np.concatenate([lengths, np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4])
        return gather(ids, lengths, index), sums(lengths[index], bounds)
