"""Token ids of whole texts by a word-splitting vocabulary, each distinct word of a batch encoded once.

The tokenizer drops white space, lower-cases, and cuts a text into runs of letters, single digits, runs of other signs
and a few endings before it looks at the vocabulary, so the ids of a text are those of its parts in a row. A batch is
therefore cut with Arrow, its distinct parts are looked up (a cache keeps those of earlier batches; a full cache is
emptied, which costs time and changes nothing), and the ids are gathered with numpy. Texts with letters beyond Latin,
control characters or the strings of special tokens take the tokenizer's own path, word by word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

OPERATOR = "tokens"
CACHED_PARTS = 600_000
CACHED_LENGTH = 64
# A batch of texts is worked on in slices of about so many bytes; one longer text is a slice of its own. The parts of a
# slice take some twenty times its bytes.
SLICE_BYTES = 2 << 20

_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Up to U+024F, but for the dotted capital I, letters change case one by one and no two of them combine.
_ODD = r"[^\x00-\x{1b}\x20-\x{12f}\x{131}-\x{24f}]"


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        ids = self.encode(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[key] = ids
        return ids


class TextEncoder:
    """Ids under one vocabulary file; `special_as_text` makes the strings of special tokens ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        if [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this encoder needs a vocabulary that drops white space and lower-cases")
        splits = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split" and p.get("invert")]
        # All but runs of letters is set apart by spaces; what is left between spaces is then one part.
        parts = [p for p in splits[0]["pattern"]["Regex"].split("|") if p not in (r"[\p{L}]+", r"\p{L}+")]
        self.apart = f"({'|'.join(parts)})".replace(r"[^\s", f"[^{_SPACE}")
        self.special = [] if special_as_text else [t["content"] for t in spec["added_tokens"]]
        self.shown = _printable_bytes()
        self.parts, self.words = _Cache(self._part), _Cache(self._word)

    def _part(self, part: str) -> bytes:
        written = "".join(map(self.shown.__getitem__, part.encode("utf-8")))
        return np.array([t.id for t in self.tokenizer.model.tokenize(written)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self.apart, r" \1 "))
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        found = [self.parts[p] if p else b"" for p in coded.dictionary.to_pylist()]
        lengths = np.fromiter((len(b) >> 2 for b in found), np.int64, len(found))
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        table, which = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        each = lengths[which]
        ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        ids = table[np.repeat(starts[which] - ends[:-1], each) + np.arange(ends[-1])] if len(which) else table
        return ids, ends[offsets - offsets[0]]

    def _odd(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the batch: the row it starts at, its ids in a row, and where each text's ids start and end. Null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
            yield at, *self._slice(texts.slice(at, to - at))
            at = to

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        ids, ends = self._plain(pc.if_else(pa.array(odd), "", texts).cast(pa.string() if texts.nbytes < 1 << 30 else pa.large_string()))
        if not odd.any():
            return ids, ends
        own = {int(i): np.frombuffer(self._odd(texts[int(i)].as_py()), "<u4") for i in np.flatnonzero(odd)}
        pieces = [own.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """The encoder of this Python worker, kept from task to task until another operator's tasks run there."""
    key, held = (path, special_as_text), kept(OPERATOR)
    if key not in held:
        pa.set_cpu_count(1)
        held[key] = TextEncoder(path, special_as_text)
    return held[key]
