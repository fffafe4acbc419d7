"""Token ids of whole texts, by the tokenizers library, at the cost of the distinct words.

A text splits exactly where the tokenizer's own first step would split it too, so the pieces'
ids, encoded once for a worker and kept, make up the text's ids:

* ``word``: at ASCII white space, which the tokenizer drops;
* ``byte``: before each single space or newline, which begins the next piece. Texts with two
  neighbouring white-space characters are encoded whole.

Stops that follow a word of letters are a piece of their own, so the word is encoded once whatever follows it. The kept
pieces are an Arrow column, which a slice's pieces are looked up in by one hash encoding of both.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.llm.common import REMEMBERED, Words

#: Distinct pieces that a worker remembers before it starts afresh; this bounds memory only.
REMEMBER = 500_000
#: Pieces that go through one call together, and the control character that parts them.
TOGETHER, MARK = 100, "\x01"
#: Letters whose lower case and composed form are simple, and stops that no contraction begins with.
LETTERS, STOPS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{430}-\x{45F}\x{400}-\x{42F}]", r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
#: The printable character that stands for each byte in the vocabularies; the mark stands for itself.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)} | {1: "\x01"}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    kept = REMEMBERED.setdefault("tokens", {})
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path, kind)
    return kept[path]


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        if kind not in ("word", "byte"):
            raise ValueError(f"kind is word or byte, not {kind!r}")
        self.kind = kind
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        *before, self.mark = self.tok.encode(f" {MARK}", add_special_tokens=False).ids
        self.mark_ids = 1 + len(before)
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = CharDelimiterSplit(MARK)
        self.plain = rf"^{' ' if kind == 'byte' else ''}{LETTERS}+$"
        vocabulary = self.tok.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if kind == "word" else t.startswith("\u0120"))]] = True
        self._forget()

    def _forget(self) -> None:
        """Starts afresh with the pieces that more than one lookup has asked for."""
        kept = np.flatnonzero(self.asked[: len(self.known)] > 1) if hasattr(self, "known") else []
        known, ids, lens = pa.array([""], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)  # no ids
        if 0 < len(kept) <= REMEMBER // 2:
            kept = kept[kept > 0]
            each, jump = self._jump(kept)
            known, ids, lens = pa.concat_arrays([known, self.known.take(pa.array(kept))]), self.ids[jump], np.append(0, each)
        self.known = known.slice(0, 0)
        self.asked = np.zeros(1 << 18, np.uint8)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.lens = np.zeros(1 << 18, np.int64)
        self.used = 0
        self._store(0, ids, lens)
        self.known = known

    def _jump(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these pieces has, and the places of all of them."""
        each = self.lens[at]
        jump = (self.starts[at] - (np.cumsum(each) - each)).astype(np.int32)
        return each, np.repeat(jump, each) + np.arange(each.sum(), dtype=np.int32)

    def _store(self, n: int, ids: np.ndarray, lens: np.ndarray) -> None:
        """The ids of the pieces from the n-th on."""
        while n + len(lens) > len(self.starts):
            self.starts, self.lens, self.asked = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens, self.asked))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lens[n : n + len(lens)] = lens
        self.starts[n : n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)

    def _learn(self, known: pa.Array) -> None:
        """Encodes the pieces of ``known`` from where the kept ones end.

        Words of letters go to the model alone, as the tokenizer's own first step leaves them whole; the rest go the
        tokenizer's way.
        """
        for i in range(len(self.known), len(known), 4_000):
            part = known.slice(i, min(4_000, len(known) - i))
            plain = pc.match_substring_regex(part, self.plain)
            words = part.filter(plain)
            word_ids, word_lens = self._encode_words(pc.utf8_lower(words) if self.kind == "word" else words)
            odd_ids, odd_lens = self._encode_marked(part.filter(pc.invert(plain)).to_pylist())
            plain = plain.to_numpy(zero_copy_only=False)
            lens = np.zeros(len(part), np.int64)
            lens[plain], lens[~plain] = word_lens, odd_lens
            ids = np.zeros(lens.sum(), np.uint32)
            of_word = np.repeat(plain, lens)
            ids[of_word], ids[~of_word] = word_ids, odd_ids
            self._store(i, ids, lens)
        self.known = known

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Single words of letters (``byte``: after a space) by the model; their ends or beginnings show in the tokens."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), TOGETHER), len(words)), pa.int32()), words)
        texts = [x.decode("latin-1").translate(_BYTES) for x in pc.binary_join(groups, MARK).cast(pa.binary()).to_pylist()]
        flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.flatnonzero(self.edge[flat])
        if len(at) != len(words):
            raise RuntimeError("words and their tokens don't agree")
        return flat, np.diff(np.append(-1, at)) if self.kind == "word" else np.diff(np.append(at, len(flat)))

    def _encode_marked(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Other pieces, joined by a mark that none of them holds and whose ids are its own; unusual ones one by one."""
        word = self.kind == "word"
        plain = [MARK not in x and (word or (len(x) > 1 and x[0] in " \n" and not x[1].isspace() and not x[-1].isspace())) for x in part]
        glue = f" {MARK} " if word else f" {MARK}"
        some = [x for x, p in zip(part, plain) if p]
        groups = [some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)]
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast([glue.join(g) + glue for g in groups], add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        marks = np.flatnonzero(flat == self.mark)
        lens = np.diff(np.append(-1, marks)) - self.mark_ids
        flat = np.delete(flat, (marks[:, None] - np.arange(self.mark_ids)).ravel())
        if len(some) == len(part):
            return flat, lens
        each = iter(np.split(flat, np.cumsum(lens)[:-1]) if len(lens) else [])
        odd = iter(self.tok.encode_batch_fast([x for x, p in zip(part, plain) if not p], add_special_tokens=False))
        out = [next(each) if p else np.array(next(odd).ids, dtype=np.uint32) for p in plain]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _split(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The pieces without the stops that follow a word of letters, and these stops, where the tokenizer parts them too."""
        words = pc.ascii_rtrim(pieces, STOPS)
        size, whole = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, pieces))
        cut = np.flatnonzero((size < whole) & (size > 0))
        cut = cut[pc.match_substring_regex(words.take(pa.array(cut)), self.plain).to_numpy(zero_copy_only=False)]
        tail = np.zeros(len(pieces), np.int64)
        tail[cut] = (whole - size)[cut]
        ends = np.cumsum(tail)
        _, offsets, data = pieces.buffers()
        start = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces)] + size
        at = np.repeat(start - (ends - tail), tail) + np.arange(tail.sum())
        stops = pa.py_buffer(np.frombuffer(data, np.uint8)[at] if len(at) else b"")
        tails = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(np.append(0, ends).astype(np.int32)), stops)
        return pc.if_else(pa.array(tail > 0), words, pieces), tails

    def _gather(self, distinct: pa.Array, codes: np.ndarray, offsets: np.ndarray, fresh: bool = False) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.known)
        found = pa.chunked_array([self.known, *self._split(distinct)]).dictionary_encode()  # the known ones keep their places
        known = found.chunk(0).dictionary
        if len(known) > max(REMEMBER, n) and not fresh:
            self._forget()
            return self._gather(distinct, codes, offsets, fresh=True)
        self._learn(known)
        words, tails = np.concatenate([x.indices.to_numpy() for x in found.chunks])[n:].reshape(2, -1)
        seen = np.zeros(len(known), bool)
        seen[words] = seen[tails] = True
        self.asked[: len(known)] = np.minimum(self.asked[: len(known)], 254) + seen
        each, at = self._jump(np.stack([words, tails], 1).ravel())
        each = each.reshape(-1, 2).sum(1)
        starts = np.cumsum(each) - each
        lens = each[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        jump = (starts[codes] - (ends - lens)).astype(np.int32)
        ids = self.ids[at][np.repeat(jump, lens) + np.arange(total, dtype=np.int32)]
        return ids, np.concatenate([[0], ends])[offsets]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the rows' offsets into it. Null is as empty."""
        text = pc.fill_null(text, "")
        if self.kind == "word":
            w = Words(pc.ascii_lower(text))
            return self._gather(w.distinct, w.codes, w.offsets)
        whole = pc.match_substring_regex(text, r"[\s\x0b\x{85}\p{Z}]{2}").to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._pieces(text)
        ids, ends = self._pieces(pc.if_else(pa.array(whole), "", text))
        parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
        at = np.flatnonzero(whole)
        for i, e in zip(at, self.tok.encode_batch_fast(text.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
            parts[i] = np.array(e.ids, dtype=np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # a piece is what follows a space; a newline is given a space before it, and marks its piece
        parts = pc.split_pattern(pc.replace_substring(text, "\n", " \n"), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        flat = parts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = flat.dictionary
        heads, inverse = np.unique(codes[offsets[:-1]], return_inverse=True)
        codes[offsets[:-1]] = len(distinct) + inverse
        spaced = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise("", distinct, " "))
        pieces = pa.concat_arrays([spaced, distinct.take(pa.array(heads))])
        return self._gather(pieces, codes, offsets)
