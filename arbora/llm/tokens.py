"""Exact byte-level BPE encoding of whole texts, fast where words repeat.

The pre-tokens of this kind of tokenizer (a run of letters, of digits or of other signs, each with at most one space
before it, and runs of white space) follow from the classes of neighbouring bytes, so NumPy finds those of a
whole batch at once. Each distinct pre-token is encoded once by the ``tokenizers`` library and remembered by
the worker. Texts that this cannot describe (non-ASCII signs other than letters, contractions such as "'s", added
tokens) are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arbora.llm._spark import strings

#: Pre-tokens remembered in one Python worker; past this only those of the last batch stay (results do not depend on it).
CACHE_WORDS = 300_000
_LETTER, _DIGIT, _SIGN, _SPACE, _WHITE = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[128:] = _LETTER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[32] = _SPACE
_CLASS[9:14] = _WHITE
_WHOLE = r"[^\x00-\x7F\pL]|'(?:[sdmt]|ll|ve|re)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pre_token_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte places where a pre-token begins; ``edges`` are the texts' byte offsets."""
    n = len(data)
    kind = _CLASS[data]
    white = kind >= _SPACE
    first = np.zeros(n + 1, bool)
    first[edges] = True
    ends_text = first[1:]
    first = first[:-1]
    begin = np.ones(n, bool)
    # After a sign, letter or digit: where the class changes. After white space: not if it is a space.
    begin[1:] = np.where(white[:-1], kind[:-1] == _WHITE, kind[1:] != kind[:-1])
    # White space within a run: only the run's last one, and only if something follows it in the text.
    inner = np.zeros(n, bool)
    inner[1:] = white[1:] & white[:-1]
    last = ~ends_text
    last[:-1] &= ~white[1:]
    begin = np.where(inner, last, begin)
    # Any white space begins a pre-token after something else.
    begin[1:] |= white[1:] & ~white[:-1]
    begin |= first
    return np.flatnonzero(begin)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        rule = described.get("pre_tokenizer") or {}
        #: whether the rule of pre-tokens above holds for this tokenizer
        self.plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not described.get("normalizer") and described["model"]["type"] == "BPE"
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # The same model over ready pre-tokens, one space between them.
        self.model = Tokenizer.from_file(path)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.led = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.led[i] = piece.startswith("Ġ")
        self.letters = byte_letters()
        #: 0xFF never occurs in UTF-8, so its token can part pre-tokens.
        self.part = self.letters[0xFF]
        self.part_id = vocab.get(self.part)
        self._forget()

    def _forget(self):
        self.slots: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _add(self, keys: list[bytes], ids: np.ndarray, lengths: np.ndarray):
        n, at = len(self.slots), self.used
        while n + len(keys) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while at + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[at : at + len(ids)] = ids
        ends = np.cumsum(lengths)
        self.start[n : n + len(keys)], self.length[n : n + len(keys)] = at + ends - lengths, lengths
        self.slots.update(zip(keys, range(n, n + len(keys))))
        self.used += len(ids)

    def _mapped(self, piece: bytes) -> str:
        return piece.decode("latin-1").translate(self.letters)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[bytes]):
        led = [p for p in pieces if p[:1] == b" " and len(p) > 1 and p[1:2] not in b" \t\n\v\f\r"]
        for k in range(0, len(led), 4096):
            part = led[k : k + 4096]
            ids = self._ids(" ".join(["Ġ" + p[1:].decode() if p.isascii() and p[1:].isalnum() else self._mapped(p) for p in part]))
            heads = np.flatnonzero(self.led[ids])
            if len(heads) == len(part):
                self._add(part, ids, np.diff(np.append(heads, len(ids))))
            else:
                self._learn_parted(part)
        known = set(led)
        rest = [p for p in pieces if p not in known]
        for k in range(0, len(rest), 4096):
            self._learn_parted(rest[k : k + 4096])

    def _learn_parted(self, pieces: list[bytes]):
        between = f" {self.part} "
        ids = self._ids(between.join(map(self._mapped, pieces)) + between)
        stops = np.flatnonzero(ids == self.part_id)
        if len(stops) != len(pieces):
            raise ValueError("the tokenizer's model does not keep pre-tokens apart")
        self._add(pieces, ids[ids != self.part_id], np.diff(stops, prepend=-1) - 1)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, offsets of the texts)."""
        texts = strings(column)
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _WHOLE) if self.plain else pa.array(np.ones(n, bool))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        apart = [e.ids for e in self.tok.encode_batch_fast([texts[i].as_py() for i in whole.tolist()], add_special_tokens=False)] if len(whole) else []
        if len(whole):
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        if len(data):
            starts = pre_token_starts(data, edges)
            cuts = np.append(starts, len(data)).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
            coded = pieces.dictionary_encode()
            found = coded.dictionary.to_pylist()
            known = np.fromiter(map(self.slots.get, found, repeat(-1)), np.int64, len(found))
            if len(fresh := np.flatnonzero(known < 0)):
                unknown = [found[k] for k in fresh.tolist()]
                self._learn(unknown)
                known[fresh] = [self.slots[p] for p in unknown]
            slots = known[coded.indices.to_numpy()]
            lengths = self.length[slots]
            ends = np.append(0, np.cumsum(lengths))
            ids = self.flat[np.repeat(self.start[slots] - ends[:-1], lengths) + np.arange(int(ends[-1]))]
            offsets = ends[np.searchsorted(starts, edges)]
            if len(self.slots) > CACHE_WORDS:
                lengths = self.length[known]
                own = self.flat[np.repeat(self.start[known] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
                self._forget()
                self._add(found, own, lengths)
        else:
            ids, offsets = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if len(whole):
            sizes = np.array([len(x) for x in apart], np.int64)
            ids = np.insert(ids, np.repeat(offsets[whole], sizes), np.fromiter((i for x in apart for i in x), np.uint32, int(sizes.sum())))
            more = np.zeros(n + 1, np.int64)
            more[whole + 1] = sizes
            offsets = offsets + np.cumsum(more)
        return ids, offsets


@cache
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which serves one task after another and keeps what it has learned."""
    return WordEncoder(path)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
