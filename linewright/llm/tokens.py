"""Byte-level token ids of many texts at once, each distinct word encoded about once.

The pre-tokenizer never joins across certain places: before a single space between two visible characters, and around a
single line end between two. Texts are cut there; the pieces are told apart by 128 bits of hash; those not met before are
encoded together in one string, and ids are gathered back. Ids equal those of encoding every text by itself. What has been
encoded stays in a table of fixed size, where newer pieces replace older ones; that bounds memory and changes no result.

Added tokens of the vocabulary's JSON file, such as <|endoftext|>, are cut out of the texts first and get their own ids, as
the tokenizers library does; what lies between them is encoded by itself.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import text_bytes

_WORDS = 4  # pieces of up to 8 * _WORDS bytes are shared; longer ones are encoded by themselves
_SPACE, _LINE = 32, 10


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str):
    """The byte-level vocabulary of a ``.tiktoken`` file, without special tokens, and its tokens' lengths in bytes by id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def added_tokens(path: str) -> dict[str, int]:
    """Contents and ids of the added tokens in the JSON file beside a ``.tiktoken`` file; none where there is no such file."""
    beside = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


class BatchTokenizer:
    def __init__(self, path: str | None = None, bits: int = 20, most: int = 6_000_000):
        self.bits, self.most, self.used = bits, most, 0
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.offset, self.count = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.scratch, self.pool = np.zeros(1 << bits, np.int64), np.zeros(1 << 20, np.uint32)
        self.encoding, self.token_bytes = byte_bpe(path or tokenizer_path())
        self.added = added_tokens(path or tokenizer_path())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        lead = np.zeros(256, bool)
        lead[0x21:0x7F] = lead[0xC3:0xE0] = True  # visible ASCII; two-byte characters beyond U+00BF
        self.starts_plain = lead
        ascii_plain = np.zeros(256, bool)
        ascii_plain[0x21:0x7F] = True
        self.ascii_plain = ascii_plain
        two = np.zeros(256, bool)
        two[0xC3:0xE0] = True
        self.two_lead = two

    def _ends_plain(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a visible character surely ends at byte ``at``."""
        last, before = flat[at], flat[np.maximum(at - 1, 0)]
        return self.ascii_plain[last] | ((last >= 0x80) & (last < 0xC0) & self.two_lead[before] & (at > 0))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and where each text's begin (one more for the end)."""
        flat, at = text_bytes(column)
        if self.cut:
            raw = flat.tobytes()
            if any(t.encode() in raw for t in self.added):
                return self._ids_between(column)
        return self._plain_ids(flat, at)

    def _ids_between(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.cut.split(t or "") for t in column.to_pylist()]  # plain, added, plain, ..., plain
        flat, at = self._plain_ids(*text_bytes(pa.array([x for p in parts for x in p[::2]], pa.large_string())))
        out, sizes, k = [], [], 0
        for p in parts:
            own = []
            for j, x in enumerate(p):
                if j % 2:
                    own.append(np.array([self.added[x]], np.uint32))
                else:
                    own.append(flat[at[k] : at[k + 1]])
                    k += 1
            out += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(out).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _plain_ids(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(flat)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if self.used > self.most:
            self.one[:] = 0
            self.two[:] = 0
            self.used = 0
        start = self._cuts(flat, at)
        size = np.diff(start, append=n)
        one, two = self._hashes(flat, start, size)
        slot = (one >> np.uint64(64 - self.bits)).astype(np.int64)
        shared = size <= 8 * _WORDS
        hit = (self.one[slot] == one) & (self.two[slot] == two) & shared
        offset, count = self.offset[slot], self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit & shared)
        self.scratch[slot[miss]] = miss
        stands = self.scratch[slot[miss]]  # of the misses that fall on a slot, one stands for its likes
        like = (one[stands] == one[miss]) & (two[stands] == two[miss])
        chosen = miss[stands == miss]
        new = np.concatenate([chosen, miss[~like], np.flatnonzero(~shared)])
        if len(new):
            ids, new_count, new_offset = self._encode(flat, start[new], size[new])
            offset[new], count[new] = new_offset + self.used, new_count
            followers = like & (stands != miss)
            offset[miss[followers]], count[miss[followers]] = offset[stands[followers]], count[stands[followers]]
            self.one[slot[chosen]], self.two[slot[chosen]] = one[chosen], two[chosen]
            self.offset[slot[chosen]], self.count[slot[chosen]] = offset[chosen], count[chosen]
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * (self.used + len(ids)) - self.used, np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        ends = np.cumsum(count)
        out = self.pool[np.repeat(offset - (ends - count), count) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])
        return out, before[np.searchsorted(start, at)]

    def _cuts(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(flat)
        edge = np.zeros(n + 1, bool)
        edge[at[:-1][np.diff(at) > 0]] = True
        ws = np.flatnonzero((flat == _SPACE) | (flat == _LINE))
        ws = ws[(ws > 0) & (ws < n - 1)]
        ws = ws[~edge[ws] & ~edge[ws + 1]]
        ws = ws[self._ends_plain(flat, ws - 1) & self.starts_plain[flat[ws + 1]]]
        edge[ws] = True
        edge[ws[flat[ws] == _LINE] + 1] = True
        return np.flatnonzero(edge[:n])

    @staticmethod
    def _hashes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([flat, np.zeros(8 * _WORDS + 8, np.uint8)])
        words = np.ndarray((len(flat) + 8 * _WORDS,), np.uint64, padded, 0, (1,))  # the eight bytes from each place on
        one = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = one ^ np.uint64(0xD6E8FEB86659FD93)
        which = slice(None)
        for w in range(_WORDS):
            if w:
                which = np.flatnonzero(size > 8 * w)
            part = words[start[which] + 8 * w]
            short = np.clip(8 * (w + 1) - size[which], 0, 7).astype(np.uint64) * np.uint64(8)
            part = (part << short) >> short  # little-endian: what lies beyond the piece goes
            a = (one[which] ^ part) * np.uint64(0xFF51AFD7ED558CCD)
            one[which] = a ^ (a >> np.uint64(32))
            b = (two[which] + part) * np.uint64(0xC4CEB9FE1A85EC53)
            two[which] = b ^ (b >> np.uint64(29))
        return one * np.uint64(0x9E3779B97F4A7C15), two

    def _encode(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, how many each has, and where they begin."""
        encode = self.encoding.encode_to_numpy
        head = flat[start]
        spaced = (head == _SPACE) & (size > 1)
        starts_well = np.where(spaced, self.starts_plain[flat[np.minimum(start + 1, len(flat) - 1)]], self.starts_plain[head])
        last = start + size - 1
        ends_well = self._ends_plain(flat, last) & ((last - 1 >= start) | self.ascii_plain[flat[last]])
        joint = starts_well & ends_well & (size <= 8 * _WORDS)
        count, offset = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pools, at = [], 0
        together = np.flatnonzero(joint)
        if len(together):
            # a line end stands before each piece that has no space of its own, and its token is left out
            extra = (~spaced[together]).astype(np.int64)
            length = size[together] + extra
            ends = np.cumsum(length)
            source = np.repeat(start[together] - extra - (ends - length), length) + np.arange(ends[-1])
            joined = flat[np.maximum(source, 0)].copy()
            joined[(ends - length)[extra == 1]] = _LINE
            found = encode(joined.tobytes().decode("utf-8"))
            stops = np.cumsum(self.token_bytes[found])
            upto = np.searchsorted(stops, ends, side="left") + 1
            began = np.concatenate([[0], upto[:-1]]) + extra
            offset[together], count[together] = began, upto - began
            pools.append(found)
            at = len(found)
        for k in np.flatnonzero(~joint):
            found = encode(flat[start[k] : start[k] + size[k]].tobytes().decode("utf-8"))
            offset[k], count[k] = at, len(found)
            pools.append(found)
            at += len(found)
        return np.concatenate(pools).astype(np.uint32), count, offset
