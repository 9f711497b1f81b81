"""Byte-level BPE: the merges as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes if and only if every two neighbours are compatible: merging
their joint bytes gives back just the two. So the encodings of all prefixes of a piece can be followed at once. A
hypothesis is the last token of one prefix's encoding plus the place in the token trie of what was read since; a
transducer state is the set of live hypotheses. A token is certain once all of them descend from it; that is looked for
every RUN bytes, so none waits longer than RUN bytes and the longest token. States and moves are made when first met, and
kept. Decoding streams the tokens' bytes through an incremental UTF-8 state machine.

Defined results: null or empty text gives no tokens and the hash of no bytes; any Unicode text round-trips; further
columns are ignored; rows are independent, so ties and repeated rows need nothing.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import slices

#: Pieces and states that are kept; beyond it, states start anew and pieces lose their older half.
KEPT = 150_000
#: Bytes after which a piece gives out the tokens that are certain: the lookahead is this and the longest token.
RUN = 128
NEVER = 1 << 60
LOW = (1 << 24) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """encode(piece) -> token ids of one pre-split piece of bytes.

    A state holds the live hypotheses, oldest first, each as last token and trie node of what follows it. A move
    reads a byte and says which token, if any, ends the encoding of the prefix read so far. Oldest first means that
    the longest token is tried first, and as a prefix has one encoding, the first that fits is it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        for text, rank in ranks.items():
            at = 0
            for b in text:
                at = self.children[at].setdefault(b, len(self.children))
                if at == len(self.token):
                    self.children.append({})
                    self.token.append(-1)
            self.token[at] = rank
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        """A hypothesis is (last token + 1) << 24 | node, a move's value state << 24 | (ended token + 1): plain numbers, for memory."""
        start = (0,)
        self.states = {start: 0}
        self.sets = [start]
        self.moves: dict[int, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the neighbours of least rank, leftmost first, until none joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes merge to it; others never occur beside a neighbour."""
        got = self._alone.get(token)
        if got is None:
            got = self._alone[token] = self.merge(self.bytes_of[token]) == [token]
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: the start of a piece)."""
        if a < 0:
            return self.alone(b)
        key = a << 24 | b
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 2 * KEPT:
                self._fits.clear()
            got = self._fits[key] = self.alone(b) and self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _move(self, state: int, byte: int) -> int:
        grown, ended = [], -1
        for h in self.sets[state]:
            to = self.children[h & LOW].get(byte)
            if to is None:
                continue
            if self.children[to]:
                grown.append(h & ~LOW | to)
            token = self.token[to]
            if ended < 0 <= token and self.fits((h >> 24) - 1, token):
                ended = token
        if ended >= 0:
            grown.append((ended + 1) << 24)
        key = tuple(grown)
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.sets)
            self.sets.append(key)
        return number << 24 | (ended + 1)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else list(self.emit(piece))

    def emit(self, piece: bytes) -> Iterator[int]:
        """The tokens of piece, each as soon as all live hypotheses agree on it (looked for every RUN bytes)."""
        if len(self.sets) > KEPT:
            self._reset()
        moves, state, start, ends = self.moves, 0, 0, []
        length = self.length
        for byte in piece:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = moves[state << 8 | byte] = self._move(state, byte)
            state = step >> 24
            ends.append((step & LOW) - 1)
            if len(ends) >= RUN:
                yield from self._agreed(ends, state)
                if len(self.sets) > 2 * KEPT:  # a single huge piece: go on from the state at hand with an empty store
                    key = self.sets[state]
                    self._reset()
                    moves, state = self.moves, self.states.setdefault(key, len(self.sets))
                    if state == len(self.sets):
                        self.sets.append(key)
        at, out = len(ends), []
        while at:
            token = ends[at - 1]
            if token < 0:
                raise ValueError("no encoding: the vocabulary lacks single bytes")
            out.append(token)
            at -= length[token]
        yield from reversed(out)

    def _agreed(self, ends: list[int], state: int) -> list[int]:
        """Takes from ends what all live hypotheses have in common. They start at most one token's length back."""
        depth, chains = self._depths(), []
        for h in self.sets[state]:
            at, chain = len(ends) - depth[h & LOW], []
            while at > 0:
                chain.append(ends[at - 1])
                at -= self.length[ends[at - 1]]
            chains.append(chain[::-1])
        common = 0
        while all(len(c) > common and c[common] == chains[0][common] for c in chains):
            common += 1
        out = chains[0][:common]
        del ends[: sum(self.length[t] for t in out)]
        return out

    def _depths(self) -> list[int]:
        if not hasattr(self, "depth"):
            self.depth = [0] * len(self.token)
            for node, below in enumerate(self.children):
                for child in below.values():
                    self.depth[child] = self.depth[node] + 1
        return self.depth


#: What a lead byte asks for, as UTF-8 defines it (fixed values): (first, last lead; bytes to come; range of the next one).
LEADS = [
    (0x00, 0x7F, 0, 0, 0),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
]
LEAD_OF = {b: (need, low, high, b & (0xFF, 0x1F, 0x0F, 0x07)[need]) for first, last, need, low, high in LEADS for b in range(first, last + 1)}
REPLACEMENT = "\ufffd"


class Utf8Stream:
    """Text from bytes that arrive in any pieces: a machine that reads a byte at a time.

    Its state is the number of bytes still to come, the range that the next one must lie in, and the code point so far.
    A byte that fits nowhere gives a replacement character, as does a character that breaks off (once, whatever was read).
    """

    def __init__(self):
        self.need, self.low, self.high, self.point = 0, 0, 0, 0

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        need, low, high, point = self.need, self.low, self.high, self.point
        for b in data:
            if need:
                if low <= b <= high:
                    need, low, high, point = need - 1, 0x80, 0xBF, point << 6 | b & 0x3F
                    if not need:
                        out.append(chr(point))
                    continue
                out.append(REPLACEMENT)
            lead = LEAD_OF.get(b)
            if lead is None:
                need = 0
                out.append(REPLACEMENT)
                continue
            need, low, high, point = lead
            if not need:
                out.append(chr(point))
        self.need, self.low, self.high, self.point = need, low, high, point
        return "".join(out)

    def close(self) -> str:
        broken, self.need = self.need > 0, 0
        return REPLACEMENT if broken else ""


class Codec:
    """encode(text) -> ids, decode(ids) -> bytes, stream(ids) -> text pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.table = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]
        #: Whole characters, which take the machine from its first state back to it: runs of them are joined at once.
        self.closed = np.array([_closed(t) for t in self.table], bool)
        encode = self.transducer.encode

        class Packed(dict):
            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                ids = self.older.get(piece)
                if ids is None:
                    found = encode(piece.encode("utf-8"))
                    ids = struct.pack(f"<{len(found)}I", *found)
                if len(self) >= KEPT:
                    self.older = dict(self)
                    self.clear()
                if len(piece) < 64:
                    self[piece] = ids
                return ids

        self.packed = Packed()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def stream(self, ids: Iterable[int], run: int = 65536) -> Iterator[str]:
        """Text pieces of runs of tokens, with bounded memory; tokens that cut characters go through the machine."""
        machine = Utf8Stream()
        for part in runs_of(ids, run):
            yield "".join(self._texts(machine, part))
        yield machine.close()

    def _texts(self, machine: Utf8Stream, ids: np.ndarray) -> Iterator[str]:
        start, pieces = 0, list(map(self.table.__getitem__, ids.tolist()))
        for cut in [*np.flatnonzero(~self.closed[ids]).tolist(), len(ids)]:
            if machine.need and start < cut:  # broken off: the machine says so, and is in its first state then
                yield machine.feed(pieces[start])
                start += 1
            if start < cut:
                yield b"".join(pieces[start:cut]).decode("utf-8")
            if cut < len(ids):
                yield machine.feed(pieces[cut])
            start = cut + 1


def runs_of(ids: Iterable[int], run: int) -> Iterator[np.ndarray]:
    """ids in arrays of at most `run`; an array is cut without a look at its elements."""
    if isinstance(ids, np.ndarray):
        yield from (ids[k : k + run] for k in range(0, len(ids), run))
        return
    at = iter(ids)
    while len(part := np.fromiter(itertools.islice(at, run), np.int64)):
        yield part


def _closed(token: bytes) -> bool:
    machine = Utf8Stream()
    return REPLACEMENT not in machine.feed(token) and not machine.need or token == REPLACEMENT.encode()


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(read_ranks(path), pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> if asked for) for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_sha, text_sha, lists = [], [], [], []
                for text in part.column("text").to_pylist():
                    packed = c.encode_packed(text or "")
                    ids = np.frombuffer(packed, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    decoded = hashlib.sha256()
                    for piece in c.stream(ids):
                        decoded.update(piece.encode("utf-8"))
                    text_sha.append(decoded.hexdigest())
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
