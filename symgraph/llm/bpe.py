"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes b, last[i] is the one token that ends the encoding of the prefix b[:i]. A token t that ends at i is
that token iff the pair (last[i - len(t)], t) survives the merges side by side, so one left-to-right pass finds the
table, the tokens are read off backwards, an append only extends the table, and an edit only recomputes from its place
until both tables agree again. Work is linear in the piece, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import in_batches, per_batch, rows_of, text_of
from symgraph.llm.pieces import REMEMBERED as REMEMBERED_PIECES
from symgraph.llm.pieces import Pieces

#: Pairs that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Vocabulary:
    """Ranks, the way each token is merged, and which pairs of tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes = {i: t for t, i in ranks.items()}
        self.made: dict[int, tuple[int, int] | None] = {}  # a token's last merge; None: a byte
        self.reachable = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = merged(token, ranks, whole=False)
            if len(token) == 1:
                self.made[rank] = None
                self.reachable[token] = rank
            elif len(parts) == 2:
                self.made[rank] = (ranks[parts[0]], ranks[parts[1]])
                self.reachable[token] = rank
        self.apart: dict[int, bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """True if the merges over both tokens' bytes end in a followed by b.

        Undoes merges on both sides of the border, the latest first: a token across the border that would have been
        merged before the sides' own merges would have broken them.
        """
        key = a << 32 | b
        if (known := self.apart.get(key)) is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[key] = self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        made, name, find = self.made, self.bytes, self.ranks.get
        limit = 1 << 62
        while True:
            across = find(name[a] + name[b])
            if across is not None and across < limit:
                return False
            # undo the later of the two sides' last merges; at equal ranks the left one was merged first
            left, right = made[a], made[b]
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                # a was merged at rank a: a pair across formed before that, at the same rank only if more to the left
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]


def merged(piece: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[bytes]:
    """The plain merge loop, lowest rank and leftmost first. whole=False: the step that makes the piece one is left out."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > (1 if whole else 2):
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class PieceTable:
    """The prefix table of one piece; append() extends it, replace() re-encodes near an edit."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _ending(self, piece: bytes, last: list[int], i: int) -> int:
        find, apart = self.v.reachable.get, self.v.stay_apart
        for k in range(max(0, i - self.v.longest), i):
            t = find(piece[k:i])
            if t is not None and (k == 0 or apart(last[k], t)):
                return t
        raise ValueError(f"no token ends at byte {i}; the ranks lack a byte")

    def append(self, more: bytes) -> None:
        self.piece += more
        for i in range(len(self.last), len(self.piece) + 1):
            self.last.append(self._ending(self.piece, self.last, i))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of piece[start:end]; returns the number of prefixes computed anew."""
        old, shift = self.last, len(new) - (end - start)
        piece = self.piece[:start] + new + self.piece[end:]
        last, done, same = old[: start + 1], 0, 0
        for i in range(start + 1, len(piece) + 1):
            if i > start + len(new) and same >= self.v.longest:  # as far back as a token reaches, both tables agree
                last += old[i - shift :]
                break
            last.append(self._ending(piece, last, i))
            done += 1
            same = same + 1 if i > start + len(new) and last[i] == old[i - shift] else 0
        self.piece, self.last = piece, last
        return done

    def tokens(self) -> list[int]:
        """The ids of the piece; a piece that is a token as a whole is that token."""
        if (whole := self.v.ranks.get(self.piece)) is not None:
            return [whole]
        out, i = [], len(self.piece)
        while i:
            out.append(self.last[i])
            i -= len(self.v.bytes[self.last[i]])
        return out[::-1]


class Encoder(Pieces):
    """Pieces encoded by their prefix tables."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED_PIECES):
        super().__init__(pattern, remembered)
        self.v = vocabulary

    def made(self, piece: str) -> bytes:
        ids = PieceTable(self.v, piece.encode()).tokens()
        return struct.pack(f"<{len(ids)}I", *ids)


class EditableText:
    """A text with its ids, kept exact under appends and edits by encoding again only the pieces near them."""

    def __init__(self, encoder: Encoder, pattern: str, text: str = ""):
        self.e, self.pattern, self.text = encoder, regex.compile(pattern), ""
        self.pieces: list[str] = []
        self.encoded = 0
        self.replace(0, 0, text)

    def _back_to(self, place: int) -> tuple[int, int]:
        """Index and start of the second piece before the one that reaches the place: what a change there can alter."""
        at = k = 0
        starts = []
        for k, p in enumerate(self.pieces):
            if at + len(p) >= place:
                break
            starts.append(at)
            at += len(p)
        else:
            k = len(self.pieces)
        starts.append(at)
        back = max(0, k - 2)
        return back, starts[back] if back < len(starts) else at

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        k, at = self._back_to(start)
        text = self.text[:start] + new + self.text[end:]
        shift, old, j, place = len(new) - (end - start), self.pieces, k, at
        fresh: list[str] = []
        for m in self.pattern.finditer(text, at):
            while j < len(old) and place + shift < m.start():
                place += len(old[j])
                j += 1
            if m.start() >= start + len(new) and place >= end and place + shift == m.start() and j < len(old):
                break  # from here on the pieces are the old ones
            fresh.append(m.group())
        else:
            j = len(old)
        self.text, self.pieces = text, old[:k] + fresh + old[j:]
        self.encoded = len(fresh)

    def ids(self) -> bytes:
        return b"".join(map(self.e.__getitem__, self.pieces))


class Decoder:
    """Packed ids back to bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = [b""] * (max(vocabulary.bytes, default=0) + 1)
        for i, t in vocabulary.bytes.items():
            self.table[i] = t

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


@lru_cache(2)
def loaded(ranks_path: str, pattern: str, remembered: int = REMEMBERED_PIECES) -> tuple[Encoder, Decoder]:
    """A worker's encoder and decoder, kept from task to task."""
    v = Vocabulary(read_ranks(ranks_path))
    return Encoder(v, pattern, remembered), Decoder(v)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, remembered: int = REMEMBERED_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and ids (packed) if asked for.

    Null texts count as empty (no tokens, digests of nothing); texts are encoded whole; repeated rows give repeated
    results; other columns of docs are not read; an empty table gives an empty one. One pass, no shuffle; a worker keeps
    twice so many pieces as remembered says at most, which costs memory and saves time but doesn't change results.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def make():
        (encoder, decoder), sha = loaded(ranks_path, pattern, remembered), hashlib.sha256

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, raw = [], [], [], []
            for _, text in rows_of(batch, "text"):
                ids = encoder.encode(text)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(decoder.decode(ids)).hexdigest())
                if with_ids:
                    raw.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

        return each

    return in_batches(docs).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_batch(make), schema)

