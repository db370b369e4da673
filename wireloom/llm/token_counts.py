"""Token counts of a sentencepiece BPE vocabulary, with a shortcut for whole tokens.

The vocabulary is studied once on the driver. (1) No piece has a space after
something else, so merges never cross from a word into the space behind it, and
none has a line break, so merges never cross one: a text's count is the sum of
its pre-tokens' counts. (2) Every vocabulary string that encodes alone as one
token is listed by hash; pre-tokens on the list count 1 by a look-up, and only
the others are merged, each distinct one once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import released, struct_of

SPACE = "▁"
COUNTS = struct_of(n_bytes="long", n_tokens="long")
#: Distinct merged pre-tokens that a worker remembers between batches.
REMEMBER = 400_000


@lru_cache(2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> np.ndarray:
    """Checks what the shortcut rests on; sorted hashes of the pre-tokens that are one token.

    Raises ValueError for a model whose merges could cross a border of
    pre-tokens, or that rewrites texts before it splits them.
    """
    from sentencepiece import sentencepiece_model_pb2 as spec

    with open(path, "rb") as f:
        model = spec.ModelProto.FromString(f.read())
    rules, training = model.normalizer_spec, model.trainer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
        raise ValueError("the model rewrites texts")
    if training.treat_whitespace_as_suffix or not training.byte_fallback:
        raise ValueError("the model puts spaces behind words, or has no bytes")
    kinds = spec.ModelProto.SentencePiece
    if any(p.type == kinds.USER_DEFINED for p in model.pieces):
        raise ValueError("the model has strings that come before merges")
    pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    for piece in pieces:
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"the piece {piece!r} crosses a border of pre-tokens")
    # A pre-token here is one space and a word: what stands in a text as " word".
    words = [p[1:] for p in pieces if p.startswith(SPACE) and p[1:] and SPACE not in p[1:]]
    alone = [w for w, ids in zip(words, _model(path).encode(words), strict=True) if len(ids) == 1]
    column = pa.array(alone)
    data, offsets = B.utf8(column)
    return np.sort(B.span_hash(B.prefix_hash(data), offsets[:-1], offsets[1:]))


#: Bytes that end a word, and those that send a whole text to the library as it is.
_BORDER = B.byte_class((0x20, 0x20), (0x0A, 0x0A))
_SPACE_MARK = np.frombuffer(SPACE.encode(), np.uint8)


class Counter:
    """Counts the tokens of batches of texts; lives in a worker."""

    def __init__(self, path: str, alone: np.ndarray):
        self.model, self.alone = _model(path), alone
        self.known_keys, self.known_counts = np.zeros(0, B.U), np.zeros(0, np.int64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Tokens of each word with a single space before it."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for table, values in ((self.alone, None), (self.known_keys, self.known_counts)):
            if len(table):
                at = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
                hit = table[at] == distinct
                counts[hit] = 1 if values is None else values[at[hit]]
        rest = np.flatnonzero(counts == 0)
        if len(rest):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[first[rest]].tolist(), ends[first[rest]].tolist(), strict=True)]
            counts[rest] = [len(ids) for ids in self.model.encode(texts, num_threads=1)]
            if len(self.known_keys) + len(rest) > REMEMBER:
                self.known_keys, self.known_counts = self.known_keys[:0], self.known_counts[:0]
            keys_ = np.concatenate([self.known_keys, distinct[rest]])
            order = np.argsort(keys_)
            self.known_keys, self.known_counts = keys_[order], np.concatenate([self.known_counts, counts[rest]])[order]
        return counts[back]

    def texts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for lo, hi, data, offsets in B.chunks(column):
            out[lo:hi] = self._chunk(data, offsets)
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_rows, n = len(offsets) - 1, len(data)
        if n == 0:
            return np.zeros(n_rows, np.int64)
        starts, ends = B.runs(~_BORDER[data], offsets)
        row, _ = B.rows_of(starts, offsets)
        # The library puts one space before a text, so its first word has one as well.
        at_row = offsets[row] == starts
        previous = data[np.maximum(starts - 1, 0)]
        spaced = at_row | (previous == 0x20)
        second = np.maximum(starts - 2, 0)
        # One space exactly: the byte before it is neither a space nor outside the text.
        single = at_row | (spaced & (starts - 2 >= offsets[row]) & (data[second] != 0x20))
        plain = single.copy()
        counts = np.zeros(len(starts), np.int64)
        keys = B.span_hash(B.prefix_hash(data), starts, ends)
        counts[plain] = self.words(data, starts[plain], ends[plain], keys[plain])
        total = np.bincount(row, weights=counts, minlength=n_rows).astype(np.int64)
        total += B.per_row(data == 0x0A, offsets)  # a line break is one byte token

        # The rest: runs of several spaces with the word behind them, words behind a line
        # break, and spaces at the end of a line or text. They are encoded as they stand.
        odd = self._odd_rows(data, offsets)
        covered = np.zeros(n + 1, np.int64)
        covered[starts[plain]] += 1
        covered[ends[plain]] -= 1
        mask = np.cumsum(covered[:-1]) == 0
        lead = starts[plain & ~at_row] - 1
        mask[lead] = False
        mask &= data != 0x0A
        a, b = self._pieces(mask, data, offsets)
        piece_row, _ = B.rows_of(a, offsets)
        raw = data.tobytes()
        memo: dict[tuple[bool, bytes], int] = {}
        for s, e, r in zip(a.tolist(), b.tolist(), piece_row.tolist(), strict=True):
            if not odd[r]:
                key = (s == offsets[r], raw[s:e])
                if key not in memo:
                    memo[key] = self._piece(*key)
                total[r] += memo[key]
        # A space before the text that no word takes is a token of its own.
        some = np.flatnonzero((np.diff(offsets) > 0) & ~odd)
        total[some] += data[offsets[some]] == 0x0A
        for r in np.flatnonzero(odd).tolist():
            total[r] = len(self.model.encode(raw[offsets[r] : offsets[r + 1]].decode()))
        return total

    @staticmethod
    def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with a literal space mark, which the library takes for a space, or a NUL."""
        mark = np.zeros(len(data), bool)
        if len(data) >= 3:
            mark[:-2] = (data[:-2] == _SPACE_MARK[0]) & (data[1:-1] == _SPACE_MARK[1]) & (data[2:] == _SPACE_MARK[2])
        return B.per_row(mark | (data == 0), offsets) > 0

    @staticmethod
    def _pieces(mask: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of mask, cut where a space follows something else."""
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        starts, ends = B.runs(mask, offsets)
        inner = np.flatnonzero(cut & mask)
        inner = inner[~np.isin(inner, starts)]
        return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))

    def _piece(self, first: bool, raw: bytes) -> int:
        text = raw.decode()
        if first:
            return len(self.model.encode(text))
        if text[0] == " ":  # the library's own space stands for the first one
            return len(self.model.encode(text[1:])) if len(text) > 1 else 1
        return len(self.model.encode("\n" + text)) - 2  # the space before, the line break


def token_counts(text: Column, path: str) -> Column:
    """A struct of n_bytes and n_tokens of each text; a null text counts as empty: 0 and 0.

    path is a sentencepiece BPE model that every worker can read. Counts are the
    library's own, without begin, end or other added tokens. Very long texts
    are held one at a time.
    """
    alone = prove(path)  # at most one hash per vocabulary entry

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path, alone)
        for column in batches:
            _, offsets = B.utf8(column)
            yield pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(counter.texts(column))], names=["n_bytes", "n_tokens"])

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    count = released(count)
    return F.arrow_udf(count, COUNTS).asNondeterministic()(text)
