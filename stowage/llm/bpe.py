"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket of linked-list positions per merge rank and a bitmap
of the non-empty buckets in levels of 64-bit words, so that the next rank is
found with one find-first-set per level. Entries are never removed when a
neighbour merges; an entry whose pair has changed is skipped when its bucket
comes up. A bucket is merged as one numpy step. Many pre-tokens are laid one
after the other and go through a single run of the queue (pairs never cross
their ends), and one very long pre-token runs in the same way.

Merging a whole bucket at once equals merging one pair at a time, leftmost
first, unless a merge can create a pair of lower rank. The ranks for which the
vocabulary allows that are known in advance; for them only the leftmost entry
of each pre-token is merged before the queue is asked again.

What lies around the queue (words and their numbers, ids as text, decoded bytes)
stays in Arrow buffers: the bytes of values that are taken in order are the
bytes of their concatenation, so rows are cut out of them, not joined.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import resident, vocabulary_file

NONE = np.int64(-1)
#: Marks of block keys; no UTF-8 text holds them.
FIRST, ODD = "\ud800", "\ud801"
#: Blocks of up to as many characters are remembered for long.
SHORT = 64
#: A single space between two characters that no definition calls white space.
SPLIT = re.compile(r"(?<=\S) (?=\S)")


class RankQueue:
    """Buckets per rank under a bitmap of levels; ``pop`` takes the lowest rank's positions."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = ranks
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            filled = level[word]
            level[word] = filled | bit
            if filled:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        bits = int(positions.max()).bit_length()
        both = ranks << bits | positions
        both.sort()
        ranks, positions = both >> bits, both & (1 << bits) - 1
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), len(ranks)]
        for rank, begin, end in zip(ranks[begins].tolist(), begins, ends):
            self.push(rank, positions[begin:end])

    def pop(self) -> tuple[int, np.ndarray] | None:
        index = 0
        for level in reversed(self.levels):
            word = level[index]
            if not word:
                return None
            index = (index << 6) | ((word & -word).bit_length() - 1)
        rank = index
        for level in self.levels:
            word = index >> 6
            level[word] &= ~(1 << (index & 63))
            if level[word]:
                break
            index = word
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Vocabulary:
    """Merge ranks of a byte-level BPE: token bytes to rank, every single byte included."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = size
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None:
                    right = ranks.get(token[cut:])
                    if right is not None:
                        keys.append(left * (size + 1) + right)
                        values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        #: keys of pairs in order, and one above all that any pair can have
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, np.int64)[order], NONE)
        left, right = np.divmod(self.pair_keys[:-1], size + 1)
        #: ranks whose token can be part of a pair of lower rank
        self.lowering = np.zeros(size, bool)
        self.lowering[left[self.pair_ranks[:-1] < left]] = True
        self.lowering[right[self.pair_ranks[:-1] < right]] = True
        #: ranks of the pairs of single bytes
        self.byte_pairs = self.pair_rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    @classmethod
    def load(cls, path: str, pattern: str) -> "Vocabulary":
        """Read a file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; the id ``size`` marks an end and forms none."""
        keys = left * (self.size + 1) + right
        at = self.pair_keys.searchsorted(keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token, all of them in one run of the queue."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, counts = self.encode_run(b"".join(pieces), lengths)
        flat, out, begin = ids.tolist(), [], 0
        for count in counts.tolist():
            out.append(flat[begin : begin + count])
            begin += count
        return out

    def encode_run(self, data: bytes | pa.Buffer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pre-tokens of ``lengths`` bytes, and how many ids each has."""
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        raw = np.frombuffer(data, np.uint8, total)
        # the place after the last byte is the neighbour of both ends of every pre-token
        ids = np.append(self.byte_ids[raw], self.size)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        after = np.arange(1, total + 2)
        before = np.arange(-1, total)
        last = ends[lengths > 0] - 1
        after[last] = after[total] = total
        before[(ends - lengths)[lengths > 0]] = total
        current = np.full(total + 1, NONE)
        current[: total - 1] = self.byte_pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        current[last] = NONE
        queue = RankQueue(self.size)
        inner = np.flatnonzero(current != NONE)
        queue.push_all(current[inner], inner)
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[current[at] == rank]  # stale entries go
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                if self.lowering[rank]:
                    owner = piece[at]
                    first = np.ones(len(at), bool)
                    np.not_equal(owner[1:], owner[:-1], out=first[1:])
                    if not first.all():
                        # overlapping pairs too: what the first merges consume goes stale
                        queue.push(rank, at[~first])
                        at = at[first]
                else:
                    chained = np.zeros(len(at), bool)
                    np.equal(after[at[:-1]], at[1:], out=chained[1:])
                    if chained.any():  # a run of overlapping pairs: every other one, from the left
                        index = np.arange(len(at))
                        start = np.maximum.accumulate(np.where(chained, 0, index))
                        at = at[(index - start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            ids[at] = rank
            ids[gone] = current[gone] = NONE
            after[at] = beyond
            before[beyond] = at
            lead = before[at]
            if len(at) > 1:  # neighbours that are merged in this step are among ``at``
                other = np.ones(len(at), bool)
                np.not_equal(beyond[:-1], at[1:], out=other[1:])
                lead = lead[other]
            touched = np.concatenate((at, lead))
            current[touched] = found = self.pair_rank(ids[touched], ids[after[touched]])
            some = np.flatnonzero(found != NONE)
            queue.push_all(found[some], touched[some])
        alive = np.flatnonzero(ids[:total] != NONE)
        return ids[alive], np.bincount(piece[alive], minlength=len(lengths))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a list of token ids; unknown ids raise ``IndexError``."""
        return b"".join([self.tokens[i] for i in ids])


def _spans(array: pa.Array) -> np.ndarray:
    """Where the values of a large string or binary array begin and end in its buffer."""
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], np.int64, len(array) + 1 + array.offset)[array.offset :]


def _grouped(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The concatenations of ``values`` between ``offsets``, in their own buffer."""
    data = values.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(values.type, len(offsets) - 1, [None, pa.py_buffer(_spans(values)[offsets]), data])


def _starts(counts: np.ndarray) -> np.ndarray:
    """The sums of the counts before each place, and that of all."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


class Encoder:
    """Encodes whole texts; remembers the ids of blocks, a bounded number of them.

    A block is what lies between two single spaces, the first of them included.
    No match of the pattern crosses the place before such a space, so blocks
    can be split into pre-tokens independently. Two kinds have marked keys: a
    text's first block, and blocks with white space at their end or spaces inside.
    This holds for the PATTERN of the public tokenizers; with any other a whole text is one block.

    Blocks are numbered as they are learned; their ids and bytes are rows of Arrow
    tables. When there are more than ``limit``, or SHORT characters for each of these, half as
    many stay: the most frequent ones of up to SHORT characters.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 1 << 17):
        self.vocabulary = vocabulary
        self.limit = limit
        self.by_blocks = vocabulary.pattern.pattern == public_tokenizers.PATTERN
        self.names = pa.array([b"%d " % rank for rank in range(vocabulary.size)], pa.large_binary())
        self.tokens = pa.array(vocabulary.tokens, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: per block: number of ids (less than 0 for what isn't a block), of uses, and of the key's characters
        self.counts = self.uses = self.sizes = np.zeros(0, np.int64)
        #: per block: its ids, the same in decimal with a space after each, the bytes they decode to
        self.ids = pa.array([], pa.large_list(pa.int32()))
        self.decimal = self.raw = pa.array([], pa.large_binary())

    def trim(self) -> None:
        """Once blocks are too many or take too much, keep the short ones of most uses; uses count half from then on."""
        if not self.by_blocks:
            self.forget()
            return
        if len(self.known) <= self.limit and self.sizes.sum() <= self.limit * SHORT:
            return
        short = np.flatnonzero(self.sizes <= SHORT)
        kept = np.sort(short[np.argsort(self.uses[short], kind="stable")[::-1][: self.limit // 2]])
        keys = list(self.known)
        self.known = {keys[number]: at for at, number in enumerate(kept.tolist())}
        self.counts, self.uses, self.sizes = self.counts[kept], self.uses[kept] // 2, self.sizes[kept]
        self.ids, self.decimal, self.raw = self.ids.take(kept), self.decimal.take(kept), self.raw.take(kept)

    def learn(self, keys: set[str]) -> None:
        """Encode the blocks of unknown keys, all their distinct pre-tokens in one run of the queue."""
        if not keys:
            return
        plain, odd, none = [], [], []
        for key in keys:
            if not key or key[0].isspace() or key[-1].isspace() and key[0] != ODD and key[0] != FIRST:
                none.append(key)
            elif key[0] == FIRST or key[0] == ODD:
                odd.append(key)
            else:
                plain.append(key)
        pieces = self.vocabulary.pattern.findall(" " + " ".join(plain)) if plain else []
        begins = [at for at, piece in enumerate(pieces) if piece[0] == " "]
        for key in odd:
            begins.append(len(pieces))
            pieces += self.vocabulary.pattern.findall(key[1:] if key[0] == FIRST else " " + key[1:])
        distinct = pa.array(pieces, pa.large_string()).dictionary_encode()
        which = distinct.indices.to_numpy()
        ids, counts = self.vocabulary.encode_run(distinct.dictionary.buffers()[2], np.diff(_spans(distinct.dictionary)))
        # the ids of each piece in the place of each of its occurrences
        starts, sizes = _starts(counts)[which], counts[which]
        ends = _starts(sizes)
        ids = ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = ends[np.array([*begins, *[len(pieces)] * (len(none) + 1)], np.int64)]
        ordered = plain + odd + none
        for key in ordered:
            self.known[key] = len(self.known)
        counts = np.diff(offsets)
        counts[len(counts) - len(none) :] = -1
        self.counts = np.concatenate((self.counts, counts))
        self.uses = np.concatenate((self.uses, np.zeros(len(counts), np.int64)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, ordered), np.int64, len(ordered))))
        self.ids = pa.concat_arrays([self.ids, pa.LargeListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))])
        self.decimal = pa.concat_arrays([self.decimal, _grouped(self.names.take(ids), offsets)])
        self.raw = pa.concat_arrays([self.raw, _grouped(self.tokens.take(ids), offsets)])

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The blocks' numbers; unknown ones are learned."""
        self.learn(set(keys).difference(self.known))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def blocks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the blocks of all texts, and where each text's begin; blocks without ids are left out."""
        self.trim()
        if not self.by_blocks:
            return self.numbers([FIRST + text for text in texts.to_pylist()]), np.arange(len(texts) + 1)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        later = np.ones(len(words), bool)
        later[offsets[:-1]] = False
        rest = words.filter(pa.array(later)).dictionary_encode()
        keys = rest.dictionary.to_pylist()
        firsts = [FIRST + word for word in words.take(pa.array(offsets[:-1])).to_pylist()]
        numbers = self.numbers(keys + firsts)
        at = np.empty(len(words), np.int64)
        at[later] = numbers[rest.indices.to_numpy()]
        at[offsets[:-1]] = numbers[len(keys) :]
        none = np.flatnonzero(self.counts[at] < 0)
        if len(none):
            runs = np.split(at, offsets[1:-1])
            unlike = np.unique(np.searchsorted(offsets, none, "right") - 1).tolist()
            split = []
            for row in unlike:
                parts = SPLIT.split(texts[row].as_py())
                split.append([FIRST + parts[0], *[ODD + part if " " in part or part[-1].isspace() else part for part in parts[1:]]])
            self.learn(set().union(*split).difference(self.known))
            for row, parts in zip(unlike, split):
                runs[row] = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            at, offsets = np.concatenate(runs), _starts([len(run) for run in runs])
        self.uses += np.bincount(at, minlength=len(self.uses))
        filled = self.counts[at] > 0
        return at[filled], _starts(filled)[offsets]

    def encode_ids(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All ids of the texts in order, and where each text's begin."""
        at, offsets = self.blocks(texts)
        return self.ids.take(at).flatten(), _starts(self.counts[at])[offsets]

    def encode_rows(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """For each text the number of its ids, these in decimal with spaces between them, and the bytes they decode to."""
        at, offsets = self.blocks(texts)
        counts = np.diff(_starts(self.counts[at])[offsets]).tolist()
        decimal, raw = self.decimal.take(at), self.raw.take(at)
        names, pieces = (memoryview(values.buffers()[2] or b"") for values in (decimal, raw))
        name_at, piece_at = _spans(decimal)[offsets].tolist(), _spans(raw)[offsets].tolist()
        for row, count in enumerate(counts):
            end = name_at[row + 1] - 1 if count else name_at[row]  # without the last id's space
            yield count, names[name_at[row] : end], pieces[piece_at[row] : piece_at[row + 1]]

    def encode_batch(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, in decimal with spaces between them, and the bytes they decode to."""
        return [(str(ids, "ascii"), bytes(raw)) for _, ids, raw in self.encode_rows(pa.array(texts, pa.large_string()))]


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    return resident(("bpe", path, pattern), lambda: Encoder(Vocabulary.load(vocabulary_file(path), pattern)))


def _slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, so that memory doesn't follow the batch."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, at + 1
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _parts(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """The texts in runs of about ``most`` bytes each, so that memory doesn't follow the batch."""
    begin = size = 0
    for at, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
        size += length
        if size >= most:
            yield texts[begin:at]
            begin, size = at, 0
    if begin < len(texts):
        yield texts[begin:]


RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_digests(text: Column, path: str, pattern: str) -> Column:
    """Struct column: number of ids, SHA-256 of the decimal ids and of the bytes they decode to."""

    @F.arrow_udf(RESULT)
    def digest(batch: pa.Array) -> pa.Array:
        bpe = encoder(path, pattern)
        counts, id_hashes, decoded_hashes = [], [], []
        for texts in _parts(batch):
            for count, ids, raw in bpe.encode_rows(texts):
                counts.append(count)
                id_hashes.append(hashlib.sha256(ids).hexdigest())
                decoded_hashes.append(hashlib.sha256(raw).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(decoded_hashes, pa.string())], names=RESULT.names)

    return digest(text)


def encode_ids(text: Column, path: str, pattern: str) -> Column:
    """Token ids of each whole text (null: none) as an array of ints."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(batch: pa.Array) -> pa.Array:
        bpe = encoder(path, pattern)
        out = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for texts in _parts(batch.fill_null("")):
            ids, offsets = bpe.encode_ids(texts)
            out[0].append(ids.to_numpy())
            out[1].append(out[1][-1][-1] + offsets[1:])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(out[1]), pa.int32()), np.concatenate(out[0]))

    return encode(text)


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of each array of token ids; null arrays stay null, unknown ids fail the query."""

    @F.arrow_udf(T.BinaryType())
    def decode(batch: pa.Array) -> pa.Array:
        vocabulary = encoder(path, pattern).vocabulary
        # one row's ids at a time as Python numbers
        return pa.array([vocabulary.decode(row.values.to_numpy().tolist()) if row.is_valid else None for row in batch], pa.binary())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of ``docs`` with n_tokens, ids_sha256 and decoded_sha256.

    A null text is encoded as an empty one. Rows are independent: repeated rows,
    ties and null keys come out as they came in; an empty table gives no rows.
    Of the input's columns only doc_id and text are read, so others may clash.
    """
    digests = encode_digests(F.coalesce(F.col("text"), F.lit("")), path, pattern)
    return docs.select("doc_id", digests.alias("_bpe")).select("doc_id", "_bpe.*")
