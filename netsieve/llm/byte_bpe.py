"""Byte-level BPE encoding and decoding by backtracking from longest matches.

The vocabulary's tokens, as Latin-1 strings, form one Aho-Corasick automaton, which
gives the longest token that starts at a byte of a piece. The encoder takes it, then the next shorter prefix token while two
neighbours are not ones that the merges would leave side by side, and steps
back where none is. Whether two tokens may be neighbours depends on nothing
else, so the answers are memoised; an end that failed once is never tried
again, which bounds the work by the piece's length.

Every text is a separate unit of work: no shuffle and no state but two memos of
a fixed greatest size. Defined results: null and empty texts have no ids and
decode to no bytes; a null list of ids decodes to no bytes; ids outside the
vocabulary raise an error. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.llm.shared import release, text_batches

#: Greatest number of entries of each half of a memo, and bytes that are encoded or decoded at once.
MEMO, SLICE = 200_000, 1 << 20


class Memo:
    """Ids by text, of texts of up to 64 characters: a young half and an old one, which goes when the young one is full."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        ids = self.young.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is not None:
                self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) <= 64:
            if len(self.young) >= MEMO:
                self.young, self.old = {}, self.young
            self.young[text] = ids


def runs(words: list[str]) -> Iterator[str]:
    """The words of a text cut at spaces, joined again wherever a blank stands beside a space or at an end."""
    run = [words[0]]
    for left, right in pairwise(words):
        if not left or not right or left[-1].isspace() or right[0].isspace():
            run.append(right)
        else:
            yield " ".join(run)
            run = ["", right]
    yield " ".join(run)


def vocabulary(ranks: bytes) -> dict[int, bytes]:
    pairs = [line.split() for line in ranks.splitlines() if line.strip()]
    return {int(rank): base64.b64decode(token) for token, rank in pairs}


#: Fixed value: the pattern whose pieces never reach over a single space between two characters that aren't blank.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encoding with the vocabulary of one rank file and the splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.spaced = pattern == SPACED
        self.tokens = vocabulary(ranks)
        self.rank_of = {token: rank for rank, token in self.tokens.items()}
        self.find = regex.compile(pattern).findall
        self.width = {rank: len(token) for token, rank in self.rank_of.items()}
        self.pieces = Memo()
        self.neighbours: dict[int, bool] = {}
        self.longest = ahocorasick.Automaton()
        for token, rank in self.rank_of.items():
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.widest = max(map(len, self.rank_of))
        self.shorter = {rank: self._prefix(token) for rank, token in self.tokens.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.tokens):
            self._learn_parts(rank)

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        return next((self.rank_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank_of), None)

    def _learn_parts(self, rank: int) -> None:
        """The two tokens whose merge makes this one; a token that no merge makes is its own parts."""
        token, left = self.tokens[rank], self.shorter[rank]
        while left is not None:
            right = self.rank_of.get(token[len(self.tokens[left]) :])
            if left < rank and right is not None and right < rank and self._stay_apart(left, right):
                self.merged[left, right] = rank
                self.parts[rank] = (left, right)
                return
            left = self.shorter[left]
        self.parts[rank] = (rank, rank)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens.

        Undo merges from the latest on, on the side of the later one, and look
        for an earlier merge that would have crossed the border.
        """
        latest = float("inf")
        while True:
            if self.merged.get((left, right), latest) < latest:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.parts[left][1] != left:
                    latest, left = left, self.parts[left][1]
                    break
                if side == "right" and self.parts[right][0] != right:
                    latest, right = right + 1, self.parts[right][0]
                    break
            else:
                return True

    def _neighbours(self, left: int, right: int) -> bool:
        if len(self.neighbours) >= MEMO:
            self.neighbours.clear()
        known = self.neighbours[left << 32 | right] = self._stay_apart(left, right)
        return known

    def _merge(self, raw: bytes) -> list[int]:
        if raw in self.rank_of:
            return [self.rank_of[raw]]
        piece, size = raw.decode("latin-1"), len(raw)
        reach, token_at, known = self.longest.longest_prefix, self.longest.get, self.neighbours.get
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, None
        while at < size:
            if token is None:  # the longest token from here: the automaton's path, cut back to its last whole token
                end = at + reach(piece[at : at + self.widest])
                while (token := token_at(piece[at:end], None)) is None:
                    end -= 1
            end = at + self.width[token]
            if not dead[end]:
                fits = not out or known(out[-1] << 32 | token)
                if fits is None:
                    fits = self._neighbours(out[-1], token)
                if fits:
                    out.append(token)
                    at, token = end, None
                    continue
            token = self.shorter[token]
            while token is None:
                dead[at] = 1
                token = out.pop()
                at -= self.width[token]
                token = self.shorter[token]
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.young.get(piece)
        if ids is None:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = array("i", self._merge(piece.encode())).tobytes()
                self.pieces.keep(piece, ids)
        return ids

    def _pieces(self, text: str) -> bytes:
        """The ids of a text's pieces, each from the memo or merged."""
        return b"".join(map(self._piece, self.find(text)))

    def _word(self, word: str) -> bytes:
        """The ids of a space and a word; ASCII letters alone are one piece with it."""
        return self._piece(" " + word) if word.isascii() and word.isalpha() else self._pieces(" " + word)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text of a batch.

        No piece reaches over a single space between two characters that
        aren't blank, and how a piece ends never depends on what stands before
        it: so texts are cut there, and each different word of the batch is
        looked up once with its space, split and merged only when it is new.
        A text with a blank beside a space, or at an end, is cut only elsewhere.
        Of another pattern than SPACED nothing of this is known: its texts are
        split whole.
        """
        if not self.spaced:
            ids = [self._pieces(text or "") for text in texts.to_pylist()]
            return spliced(pa.array(ids, pa.large_binary()), np.arange(len(ids)), np.arange(len(ids) + 1))
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        starts = starts - starts[0]
        different, index = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        blank = np.array([not w or w[0].isspace() or w[-1].isspace() for w in different], bool)
        ids = [b"" if b else self._word(w) for w, b in zip(different, blank, strict=True)]
        nothing = len(ids)
        ids.append(b"")
        uncut = np.logical_or.reduceat(blank[index], starts[:-1]) if len(texts) else ()
        for row, (first, end) in enumerate(pairwise(starts)):
            if uncut[row]:
                ids.append(b"".join(map(self._pieces, runs([different[k] for k in index[first:end]]))))
                index[first:end] = nothing
            else:  # the first word has no space before it
                ids.append(self._pieces(different[index[first]]))
            index[first] = len(ids) - 1
        return spliced(pa.array(ids, pa.large_binary()), index, starts)


class Decoder:
    """Decoding, for which the tokens alone are enough."""

    def __init__(self, ranks: bytes) -> None:
        tokens = vocabulary(ranks)
        self.table = pa.array([tokens.get(rank) for rank in range(max(tokens) + 1)], pa.large_binary())

    def decode(self, lists: pa.Array) -> pa.Array:
        lists = pc.fill_null(lists, [])
        starts = lists.offsets.to_numpy()
        found = self.table.take(lists.flatten())
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        ends = offsets(found)[starts - starts[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), found.buffers()[2]]).cast(pa.binary())


def offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def spliced(parts: pa.Array, index: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Lists of 32-bit ids: row r takes the parts that index[starts[r]:starts[r + 1]] names, one after the other."""
    taken = parts.take(pa.array(index))
    ends = offsets(taken)[starts] // 4
    ids = np.frombuffer(taken.buffers()[2] or b"", np.int32)[: ends[-1]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of about SLICE bytes, so that memory doesn't follow Arrow's number of rows."""
    rows = max(1, int(len(column) * SLICE / max(column.nbytes, 1)))
    return (column.slice(at, rows) for at in range(0, len(column), rows))


@cache
def decoder(ranks: bytes) -> Decoder:
    return Decoder(ranks)


@cache
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    return Codec(ranks, pattern)


class ByteBpe:
    """Encoding and decoding columns for one rank file.

    The file (about 50,000 lines, under 1 MB) is read once on the driver and
    broadcast; ``LARGEST`` bounds it.
    """

    LARGEST = 16 << 20

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str) -> None:
        text_batches(spark)
        with open(ranks_path, "rb") as file:
            ranks = file.read(self.LARGEST + 1)
        if len(ranks) > self.LARGEST:
            raise ValueError(f"{ranks_path} has more than {self.LARGEST} bytes")
        self.ranks, self.pattern = spark.sparkContext.broadcast(ranks), pattern

    def encode(self, text: Column | str) -> Column:
        """The ids (array<int>) of a text column."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(ranks.value, pattern)
            for texts in batches:
                parts = [own.encode(part) for part in slices(texts)]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        return bpe_encode(F.col(text) if isinstance(text, str) else text)

    def round_trip(self, text: Column | str) -> Column:
        """struct<ids, packed, decoded> of a text column: one Python worker does all three, slice by slice."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("ids array<int>, packed binary, decoded binary")
        def bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own, back = codec(ranks.value, pattern), decoder(ranks.value)
            for texts in batches:
                parts = [(ids, pack(ids), back.decode(ids)) for ids in map(own.encode, slices(texts))]
                columns = [pa.concat_arrays(x) for x in zip(*parts, strict=True)] or [pa.array([], t) for t in (pa.list_(pa.int32()), pa.binary(), pa.binary())]
                del parts
                yield pa.StructArray.from_arrays(columns, ["ids", "packed", "decoded"])
                del columns
                release()

        return bpe_round_trip(F.col(text) if isinstance(text, str) else text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes (binary) that a list of ids stands for."""
        ranks = self.ranks

        @F.arrow_udf("binary")
        def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = decoder(ranks.value)
            for lists in batches:
                parts = [own.decode(part) for part in slices(lists)]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

        return bpe_decode(F.col(ids) if isinstance(ids, str) else ids)


def pack(lists: pa.Array) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers, as token files hold them."""
    lists = pc.fill_null(lists, [])
    starts = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.flatten().to_numpy().astype("<u4").tobytes()
    ends = pa.py_buffer((starts - starts[0]) * 4)
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, ends, pa.py_buffer(ids)]).cast(pa.binary())


def packed(ids: Column | str) -> Column:
    """pack as a column."""

    @F.arrow_udf("binary")
    def pack_ids(lists: pa.Array) -> pa.Array:
        return pack(lists)

    return pack_ids(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (array<int>), ``packed`` and ``decoded`` (binary)."""
    return docs.select(F.col(id_col), bpe.round_trip(text_col).alias("_encoded")).select(id_col, "_encoded.*")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of ids and SHA-256 digests of what ``encode_documents`` returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
