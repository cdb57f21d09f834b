"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is normalised as the model asks (a mark for each space and one before the text) and cut into marked words: a run
of marks and the characters up to the next mark. No piece of the model has a mark after another character, so words are
segmented on their own. The distinct words of a batch that are not yet known are sorted; sorted order is the
depth-first order of their trie, so the forward states of a word are kept up to the prefix it shares with the next word
and only the rest is computed. Known words are kept per task in a table of bounded size.

Lattice and scores. Arcs are pieces (or single unknown characters); a path scores the sum of its pieces' scores, and the best
path to each prefix is kept. For a unigram model all paths are allowed. For a merge (BPE) model two adjacent pieces are allowed
only if merging their characters by piece score gives back exactly the two; every other transition scores minus infinity. Of a
prefix's paths through all its pieces then only the merge result has a finite score, and the forward state of a prefix is its last
piece. Whether two pieces may stand together is worked out once per pair and kept. Ids equal those of the sentencepiece library.

Unknown characters become their UTF-8 bytes' pieces. The tokenizer file is read on the driver and its piece table is
broadcast (32,000 pieces).

Cases: null and empty texts have no ids. The mark character itself in a text is encoded like a space, as the library
does, and comes back as one: ``round_trip`` is then false. Of paths with equal scores the one whose last piece is longest wins;
equal merge scores go leftmost first, as in the library. Repeated rows, null ids: encoded like any row. Very long texts are encoded
whole; a word costs time in proportion to its length. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import texts, without

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MAX_WORDS = 600_000
MAX_PAIRS = 1_000_000
UNKNOWN_SCORE = -1e6

#: Encoders of this process by their vocabulary: what they have learned serves later tasks of the same worker.
_encoders: dict[int, Encoder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """ids and scores of ordinary pieces; byte_ids: 256 ids; surface: the bytes an id decodes to. What encoding needs beyond that is made by
    the Encoder, in the executors."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes]
    merges: bool
    unk: int
    key: int = field(init=False)

    def __post_init__(self) -> None:
        self.key = zlib.crc32(repr((sorted(self.scores.items()), self.merges)).encode())


def load(model_file: str | None = None, merges: bool = True) -> Vocabulary:
    """The piece table of a model file; ``merges``: whether it is a merge (BPE) model, else a unigram model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
    ids, scores, surface, byte_ids = {}, {}, [], [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            surface.append(b"")
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            surface.append(piece.replace(MARK, " ").encode())
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece has a mark after another character: words cannot be segmented on their own")
    return Vocabulary(ids, scores, byte_ids, surface, merges, sp.unk_id())


class Encoder:
    """Segments words; keeps what it has learned about words and pairs, within bounds."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # a trie of the pieces read backwards; the key "" holds the piece that starts there
        self.ends: dict = {}
        for piece in vocabulary.ids:
            node = self.ends
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = piece

    def merged(self, text: str) -> list[str]:
        """Merge characters by piece score, leftmost first among equals, until no pair is a piece. Pairs wait in a heap."""
        scores, n = self.v.scores, len(text)
        parts: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(-s, i, pair) for i, pair in enumerate(map(str.__add__, parts, parts[1:])) if (s := scores.get(pair)) is not None]
        heapify(waiting)
        while waiting:
            _, i, pair = heappop(waiting)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := scores.get(more := pair + parts[after[i]])) is not None:
                    heappush(waiting, (-s, i, more))
            if before[i] >= 0 and (s := scores.get(more := parts[before[i]] + pair)) is not None:
                heappush(waiting, (-s, before[i], more))
        return [p for p in parts if p]

    def allowed(self, left: str, right: str) -> bool:
        """Whether merging keeps the two pieces as they are (with an empty left one: whether it makes the right one)."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        got = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def forward(self, word: str, state: list[tuple[str, float] | None]) -> None:
        """Extend ``state`` (for each prefix of ``word``, its last piece and score; the empty prefix first) to the whole word."""
        scores, merges, pairs = self.v.scores, self.v.merges, self.pairs
        for end in range(len(state), len(word) + 1):
            best: tuple[str, float] | None = None
            node: dict | None = self.ends
            start = end
            while start > 0:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                before, piece = state[start], node.get("")
                if before is None or piece is None:
                    continue
                if merges:
                    ok = pairs.get((before[0], piece))
                    if ok is None:
                        ok = self.allowed(before[0], piece)
                    if not ok:
                        continue
                total = before[1] + scores[piece]
                if best is None or total >= best[1]:
                    best = (piece, total)
            if best is None and state[end - 1] is not None and word[end - 1] not in scores:
                best = (word[end - 1], state[end - 1][1] + UNKNOWN_SCORE)  # an unknown character stands alone
            state.append(best)

    def learn(self, words: Iterable[str]) -> None:
        """Segment words that are not known yet, in sorted order, reusing the forward states of common prefixes."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        last, state = "", [("", 0.0)]
        for word in sorted(words):
            del state[len(commonprefix((last, word))) + 1 :]
            self.forward(word, state)
            last = word
            ids: list[int] = []
            end, pieces = len(word), []
            while end > 0 and state[end] is not None:
                pieces.append(state[end][0])
                end -= len(state[end][0])
            for piece in reversed(pieces) if end == 0 else self.merged(word):
                i = self.v.ids.get(piece)
                ids += [i] if i is not None else [self.v.byte_ids[b] for b in piece.encode()]
            self.words[word] = array("i", ids).tobytes()

    def encode(self, parts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut = [_WORD.findall(MARK + p.replace(" ", MARK)) if p else [] for p in parts]
        known = self.words
        self.learn({w for words in cut for w in words if w not in known} if len(known) <= MAX_WORDS else {w for words in cut for w in words})
        return [b"".join(map(known.__getitem__, words)) for words in cut]


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """This process's encoder for a vocabulary; only the latest one is kept."""
    if vocabulary.key not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.key] = Encoder(vocabulary)
    return _encoders[vocabulary.key]


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids, without the space that encoding puts before it."""
    raw = b"".join(map(vocabulary.surface.__getitem__, ids))
    return raw.decode("utf-8", "replace").removeprefix(" ")


def encode_documents(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: Vocabulary | None = None, verify: bool = True) -> DataFrame:
    """``keep``, ids (array of int), n_pieces and round_trip (decoded text equals the source) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load())
    keep = without(keep, ("ids", "n_pieces", "round_trip"))
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).withColumns({"ids": F.array(F.lit(0)), "n_pieces": F.lit(0).cast("long"), "round_trip": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for first, part in texts(batch, step=256):
                found = encoder.encode(part)
                sizes = np.array([len(x) // 4 for x in found])
                flat = np.frombuffer(b"".join(found), np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                same = [not verify or decode(encoder.v, flat[a:b].tolist()) == (p or "") for a, b, p in zip(ends, ends[1:], part, strict=False)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, len(part)) for i in range(len(keep))], ids, pa.array(sizes, pa.int64()), pa.array(same)], names=[*keep, "ids", "n_pieces", "round_trip"])

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, keep: list[str], ids_col: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """``keep`` and text of every row; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load())
    keep = without(keep, ("text",))
    source = encoded.select(*keep, F.col(ids_col).alias("_ids"))
    schema = encoded.select(*keep).withColumn("text", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else decode(shared.value, x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
