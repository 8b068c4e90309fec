"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

A text gets one blank in front, blanks become the mark U+2581, and it is cut into marked words, across
which no piece of the vocabulary reaches (this is checked when the vocabulary is loaded). The distinct
words of a batch are sorted, which lays them out as a trie in depth-first order: a word takes over the
forward scores of the prefix it shares with the word before it, and only its rest is scored. The best
segmentation has the highest sum of piece scores; of equal ones, the one with the longer last piece.
Characters without a piece are spelled in byte pieces, and so is a literal U+2581, so that decoding
gives back every text exactly.

Scores are those of the model file if it is a unigram model. A byte-pair model's file holds ranks in
their place, which are no log probabilities; the score is then ``-log(rank + 1000)``, as by Zipf's law.
The result is the best path by these scores; it need not be what the merges of that model would give.

Words are encoded where they stand: the vocabulary travels with the plan (its size is that of the model
file), and no text is shuffled. Null and empty texts have no pieces; null stays null when decoded. Repeated
rows are encoded alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from inkblot.llm.common import lean_batches, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\udc81"  # stands for a mark in the text itself; no valid text has a lone surrogate
WORDS = re.compile(r" *[^ \n]+| +|\n")
KNOWN_WORDS, KNOWN_CHARS = 500_000, 8 << 20  # at some 250 bytes a word, about 125 MB
BATCH = "4m"  # texts, words and ids of a batch are in memory together, as objects and as Arrow


@dataclass
class Vocabulary:
    packed: dict[str, bytes]  # the id of each piece, as the bytes of a 32-bit number
    scores: dict[str, float | None]  # of pieces, and None for what a longer piece ends with
    byte_ids: list[int]
    byte_score: float
    spelled: list[bytes]  # of each id, the bytes it stands for
    endings: dict | None = None  # see ending_tree; built where words are encoded


def load(model: str = MODEL) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file that has byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    packed, scores, byte_ids, spelled = {}, {}, [0] * 256, []
    for i in range(m.vocab_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            spelled.append(bytes([int(piece[1:-1], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            spelled.append(b"")
        else:
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} reaches across words")
            packed[piece], scores[piece] = np.int32(i).tobytes(), m.get_score(i)
            spelled.append(piece.replace(MARK, " ").encode())
    if all(float(x).is_integer() for x in scores.values()):
        scores = {piece: -math.log(1000 - x) for piece, x in scores.items()}
    worst = min(scores.values()) - 10
    tails = {piece[i:] for piece in scores for i in range(1, len(piece))}
    return Vocabulary(packed, scores | dict.fromkeys(tails.difference(scores)), byte_ids, worst, spelled)


def ending_tree(v: Vocabulary) -> dict[str, tuple[float, dict]]:
    """Pieces from their last character backwards: of each ending its score (minus infinity if it is no piece), and longer ones."""
    if v.endings is None:
        v.endings = {}
        for piece, score in v.scores.items():
            if score is not None:
                level = v.endings
                for char in piece[:0:-1]:
                    level = level.setdefault(char, (-math.inf, {}))[1]
                level[piece[0]] = (score, level[piece[0]][1] if piece[0] in level else {})
    return v.endings


def encode_words(words: Iterable[str], v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """Each distinct marked word with its ids (the bytes of 32-bit numbers), in sorted order."""
    best: list[float] = [0.0]  # forward score before each character of the word at hand
    back: list[int] = [0]  # where the last piece of the best segmentation up to there begins
    before = ""
    endings, packed = ending_tree(v), v.packed
    longest = max(map(len, packed), default=0)
    for word in sorted(words):
        kept, size, backwards = 0, len(word), word[::-1]
        for x, y in zip(before, word):
            if x != y:
                break
            kept += 1
        if len(best) <= size:
            more = [0] * (size + 1 - len(best))
            best += more
            back += more
        for end in range(kept + 1, size + 1):
            at, begin, top, longer = end, -1, -1e300, endings
            for char in backwards[size - end : size - end + longest]:
                found = longer.get(char)
                if found is None:
                    break  # no piece ends with this
                at -= 1
                score, longer = found
                if best[at] + score >= top:
                    top, begin = best[at] + score, at
            if word[end - 1] not in packed:
                spelled = best[end - 1] + v.byte_score * len(_spelling(word[end - 1]))
                if begin < 0 or spelled > top:
                    top, begin = spelled, end - 1
            best[end] = top
            back[end] = begin
        before = word
        ids, end = [], size
        while end:
            begin = back[end]
            ids.append(packed.get(word[begin:end]) or _byte_pieces(_spelling(word[begin]), v))
            end = begin
        ids.reverse()
        yield word, b"".join(ids)


def _spelling(char: str) -> bytes:
    return MARK.encode() if char == LITERAL else char.encode("utf-8", "surrogatepass")


def _byte_pieces(spelled: bytes, v: Vocabulary) -> bytes:
    return np.array([v.byte_ids[x] for x in spelled], np.int32).tobytes()


def marked_words(text: str) -> list[str]:
    return WORDS.findall(" " + text) if text else []


def marked(word: str) -> str:
    return word.replace(MARK, LITERAL).replace(" ", MARK)


class Encoder:
    """Encodes texts; remembers words. When it knows too many, those not met since it last did are forgotten.

    ``exact`` stays true as long as the ids of every word spell it: then all texts come back as they were.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.older, self.chars, self.exact = v, {}, {}, 0, True
        self.sizes = np.array([len(x) for x in v.spelled], np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers."""
        split = [marked_words(t) for t in texts]
        if 2 * len(self.known) > KNOWN_WORDS or 2 * self.chars > KNOWN_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        new = set().union(*split).difference(self.known)
        again = {w for w in new if w in self.older}
        self.known.update((w, self.older[w]) for w in again)
        spelled = {marked(w): w for w in new.difference(again)}
        coded = list(encode_words(spelled, self.v))
        self.known.update((spelled[word], ids) for word, ids in coded)
        self.chars += sum(map(len, new))
        self.exact = self.exact and self._spelled_back([spelled[word] for word, _ in coded], [ids for _, ids in coded])
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def _spelled_back(self, words: list[str], coded: list[bytes]) -> bool:
        """Whether the ids of each word spell it: sizes are compared word by word, bytes of all words at once."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = np.frombuffer(b"".join(coded), np.int32)
        ends = np.cumsum([len(c) // 4 for c in coded], dtype=np.int64)
        spelled = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        return bool((spelled[ends] == np.cumsum([len(d) for d in data], dtype=np.int64)).all()) and spell(ids.tolist(), self.v) == b"".join(data)


def parts(texts: list[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """A batch in parts of about ``size`` characters: words are many times larger as objects."""
    some, total = [], 0
    for text in texts:
        some.append(text)
        total += len(text)
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


def spell(ids: Iterable[int], v: Vocabulary) -> bytes:
    return b"".join([v.spelled[i] for i in ids])


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    data = spell(ids, v)
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", exact: str = "exact") -> DataFrame:
    """The rows of ``docs`` with their ``ids``, and ``exact``: decoding them gave the text back."""
    small_batches(docs.sparkSession, BATCH)
    v = load(model)
    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType())).add(exact, "boolean")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for b in batches:
            texts = b.column(at).to_pylist()
            coded = [c for some in parts([t or "" for t in texts]) for c in encoder(some)]
            offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), np.int32)
            same = [encoder.exact or decode_ids(np.frombuffer(c, np.int32).tolist(), v) == (t or "") for c, t in zip(coded, texts)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            del texts, coded, flat
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(same)], names=[*b.schema.names, ids, exact])

    return docs.mapInArrow(lean_batches(run), schema)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``docs`` with the text that their ``ids`` stand for; ids outside the vocabulary stand for nothing."""
    small_batches(docs.sparkSession, BATCH)
    v = load(model)
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else decode_ids((i for i in x if i is not None and 0 <= i < len(v.spelled)), v) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return docs.mapInArrow(lean_batches(run), StructType(list(docs.schema.fields)).add(text, "string"))
