"""SentencePiece encoding and decoding by a Viterbi pass that words with a common beginning share."""

from __future__ import annotations

import contextlib
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm.common import fresh

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED_WORDS = 300_000
CACHED_PAIRS = 300_000
ENDING = 3
ID_BITS = 32
NO_PIECE = -1
NO_PIECE_SCORE = -1e6
# A marked word: blanks and what follows them, up to the next blank or line feed.
MARKED_WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    """Pieces, ranks and byte pieces of a model.

    ``ranks`` gives the order in which pieces are merged: the smaller, the earlier.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: Iterable[int] = ()):
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := BYTE_PIECE.fullmatch(p))}
        hidden = {*special, *self.bytes.values()}
        self.pieces = pieces
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden}
        self.ranks = {p: -scores[i] for p, i in self.ids.items()}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.endings = piece_endings(self.ids)
        self.special = frozenset(special)
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.ids):
            raise ValueError("a piece of this model goes on over the end of a marked word")

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read a model by the sentencepiece library."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = range(model.get_piece_size())
        special = [i for i in n if model.is_control(i) or model.is_unknown(i)]
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], special)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging, the earliest merge first, from left to right among equals."""
        return self.merges(text)[-1][1]

    def merges(self, text: str) -> list[tuple[float, list[str]]]:
        """The parts of a short text before its first merge and after each one, with the rank of the next merge."""
        parts, steps = list(text), []
        ranks = [self.ranks.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
        while True:
            rank = min(ranks, default=np.inf)
            steps.append((rank, list(parts)))
            if rank == np.inf:
                return steps
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], np.inf)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], np.inf)


class Neighbours:
    """Whether merging leaves two pieces side by side as they are.

    Until something merges over the border between them, the merges of the two go on as they do alone, the
    earlier rank first.  So it is enough to follow the two lists of merges, which are kept per piece, and to
    ask at each step for the rank of the two parts at the border.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[list[float], list[str], list[str]] | None] = {}

    def history(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Ranks of the merges of a piece, and its first and last part at each step; None if they do not end in it."""
        if piece not in self.known:
            steps = self.vocabulary.merges(piece)
            whole = steps[-1][1] == [piece]
            self.known[piece] = ([r for r, _ in steps], [p[0] for _, p in steps], [p[-1] for _, p in steps]) if whole else None
        return self.known[piece]

    def stay(self, before: str, piece: str) -> bool:
        """``before`` is empty at the beginning of a word; a letter that is no piece merges with nothing."""
        right = self.history(piece)
        if right is None:
            return False
        if not before or before not in self.vocabulary.ids:
            return True
        left = self.history(before)
        if left is None:
            return False
        (ranks_a, _, ends), (ranks_b, begins, _), i, j = left, right, 0, 0
        get, never = self.ranks.get, np.inf
        over = get(ends[0] + begins[0], never)
        while True:
            a, b = ranks_a[i], ranks_b[j]
            if a <= b:
                if over < a:
                    return False
                if a == never:
                    return True
                i += 1
                if ends[i] is ends[i - 1]:
                    continue
            else:
                if over <= b:
                    return False
                j += 1
                if begins[j] is begins[j - 1]:
                    continue
            over = get(ends[i] + begins[j], never)


def piece_endings(pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """Lengths of the pieces that end in each ending of up to ``ENDING`` letters, the longest first.

    A piece that is shorter than an ending counts for all endings that end in it, so one look at the last
    letters of a prefix gives all lengths that a piece can have there.
    """
    lengths: dict[str, set[int]] = {}
    for p in pieces:
        lengths.setdefault(p[-ENDING:], set()).add(len(p))
    for ending in sorted(lengths, key=len):
        for i in range(1, len(ending)):
            lengths[ending] |= lengths.get(ending[i:], set())
    return {e: tuple(sorted(found, reverse=True)) for e, found in lengths.items()}


class SharedPrefixEncoder:
    """Encodes words in sorted order, that is depth first through the trie of their letters.

    Forward states belong to prefixes: on the way down a state is added per letter, and on the way back
    to the next word only those behind the common prefix are taken off.  So a prefix that many words
    share is passed once.

    With a model of merges (``merges``) the state of a prefix is the last piece of its encoding.  A piece
    may end there if it may follow the last piece of the prefix before it, that is if merging the two
    alone gives back just these two; exactly one piece may, and walking back from the end of a word gives
    what merging the whole word gives.  With a model of probabilities the state is the best sum of scores
    and the piece that ends it (the usual Viterbi forward score).
    """

    def __init__(self, vocabulary: Vocabulary, merges: bool = True):
        self.vocabulary = vocabulary
        self.merges = merges
        self.neighbours = Neighbours(vocabulary)
        self.follows: dict[int, bool] = {}
        self.encoded: dict[str, tuple[int, ...]] = {}

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether merging leaves the pieces with these ids as they are, side by side; ``NO_PIECE`` comes before the
        first piece and after a letter that is no piece."""
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        pieces = self.vocabulary.pieces
        ok = self.neighbours.stay("" if before == NO_PIECE else pieces[before], pieces[piece])
        self.follows[before << ID_BITS | piece] = ok
        return ok

    def letter_ids(self, letter: str) -> tuple[int, ...]:
        """UTF-8 bytes of a letter that is no piece."""
        return tuple(self.vocabulary.bytes[b] for b in letter.encode("utf-8", "surrogatepass"))

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct marked words.

        A state of a prefix is the id and length of its last piece, and with probabilities the best sum of scores.
        """
        state = self.merge_state if self.merges else self.score_state
        states: list[tuple] = [(NO_PIECE, 0, 0.0)]
        last, out = "", {}
        for word in sorted(words):
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            del states[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                states.append(state(word, end, states))
            out[word], last = self.walk_back(word, states), word
        return out

    def walk_back(self, word: str, states: list[tuple]) -> tuple[int, ...]:
        """Ids of the word whose states these are, from its end."""
        ids, end = [], len(word)
        while end:
            piece, length = states[end][:2]
            if piece == NO_PIECE:
                ids += reversed(self.letter_ids(word[end - 1]))
            else:
                ids.append(piece)
            end -= length
        ids.reverse()
        return tuple(ids)

    def lengths_at(self, word: str, end: int) -> tuple[int, ...]:
        """Lengths of the pieces that may end at ``end``, by the last letters."""
        endings = self.vocabulary.endings
        for n in range(min(ENDING, end), 0, -1):
            found = endings.get(word[end - n : end])
            if found is not None:
                return found
        return ()

    def merge_state(self, word: str, end: int, states: list[tuple]) -> tuple:
        """State of the prefix of ``end`` letters.  One piece may end there; the one that goes on from the last
        piece of the prefix before is asked for first, because it often does."""
        ids, follows = self.vocabulary.ids, self.follows
        likely = states[end - 1][1] + 1
        piece = ids.get(word[end - likely : end])
        if piece is not None:
            before = states[end - likely][0]
            ok = follows.get(before << ID_BITS | piece)
            if ok or (ok is None and self.may_follow(before, piece)):
                return piece, likely
        for length in self.lengths_at(word, end):
            if length > end or length == likely:
                continue
            piece = ids.get(word[end - length : end])
            if piece is None:
                continue
            before = states[end - length][0]
            ok = follows.get(before << ID_BITS | piece)
            if ok or (ok is None and self.may_follow(before, piece)):
                return piece, length
        return NO_PIECE, 1

    def score_state(self, word: str, end: int, states: list[tuple]) -> tuple:
        """State of the prefix of ``end`` letters by the usual Viterbi step: the best sum of scores."""
        best = None
        for length in self.lengths_at(word, end):
            piece = self.vocabulary.ids.get(word[end - length : end]) if length <= end else None
            if piece is not None:
                total = states[end - length][2] + self.vocabulary.scores[self.vocabulary.pieces[piece]]
                if best is None or total > best[2]:
                    best = (piece, length, total)
        return best or (NO_PIECE, 1, states[end - 1][2] + NO_PIECE_SCORE)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the distinct marked words that are not known yet are encoded together."""
        with no_cycle_search():
            return self._encode_texts(texts)

    def _encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        split = [MARKED_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.encoded
        words = set(chain.from_iterable(split))
        if len(known) + len(words) > CACHED_WORDS:
            known.clear()
        known.update(self.encode_words(words.difference(known)))
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, ws)), dtype=np.int32) for ws in split]


def decoder(vocabulary: Vocabulary) -> Callable[[list[int]], str]:
    """Text of ids: pieces put together, bytes read as UTF-8, the blank before the first word taken off."""
    plain = [p.encode("utf-8") for p in vocabulary.pieces]
    for byte, i in vocabulary.bytes.items():
        plain[i] = bytes([byte])
    for i in vocabulary.special:
        plain[i] = b""
    mark = SPACE.encode("utf-8")

    def decode(ids) -> str:
        data = b"".join(map(plain.__getitem__, ids)).replace(mark, b" ")
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    return decode


def share_model(spark: SparkSession, model_file: str) -> str:
    """Send the model to the executors; returns the name by which tasks find it."""
    spark.sparkContext.addFile(model_file)
    return model_file.rsplit("/", 1)[-1]


def text_blocks(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """Texts in blocks of about ``chars`` characters, whose words are encoded together."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Python's search for cycles is off inside: states and ids have none, and it would look at all of them again
    and again as they grow in number."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode(docs: DataFrame, model_file: str = MODEL_FILE, text_col: str = "text") -> Column:
    """Ids of the text column, as an array column for ``docs``."""
    name = share_model(docs.sparkSession, model_file)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = SharedPrefixEncoder(Vocabulary.load(SparkFiles.get(name)))
        for batch in batches:
            blocks = text_blocks(batch.fillna("").tolist())
            yield pd.Series(list(chain.from_iterable(map(encoder.encode_texts, blocks))), dtype=object)

    return encoded(F.col(text_col))


def decode(docs: DataFrame, model_file: str = MODEL_FILE, ids_col: str = "token_ids") -> Column:
    """Text of a column of ids, as a column for ``docs``."""
    name = share_model(docs.sparkSession, model_file)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = decoder(Vocabulary.load(SparkFiles.get(name)))
        for batch in batches:
            yield batch.map(lambda ids: of(ids) if ids is not None else "")

    return decoded(F.col(ids_col))


def encode_documents(
    docs: DataFrame,
    model_file: str = MODEL_FILE,
    text_col: str = "text",
    ids_col: str = "token_ids",
    round_trip_col: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids_col``; nothing is shuffled.

    The ids are those of the sentencepiece library for this model; :func:`decode` gives the text back,
    but for the sign U+2581, which stands for a blank.  With ``round_trip_col`` each text is decoded
    again in the same task, and the column says whether it came back as it was.

    Null and empty texts have no ids.  Words are cached in bounded tables, so memory does not grow with
    the vocabulary of the corpus.  Repeated rows are encoded alike; other columns are kept, and columns
    called ``ids_col`` or ``round_trip_col`` are replaced.  An empty table gives an empty result.
    """
    if round_trip_col is None:
        return docs.withColumn(ids_col, encode(docs, model_file, text_col))
    name = share_model(docs.sparkSession, model_file)

    @F.pandas_udf("ids array<int>, same boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary.load(SparkFiles.get(name))
        encoder, of = SharedPrefixEncoder(vocabulary), decoder(vocabulary)
        for batch in batches:
            texts = batch.fillna("").tolist()
            ids = list(chain.from_iterable(map(encoder.encode_texts, text_blocks(texts))))
            yield pd.DataFrame({"ids": ids, "same": [of(i.tolist()) == t for i, t in zip(ids, texts)]})

    (pair,) = fresh(docs.columns, "encoded")
    done = docs.withColumn(pair, both(F.col(text_col)))
    return done.withColumns({ids_col: F.col(f"{pair}.ids"), round_trip_col: F.col(f"{pair}.same")}).drop(pair)
