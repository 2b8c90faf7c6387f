"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library."""

from __future__ import annotations

import heapq
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

SPACE = "▁"


class PieceCoder:
    """Encodes by an agenda of adjacent symbol pairs, best score first, and decodes.

    A text becomes a line of characters behind one space mark. The agenda holds each pair of neighbours whose join is a
    piece; the best-scored pair (the leftmost of equals) is joined, its new neighbours enter the agenda, and pairs that a join
    has made stale are passed over when they surface. Characters without a piece become their bytes.

    Pieces of this vocabulary kind never hold a space mark behind another character, nor a line feed beside another: no join
    crosses these places, so the text is encoded word by word, and each word's ids are remembered. Where a vocabulary has
    such pieces the whole text is one word. Each newly met word is checked against the library; a difference raises.
    """

    #: How many bytes the remembered words may take, by a rough count.
    most = 128_000_000

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.bytes_ = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            elif sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        if not all(self.bytes_):
            raise ValueError("a vocabulary with byte pieces is needed")
        if [sp.id_to_piece(i) for i in sp.encode("x", add_bos=False, add_eos=False)][0][0] != SPACE or sp.encode("  ") != sp.encode(SPACE * 2):
            raise ValueError("a vocabulary that marks and keeps white space is needed")
        joined = [p for p in self.ids if len(p) > 1]
        self.by_word = not any(re.search(rf"[^{SPACE}]{SPACE}", p) or "\n" in p for p in joined)
        self.marked: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        self.new: list[tuple[str, bool]] = []
        self.held = 0

    def merge(self, text: str) -> tuple[int, ...]:
        """The ids of a text in which space marks stand for spaces."""
        symbols, scores = list(text), self.scores
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, i + 1, p) for i in range(n - 1) if (s := scores.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue
            symbols[left], symbols[right] = piece, None
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (s := scores.get(p := piece + symbols[follow])) is not None:
                    heapq.heappush(agenda, (-s, left, follow, p))
            lead = before[left]
            if lead >= 0 and (s := scores.get(p := symbols[lead] + piece)) is not None:
                heapq.heappush(agenda, (-s, lead, left, p))
        out: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                i = self.ids.get(symbol)
                if i is None:
                    out += [self.bytes_[b] for b in symbol.encode()]
                else:
                    out.append(i)
        return tuple(out)

    def _word(self, word: str, marked: bool) -> tuple[int, ...]:
        """The ids of a word, with or without a space mark before it."""
        memo = self.marked if marked else self.bare
        ids = memo[word] = self.merge((SPACE if marked else "") + word.replace(" ", SPACE))
        self.new.append((word, marked))
        self.held += 200 + 4 * len(word) + 8 * len(ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.held > self.most:
            self.check()
            self.marked.clear()
            self.bare.clear()
            self.held = 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.by_word:
            return list(self.merge(SPACE + text.replace(" ", SPACE)))
        get, word = self.marked.get, self._word
        feed = self.bytes_[10] if "\n" not in self.ids else self.ids["\n"]
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            # Words that a single space leads are keyed without it; runs of spaces belong to the word behind them.
            words = line.split(" ") if "  " not in line else re.split(r"(?<! ) ", line)
            if k:
                out.append(feed)
                if words[0]:
                    out += self.bare.get(words[0]) or word(words[0], False)
                del words[0]
            elif line[0:1] == " ":
                words[:2] = [" " + words[1]]
            for w in words:
                out += get(w) or word(w, True)
        return out

    def check(self) -> None:
        """Holds the words met since the last check against the library."""
        new, self.new = self.new, []
        feed = self.library.encode("\n")
        # The library marks what starts a text; behind a line feed it marks nothing.
        asked = [w if marked and w else "\n" + (" " if marked else "") + w for w, marked in new]
        for (w, marked), text, theirs in zip(new, asked, self.library.encode(asked, num_threads=1), strict=True):
            mine = (self.marked if marked else self.bare)[w]
            if tuple(theirs if text is w else theirs[len(feed) :]) != mine:
                raise ValueError(f"{text!r} is encoded unlike the library does: {mine}, {theirs}")

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: pieces with marks as spaces, runs of byte pieces as UTF-8, less the first mark."""
        if not ids:
            return ""
        table = self.surface
        raw = b"".join([table[i] for i in ids])
        return raw.decode("utf-8", "replace")[raw[:1] == b" " :]


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``, one row per input row: ids as the library gives them without begin and end, and their text.

    ``model`` is the content of a model file, of bounded size, sent to each task. Null and empty texts have no ids and decode
    to an empty text. Null ids, repeated rows and empty tables pass through; other columns are not read. A batch of rows is
    one Arrow batch; its new words are checked against the library before the batch is returned. There is no shuffle.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: list[PieceCoder] = []

    def run(batch):
        if not state:
            state.append(PieceCoder(sent.value))
        coder = state[0]
        ids = [coder.encode(t) for t in batch["text"].to_pylist()]
        coder.check()
        import numpy as np
        import pyarrow as pa

        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
        return {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(ends, flat), "decoded": [coder.decode(i) for i in ids]}

    return batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def read_model(path: str | None = None) -> bytes:
    """The bytes of a model file; by default the public 32,000-piece model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()
