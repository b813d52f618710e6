"""Token ids of whole texts, as bytes.

The tokenizer never joins what lies on both sides of a blank or a line feed, so the ids of a text are those of
its pieces between them, one after another. Pieces repeat; the ids of up to
``CACHE_PIECES`` are kept in each Python worker, and only new pieces go through the tokenizer.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 400_000
_NEW_AT_ONCE = 500
_workers: dict[str, PieceTokenizer] = {}


def _byte_chars() -> list[str]:
    """The character by which byte-level models stand for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class PieceTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.marks = {"": b""}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words go to the model right away where the parts before it do the same to all of them.
        self.byte_chars = _byte_chars()
        self.direct = self._lower_cases() and all(self._word(w) == self._encoded([w])[0] for w in ("word", "é", "ñandú"))

    @staticmethod
    def of(path: str) -> PieceTokenizer:
        """The worker's own, kept from task to task."""
        if path not in _workers:
            _workers[path] = PieceTokenizer(path)
        return _workers[path]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _lower_cases(self) -> bool:
        """Whether case is of no matter, and signs beside a word are split from it."""
        a, b, c, d, e = self._encoded(["Word", "word", "word.,!", ".,!", ".,!word"])
        return a == b and c == b + d and e == d + b

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._encoded([mark])[0]
        return self.marks[mark]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters, as the model sees it: a character for each byte."""
        seen = word if word.isascii() else "".join([self.byte_chars[x] for x in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _lower(self, text: str) -> str:
        """A-Z lower-cased, unless that makes a special token."""
        lower = text.encode().lower().decode()
        return text if any(x in lower for x in self.special) else lower

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        new, rest = {}, []
        for piece in pieces:
            right = piece.rstrip(punctuation)
            word = right.lstrip(punctuation)
            before, after = right[: len(right) - len(word)], piece[len(right) :]
            # Latin letters up to U+024F, lower-case and composed.
            if (
                self.direct and word.isalpha() and word.islower() and "'" not in before
                and (word.isascii() or (max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)))
                and not (before and any(x in piece for x in self.special))
            ):
                new[piece] = self._mark(before) + self._word(word) + self._mark(after)
            else:
                rest.append(piece)
        for at in range(0, len(rest), _NEW_AT_ONCE):
            part = rest[at : at + _NEW_AT_ONCE]
            new.update(zip(part, self._encoded(part), strict=True))
        return new

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian and 32 bits each."""
        if self.direct:
            texts = [self._lower(t) for t in texts]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        missing = list({p for pieces in split for p in pieces if p not in known})
        new = self._learn(missing)
        if len(known) + len(new) <= CACHE_PIECES:
            known.update(new)
            return [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        room = CACHE_PIECES - len(known)
        for piece in missing[: max(0, room)]:
            known[piece] = new[piece]
        return [b"".join([known[p] if p in known else new[p] for p in pieces]) for pieces in split]


def pack_ids(ids: bytes, packer: zstandard.ZstdCompressor) -> bytes:
    """Compressed, low and high bytes apart."""
    return packer.compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ids(packed: bytes, opener: zstandard.ZstdDecompressor) -> np.ndarray:
    """Ids as ``<u4``."""
    return np.ascontiguousarray(np.frombuffer(opener.decompress(packed), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _text_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from lacuna.llm.words import small_batches

    return small_batches(batches, most=most)


def tokenised(docs: DataFrame, path: str, end_id: int, describe=None, extra: str = "") -> DataFrame:
    """(row_no, doc_id, n_tokens, packed) of each row; ``end_id`` follows each text, null counts as empty.

    ``describe`` may add columns: it gets the ids of the texts of a batch and returns Arrow arrays of the
    columns named in ``extra``. row_no is the place of the row in this table's reading; keep the table before using it as a key.
    """
    names = ["row_no", "doc_id", "n_tokens", "packed", *[x.split()[0] for x in extra.split(",") if x]]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = PieceTokenizer.of(path), zstandard.ZstdCompressor(level=1)
        for batch in _text_batches(batches, 1 << 20):
            ids = [x + end for x in tokenizer.ids([t or "" for t in batch.column("text").to_pylist()])]
            arrays = [
                batch.column("row_no"), batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([pack_ids(x, packer) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays + (describe(ids) if describe else []), names=names)

    schema = "row_no long, doc_id long, n_tokens long, packed binary" + (f", {extra}" if extra else "")
    numbered = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    return numbered.mapInArrow(run, schema)
