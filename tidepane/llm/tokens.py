"""Token ids of whole texts by a bounded-lookahead streaming encoder, and back.

Every text is fed in blocks, whatever its length. Tokens are emitted as soon as no
later character can change them, so what is held back does not grow with the text:

* no piece of the pre-tokenizer goes from a character that is not white space to
  one that is, so all before the last such place is final;
* in what is left, pieces are final a few characters before the end of what has
  been read (:data:`PIECE_LOOKAHEAD`), because the pattern looks at most that far
  past a piece;
* within a piece, tokens are final once :attr:`Vocabulary.lookahead` bytes follow
  them, a bound computed from the merge list by :func:`sufficient_lookahead`.

Decoding feeds the bytes of the ids to an incremental byte-to-text machine.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: The public pre-tokenizer pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece that ends this many characters before the end of the text read so far is final:
#: the longest literal alternative has 3 characters, and white space looks one character ahead.
PIECE_LOOKAHEAD = 3
#: Characters fed at a time.
BLOCK = 1 << 11


def tokenizer_file(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    """Path of a vocabulary's rank file."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        spec = importlib.util.find_spec("public_tokenizers")
        if spec and spec.submodule_search_locations:
            path = os.path.join(next(iter(spec.submodule_search_locations)), f"{name}.tiktoken")
    return path


def merge_rules(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list in order of rank: each longer token with the two tokens it is made of.

    The two parts are what the token's bytes merge to when only lower ranks may
    merge.
    """
    rules = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < rank and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            rules.append((parts[0], parts[1]))
    return rules


def sufficient_lookahead(rules: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that decide whether it stands, from the merge list alone.

    Whether rule (a, b) applies at a place depends on what lies right of it only
    through rules of lower rank: one that takes b away as its left part and so
    needs its own right part and whatever decides that rule, and those that form
    b or form or take a. Going through the list in order of rank gives each rule
    the largest number of bytes past its product that can matter. A finished
    token could further be the left part of a later merge, whose product ends at
    most the longest token further on.
    """
    taken_left: dict[bytes, int] = {}  # token -> reach past it of rules that take it as left part
    taken_right: dict[bytes, int] = {}  # token -> reach past it of rules that take it as right part
    formed: dict[bytes, int] = {}
    most, longest = 0, 1
    for a, b in rules:
        reach = max(0, taken_left.get(b, 0), formed.get(b, 0), taken_right.get(a, 0) - len(b), formed.get(a, 0) - len(b))
        formed[a + b] = max(formed.get(a + b, 0), reach)
        taken_left[a] = max(taken_left.get(a, 0), len(b) + reach)
        taken_right[b] = max(taken_right.get(b, 0), reach)
        most, longest = max(most, reach), max(longest, len(a) + len(b))
    return most + longest


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary with the bounds the streaming encoder needs."""

    def __init__(self, name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
        import tiktoken

        with open(tokenizer_file(name, folder), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self._encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        #: Ids of a run of complete pieces, and of one piece.
        self.whole = self._encoding.encode_ordinary
        self.piece = self._encoding._core_bpe.encode_single_piece
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = sufficient_lookahead(merge_rules(self.ranks))
        return self._lookahead


@lru_cache(maxsize=4)
def vocabulary(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(name, folder)


_LETTER, _DIGIT, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\p{White_Space}")
_KINDS = {"letter": regex.compile(r"\p{L}*"), "digit": regex.compile(r"\p{N}*"), "space": regex.compile(r"\p{White_Space}*"), "other": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}
#: White space by its Unicode property, as the encoder's own pattern engine reads it.
_PIECES = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


#: The last white space that follows another character; found from the end.
_BREAK = regex.compile(r"(?r)(?<=\P{White_Space})\p{White_Space}")


def _kind(piece: str) -> str:
    """Class of characters that would continue a piece."""
    last = piece[-1]
    return "letter" if _LETTER.match(last) else "digit" if _DIGIT.match(last) else "space" if _SPACE.match(last) else "other"


class StreamEncoder:
    """``feed`` takes the next characters and returns the ids that have become final; ``finish`` returns the rest."""

    def __init__(self, vocab: Vocabulary, lookahead: int | None = None):
        self.vocab, self.lookahead = vocab, vocab.lookahead if lookahead is None else lookahead
        self.text = ""  # characters of pieces that are not final
        self.kind = ""  # class of the piece whose start has been emitted, if any
        self.tail = b""  # its bytes that are not final

    def _stable(self) -> list[int]:
        """Ids of the start of ``tail`` that stand whatever follows; they leave it."""
        end = len(self.tail) - self.lookahead
        if end <= 0:
            return []
        ids, out, at = self.vocab.piece(self.tail), [], 0
        for i in ids:
            n = len(self.vocab.bytes_of[i])
            if at + n > end:
                break
            out.append(i)
            at += n
        self.tail = self.tail[at:]
        return out

    def _open_piece(self, last: bool) -> list[int]:
        """Move what continues the open piece from ``text`` to ``tail`` and emit what is final."""
        run = _KINDS[self.kind].match(self.text).end()
        more = run == len(self.text) and not last
        # The last white space before other text starts the next piece; there is always one in ``text``.
        held = 1 if self.kind == "space" and not (last and run == len(self.text)) else 0
        self.tail += self.text[: run - held].encode("utf-8")
        self.text = self.text[run - held :]
        if more:
            return self._stable()
        out, self.tail, self.kind = self.vocab.piece(self.tail) if self.tail else [], b"", ""
        return list(out)

    def _cut(self, at: int) -> list[int]:
        """Ids of the first ``at`` characters, which are complete pieces."""
        out = self.vocab.whole(self.text[:at])
        self.text = self.text[at:]
        return out

    def feed(self, chunk: str, last: bool = False) -> list[int]:
        self.text += chunk
        out: list[int] = []
        if self.kind:
            out += self._open_piece(last)
            if self.kind:
                return out
        if last:
            return out + self._cut(len(self.text))
        found = _BREAK.search(self.text)
        if found:
            out += self._cut(found.start())
        if len(self.text) > self.lookahead:
            out += self._unbroken()
        return out

    def _unbroken(self) -> list[int]:
        """Ids that are final in a text without a break: its complete pieces, and the start of the one that is open."""
        limit, cut = len(self.text) - PIECE_LOOKAHEAD, 0
        for m in _PIECES.finditer(self.text):
            if m.end() > limit:
                break
            if not _SPACE.match(self.text[m.end() - 1]):
                cut = m.end()  # never between two white-space pieces: cut off, they would be one
        out = self._cut(cut) if cut else []
        if len(self.text) > self.lookahead:
            piece = _PIECES.match(self.text).group()
            if len(piece) + PIECE_LOOKAHEAD >= len(self.text):
                self.kind = _kind(piece)
                take = len(piece) - 1
                self.tail, self.text = self.text[:take].encode("utf-8"), self.text[take:]
                out += self._open_piece(False)
        return out

    def finish(self) -> list[int]:
        return self.feed("", last=True)


def encoded_blocks(text: str | None, vocab: Vocabulary, block: int = BLOCK, lookahead: int | None = None) -> Iterator[list[int]]:
    """Ids of a text, a list for each block it is fed in and one for the rest; none for an empty and for a null text."""
    if not text:
        return
    encoder = StreamEncoder(vocab, lookahead)
    for at in range(0, len(text), block):
        yield encoder.feed(text[at : at + block])
    yield encoder.finish()


def encode_text(text: str | None, vocab: Vocabulary, block: int = BLOCK, lookahead: int | None = None) -> array:
    """Ids of a text; empty for an empty and for a null text."""
    out = array("i")
    for ids in encoded_blocks(text, vocab, block, lookahead):
        out.extend(ids)
    return out


def count_tokens(text: str | None, vocab: Vocabulary, block: int = BLOCK) -> int:
    """Number of ids of a text; no more than those of a block are held."""
    return sum(map(len, encoded_blocks(text, vocab, block)))


class StreamDecoder:
    """Incremental UTF-8: bytes in, text out as soon as a character is complete; broken bytes become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        import codecs

        self.vocab, self.machine = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.vocab.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode_ids(ids: Iterable[int] | None, vocab: Vocabulary, block: int = BLOCK) -> str:
    """Text of the ids; ``''`` for none."""
    decoder, out = StreamDecoder(vocab), []
    ids = list(ids) if ids is not None else []
    for at in range(0, len(ids), block):
        out.append(decoder.feed(ids[at : at + block]))
    return "".join(out) + decoder.finish()


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row per document: ``key`` and ``ids`` array<int>, without special tokens.

    Strings of special tokens in a text are ordinary text. Repeated keys keep
    their rows; a null key stays null. Texts go to the workers in Arrow batches,
    nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, folder)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(1):
                for found in encoded_blocks(text.as_py(), vocab):
                    ids.extend(found)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, text: str = "text", out: str = "n_tokens", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``documents`` without its text, with the number of tokens of each (0 for empty and null texts)."""
    others = [c for c in documents.columns if c not in (text, out)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, folder)
        for batch in batches:
            sizes = [count_tokens(t.as_py(), vocab) for t in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(sizes, pa.int64())], names=[*others, out])

    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{out}` bigint"])
    return documents.select(*others, text).mapInArrow(count, schema)


def decoded_texts(ids: DataFrame, key: str = "doc_id", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Text of each row of ids: ``key`` and ``text``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name, folder)
        for batch in batches:
            texts = [decode_ids(i, vocab) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(ids.dtypes)[key]
    return ids.select(key, F.col("ids")).mapInArrow(decode, f"`{key}` {kind}, text string")
