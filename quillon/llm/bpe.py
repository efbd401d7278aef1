"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives each token's bytes and rank.  The library's BPE model works on characters,
so bytes are mapped to printable characters one to one, and each way to split a token into
two tokens becomes a merge of that token's rank.  Results equal those of applying the ranks
to each match of the pattern separately: a match that is a token is taken whole, else the
pair of least rank is merged, leftmost first.

White space decides where texts can be cut before matching: a single space between two
characters that aren't white space always begins a match.  So a text without runs of white
space at spaces is encoded space by space, and each distinct piece only once while it is in
a bounded memo.

Decoding joins the characters of the ids' tokens and reverses the byte table; a character whose
bytes several tokens share is whole again when the last of them has come.  Tokens cover a text's
bytes without gaps, so the ends of their bytes are their offsets.

Defined results: a null text is an empty text; an empty text has no tokens; any text, with
lone white space of any kind, control characters or very long runs, decodes to its bytes;
repeated rows are encoded again, each to the same; null ids stay null; columns of any name beside
id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, remembers

#: Distinct pieces kept by a worker; beyond it the memo is begun anew.
MEMO_PIECES = 300_000
#: Longer pieces aren't kept.
MEMO_CHARS = 64


def byte_characters() -> list[str]:
    """The usual printable stand-in of each byte: itself if printable, else from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in kept else spare))
        spare += b not in kept
    return out


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import models

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = dict(enumerate(byte_characters()))
        self.of_char = {ord(c): b for b, c in self.table.items()}
        self.back = np.zeros(max(self.of_char) + 1, np.uint8)
        self.back[list(self.of_char)] = list(self.of_char.values())
        self.vocab = {self.mapped(t): i for t, i in ranks.items()}
        self.chars_of = {i: c for c, i in self.vocab.items()}
        self.own = {i: i for i in self.chars_of}  # one int object per id, shared by the memo
        self.text_of = {i: str(i) for i in self.chars_of}
        self.lengths = np.zeros(max(self.own, default=0) + 1, np.int64)
        self.inside = np.zeros(len(self.lengths), bool)
        for t, i in ranks.items():
            self.lengths[i], self.inside[i] = len(t), 0x80 <= t[0] < 0xC0
        merges = [
            (self.mapped(t[:i]), self.mapped(t[i:]))
            for t in sorted(ranks, key=ranks.get)
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.model = models.BPE(self.vocab, merges, ignore_merges=True)
        self.matches = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.runs = re.compile(r" \s|\s ").search
        self.memo: dict[str, tuple[int, ...]] = {}

    def mapped(self, raw: bytes) -> str:
        """Bytes to characters of the model's alphabet."""
        return raw.decode("latin-1").translate(self.table)

    def unmapped(self, text: str) -> bytes:
        """The reverse of :meth:`mapped`."""
        return self.back[np.frombuffer(text.encode("utf-16-le"), np.uint16)].tobytes() if text else b""

    def _piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for match in self.findall(piece):
            m = self.mapped(match.encode())
            whole = self.vocab.get(m)
            out += [t.id for t in self.model.tokenize(m)] if whole is None else [whole]
        return tuple(map(self.own.__getitem__, out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or self.runs(text):
            head, rest = None, self.findall(text)
        else:
            head, *rest = text.split(" ")
            rest = [f" {w}" for w in rest]
            rest.insert(0, head)
        memo = self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, rest)))
        except KeyError:
            pass
        out: list[int] = []
        for piece in rest:
            ids = memo.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def encode_with_offsets(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(id, begin, end)`` of each token, in bytes of the text's UTF-8."""
        out, at = [], 0
        for match in self.matches(text or ""):
            m = self.mapped(match[0].encode())
            whole = self.vocab.get(m)
            # a mapped character is a byte of the text, so the lengths of the tokens' texts are byte lengths
            tokens = [(whole, m)] if whole is not None else [(t.id, t.value) for t in self.model.tokenize(m)]
            for i, value in tokens:
                out.append((i, at, at + len(value)))
                at += len(value)
        return out

    def ends(self, ids: list[int]) -> tuple[np.ndarray, int]:
        """Where each token's bytes end in the text's UTF-8, and how many tokens begin inside a character."""
        at = np.fromiter(ids, np.int64, len(ids))
        return np.cumsum(self.lengths[at]), int(self.inside[at].sum())

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids: their tokens' characters, through the byte table reversed."""
        return self.unmapped("".join(map(self.chars_of.__getitem__, ids)))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text id by id; a character split between tokens comes out with its last byte."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.unmapped(self.chars_of[i]))
        yield decoder.decode(b"", final=True)


_codecs: dict[tuple[str, str], ByteBPE] = {}


def forget() -> None:
    """Lets go of the pieces that the worker's encoders remember."""
    for bpe in _codecs.values():
        bpe.memo = {}


remembers("bpe", forget)


def codec(ranks_path: str, pattern: str) -> ByteBPE:
    """The worker's encoder of that file, built once."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = ByteBPE(*key)
    return _codecs[key]


#: Texts turned into rows at a time: what a worker holds stays small whatever an Arrow batch has.
CHUNK_BYTES = 4 << 20


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of ``column``, of a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>, ends array<int>, decodes boolean)`` of each row of ``docs``; map only.

    ``ends`` tells where each token's bytes end in the text's UTF-8, ``decodes`` whether the ids
    decode to the text's bytes.
    """

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [bpe.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([bpe.ends(i)[0].astype(np.int32) for i in ids], pa.list_(pa.int32())),
                        pa.array([bpe.decode_bytes(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ends", "decodes"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lean("bpe", run), "doc_id long, n_tokens long, ids array<int>, ends array<int>, decodes boolean")


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest row of each text: what the library encodes and decodes, without carrying the ids on.

    ``ends_sha256`` is the digest of the token ends, eight bytes each, least first; ``n_split``
    counts the tokens that begin inside a character.
    """

    def run(batches):
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                n, ids_sha, raw_sha, ends_sha, split = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                    ends, inside = bpe.ends(ids)
                    ends_sha.append(hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest())
                    split.append(inside)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string()), pa.array(ends_sha, pa.string()), pa.array(split, pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256", "n_split"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lean("bpe", run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string, n_split long")
