"""Byte-level BPE with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a byte-level BPE model: every byte stands for a printable character, and every way to
put a token together from two tokens is a merge, in the order of the token's rank. Texts are cut by the split pattern, each
distinct piece is encoded once per worker by the library (a bounded memory of pieces), and ids and character offsets of whole
texts are gathered from the pieces with numpy. Decoding maps ids to token strings, these back to bytes by the reversed table,
and bytes to text; a character whose bytes lie in several tokens comes back whole, and bytes that are no character become
U+FFFD.

Nulls count as empty texts, which have no tokens and keep their row. Special tokens do not exist: their strings are ordinary
text. Null id lists decode as empty. Rows that repeat are encoded each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import whole_text


def byte_characters() -> dict[int, str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans ``[start, start + length)`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Codec:
    """Encoder and decoder of one vocabulary; built once per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, offsets: bool = False, most_pieces: int = 500_000):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = ranks
        to_char = byte_characters()
        as_text = lambda token: "".join(map(to_char.__getitem__, token))
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(as_text(a), as_text(b)) for a, b in sorted(cuts, key=lambda cut: (ranks[cut[0]], ranks[cut[1]]))]
        vocabulary = {as_text(token): rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.split, self.offsets, self.most_pieces = regex.compile(pattern), offsets, most_pieces
        to_byte = {c: b for b, c in to_char.items()}
        strings = dict((rank, text) for text, rank in vocabulary.items())
        octets = [bytes(map(to_byte.__getitem__, strings.get(i, ""))) for i in range(max(strings, default=-1) + 1)]
        self.decimals = list(map(str, range(len(octets))))
        self.token_lengths = np.array([len(x) for x in octets], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(octets), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros((3 if self.offsets else 1, 0), np.int32)  # ids, first and end character within the piece

    def _learn(self, pieces: list[str]) -> None:
        encode = self.library.encode_batch if self.offsets else self.library.encode_batch_fast
        encoded = encode(pieces, add_special_tokens=False)
        ids = [e.ids for e in encoded]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        rows = [np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))]
        if self.offsets:
            rows += list(np.array([o for e in encoded for o in e.offsets], np.int32).reshape(-1, 2).T)
        self.starts = np.append(self.starts, self.flat.shape[1] + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.concatenate([self.flat, np.vstack(rows)], axis=1)
        self.places.update(zip(pieces, range(len(self.places), len(self.places) + len(pieces)), strict=True))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Place of every piece of all texts, the number of pieces of each text, and the pieces."""
        cut = list(map(self.split.findall, texts))
        if len(self.places) > self.most_pieces:
            self._forget()
        if fresh := list(set().union(*cut) - self.places.keys()):
            self._learn(fresh)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        return places, counts, cut

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of all texts, bounds of each text in them, and first and end character of each token if the codec has offsets."""
        places, counts, cut = self.pieces(texts)
        lengths = self.lengths[places]
        index = gathered(self.starts[places], lengths)
        piece_bounds = np.append(0, np.cumsum(counts))
        bounds = np.append(0, np.cumsum(lengths))[piece_bounds]
        spans = None
        if self.offsets:
            sizes = np.fromiter((len(p) for pieces in cut for p in pieces), np.int64, len(places))
            before = np.append(0, np.cumsum(sizes))
            before = before[:-1] - np.repeat(before[piece_bounds[:-1]], counts)
            spans = self.flat[1:, index] + np.repeat(before, lengths).astype(np.int32)
        return self.flat[0, index], bounds, spans

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The ids of each text as decimals joined by commas."""
        named = list(map(self.decimals.__getitem__, ids.tolist()))
        return [",".join(named[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        lengths = self.token_lengths[ids]
        octets = self.token_bytes[gathered(self.token_starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[bounds].tolist()
        return [octets[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, pattern: str, offsets: bool = False) -> Codec:
    """The worker's codec for these ranks: kept between tasks, replaced when other ranks come."""
    key = (pattern, offsets)
    if key not in _CODECS or _CODECS[key].ranks != shared.value:
        _CODECS[key] = Codec(shared.value, pattern, offsets)
    return _CODECS[key]


def _groups(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, starts, ends`` (arrays of int; offsets count characters, end exclusive) of every row's text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(id_col, whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, True)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                ids, bounds, spans = codec.encode(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (ids, *spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["id", "ids", "starts", "ends"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from ``id, ids``."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(id_col, F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            texts = [octets.decode("utf-8", "replace") for octets in codec.decode(ids, bounds - bounds[0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return digests of both per row, without shipping token lists between processes."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = df.select(id_col, whole_text(text_col).alias("text"))
    sha = lambda octets: hashlib.sha256(octets).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                ids, bounds, _ = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array([sha(d.encode()) for d in codec.joined(ids, bounds)]),
                    pa.array([sha(octets) for octets in codec.decode(ids, bounds)])],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)
