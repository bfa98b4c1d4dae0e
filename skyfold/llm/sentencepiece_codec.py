"""SentencePiece models run by the tokenizers library.

The model file, a protocol buffer, is parsed here: pieces with scores and kinds, model type, normaliser settings. From
these a tokenizer is rebuilt: the precompiled normalisation, the metaspace marker for spaces and the dummy prefix, the
unigram scores or, for a byte-pair model, the merges that the pieces' scores imply, and byte fallback. Batches are
encoded in slices of bounded text, by the task's own thread: Spark has a task for each core, and the library's threads, one for each
core in every task, wait for each other (decoding takes three times the CPU seconds). Every document's identifiers are verified against the
reference encoder; only where they differ the reference's identifiers stand in, and ``parity`` is false.

Models are given by path and read on the driver; workers get the bytes (a model is at most ``MAX_MODEL_BYTES``).

Defined cases: null and empty texts have no identifiers and decode to empty text (null stays null); white space that
the model's own normaliser changes, or its marker character in a text, makes ``round_trip`` false; rows are
independent, so repeated rows and extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from skyfold.llm.common import identified

MARKER = "▁"
MAX_MODEL_BYTES = 64_000_000
SLICE_CHARACTERS = 400_000
NO_IDS = np.zeros(0, np.int32)

# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class PieceModel(NamedTuple):
    pieces: list[Piece]
    kind: int
    byte_fallback: bool
    unknown: int
    character_map: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool


def parse_model(data: bytes) -> PieceModel:
    """Read what encoding needs of a model file; absent fields have the format's defaults."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append(Piece(piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    unknown = next((i for i, piece in enumerate(pieces) if piece.kind == UNKNOWN), 0)
    return PieceModel(
        pieces,
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        unknown,
        normaliser.get(2, b""),
        bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)),
        bool(normaliser.get(5, 1)),
    )


def build_tokenizer(model: PieceModel) -> Tokenizer:
    if model.kind == BPE:
        vocabulary = {piece.text: i for i, piece in enumerate(model.pieces)}
        core = models.BPE(
            vocabulary,
            _merges(model, vocabulary),
            unk_token=model.pieces[model.unknown].text,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p.text, p.score) for p in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} are neither unigram nor byte-pair models")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    # Where nothing else is normalised, the marker is put into whole texts by ``marked``, at a tenth of the cost.
    if steps and model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if steps and model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARKER, " ")]
    tokenizer.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    own = [AddedToken(piece.text, normalized=False) for piece in model.pieces if piece.kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def marked(model: PieceModel, text: str) -> str:
    """The text as the rebuilt tokenizer takes it: with marker, unless its own normaliser puts it in."""
    if model.character_map or model.remove_extra_spaces or not text:
        return text
    text = " " + text if model.dummy_prefix else text
    return text.replace(" ", MARKER) if model.escape_spaces else text


def marked(model: PieceModel, text: str) -> str:
    """The text as the rebuilt tokenizer takes it: with marker, unless its own normaliser puts it in."""
    if model.character_map or model.remove_extra_spaces or not text:
        return text
    text = " " + text if model.dummy_prefix else text
    return text.replace(" ", MARKER) if model.escape_spaces else text


class Codec:
    """The rebuilt tokenizer and the reference encoder of one model."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        model = parse_model(data)
        self.tokenizer = build_tokenizer(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.model = model._replace(pieces=[])

    def encode(self, texts: list[str]) -> list[list[int]]:
        encodings = self.tokenizer.encode_batch_fast([marked(self.model, text) for text in texts], add_special_tokens=False)
        return [encoding.ids for encoding in encodings]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def verified(self, texts: list[str]) -> tuple[list[list[int]], list[bool], np.ndarray]:
        """Identifiers, and whether the reference found the same ones; if not, its own stand in. Then those of all texts on end."""
        found = self.encode(texts)
        expected = self.reference.encode(texts, out_type="numpy", num_threads=1)
        sizes = [len(x) for x in found]
        joined = flat(found)
        if sizes == [len(x) for x in expected] and np.array_equal(joined, np.concatenate([*expected, NO_IDS])):
            return found, [True] * len(texts), joined
        same = [a == b.tolist() for a, b in zip(found, expected, strict=True)]
        ids = [a if equal else b.tolist() for a, b, equal in zip(found, expected, same, strict=True)]
        return ids, same, flat(ids)


def flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(map(len, ids)))


def encode_batch(data: bytes, texts: list[str | None]) -> tuple[list[list[int]], list[bool]]:
    """Identifiers of each text from the rebuilt tokenizer, and whether the reference found the same ones; if not, its
    own stand in."""
    results = [codec(data).verified(part) for part in _slices(texts)]
    return [x for ids, _, _ in results for x in ids], [x for _, parity, _ in results for x in parity]


def decode_batch(data: bytes, ids: list[list[int]]) -> list[str]:
    return codec(data).decode(ids)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, parity, round_trip``; ``round_trip`` tells whether decoding gives the text back."""
    data = _read(model_path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            texts = batch.column(1).to_pylist()
            for part in _slices(texts):
                ids, parity, joined = codec(data).verified(part)
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                whole = [a == b for a, b in zip(decode_batch(data, ids), part, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, joined),
                        pa.array(parity, pa.bool_()),
                        pa.array(whole, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "parity", "round_trip"],
                )
                start += len(part)

    schema = "doc_id bigint, n_tokens bigint, ids array<int>, parity boolean, round_trip boolean"
    return identified(docs, id_col, text_col).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from identifier lists; a null list gives null."""
    data = _read(model_path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = decode_batch(data, [x or [] for x in lists])
            result = [None if x is None else text for x, text in zip(lists, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(result, pa.string())], ["doc_id", "text"])

    rows = identified(encoded, id_col, ids_col).selectExpr("doc_id", "CAST(text AS array<int>) AS ids")
    return rows.mapInArrow(decoded, "doc_id bigint, text string")


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return data


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _merges(model: PieceModel, vocabulary: dict[str, int]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best piece first; pieces of one score in the order of the file."""
    normal = {piece.text for piece in model.pieces if piece.kind == NORMAL}
    merges = []
    for piece in model.pieces:
        if piece.kind == NORMAL:
            for cut in range(1, len(piece.text)):
                left, right = piece.text[:cut], piece.text[cut:]
                if left in normal and right in normal:
                    merges.append((-piece.score, vocabulary[piece.text], cut, left, right))
    return [(left, right) for *_, left, right in sorted(merges)]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of bounded length unless a single text is longer."""
    part: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > SLICE_CHARACTERS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
