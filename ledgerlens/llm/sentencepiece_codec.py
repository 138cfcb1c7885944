"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is read field by field and rebuilt: normaliser (character map, extra spaces, dummy prefix), metaspace
marker, scores, byte fallback.  Unigram models keep their scores; BPE models turn them into the order of merges.

No piece crosses from text into a marker (checked when the model is loaded), so a text falls apart before each run of
markers and every part is encoded once per worker; new parts of a slice of texts are encoded in batches, on the one core of a task.
Parity is verified on every new part, against the SentencePiece library itself, and decoding against the normalised text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import Recent, kept, slices, texts_of

MARKER = "▁"
#: Parts of texts a worker remembers, twice.
REMEMBERED = 150_000
#: Parts encoded in one batch.
AT_ONCE = 2_000
ENCODED = "doc_id long, n_pieces long, ids array<int>, n_unknown long, round_trip boolean, parity boolean"
#: Field numbers and piece kinds of the model format (fixed values).
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def read_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 24:
                    spec.suffix = bool(v)
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.remove_extra = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


def normaliser(spec: Spec) -> normalizers.Normalizer | None:
    """Everything before the pieces are chosen but the dummy prefix, which only the start of a text gets."""
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    return normalizers.Sequence(steps) if steps else None


def backend(spec: Spec) -> Tokenizer:
    """The tokenizers model: scores for unigram, merges in order of score for BPE."""
    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), 0)
    if spec.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback))
    vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    usable = {p: (s, i) for i, (p, s, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED)}
    merges = [
        (-score, i, p[:k], p[k:]) for p, (score, i) in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable
    ]
    merges.sort(key=lambda m: (m[0], m[1], vocabulary[m[2]], vocabulary[m[3]]))
    # the model's own cache would never be hit: every part is encoded once
    return Tokenizer(models.BPE(
        vocab=vocabulary, merges=[(a, b) for _, _, a, b in merges], unk_token=spec.pieces[unknown][0], fuse_unk=True,
        byte_fallback=spec.byte_fallback, cache_capacity=0,
    ))


class Codec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, "rb") as f:
            data = f.read()
        self.spec = spec = read_model(data)
        if spec.suffix or spec.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the marker in front are supported")
        self.tokenizer = backend(spec)
        self.normaliser = normaliser(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.unknown = self.library.unk_id()
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED))
        self.part = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+") if not crossing else re.compile(r"(?s).+")
        self.known: dict[str, bytes] = Recent(remembered)  # ids as 32-bit integers
        self.differing: set[str] = set()  # parts whose ids are not the library's
        self.lossy: set[str] = set()  # parts whose ids do not spell them
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(spec.pieces) if kind == BYTE}
        self.silent = {i for i, (_, _, kind) in enumerate(spec.pieces) if kind in (CONTROL, UNKNOWN)}

    def normalised(self, text: str) -> str:
        """The text the pieces spell, markers for spaces."""
        if self.normaliser is not None and (self.spec.charsmap or self.spec.remove_extra):
            text = self.normaliser.normalize_str(text)
        elif self.spec.escape:
            text = text.replace(" ", MARKER)
        return MARKER + text if self.spec.dummy_prefix and text else text

    def learn(self, parts: list[str]) -> None:
        """Encodes new parts and compares each with the library, ``AT_ONCE`` at a time: their encodings take memory."""
        for k in range(0, len(parts), AT_ONCE):
            self._learn(parts[k : k + AT_ONCE])

    def _learn(self, parts: list[str]) -> None:
        names = self.names.__getitem__
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        for part, ids in zip(parts, found):
            self.known[part] = array("i", ids).tobytes()
            if "".join(map(names, ids)) != part and self._spell(ids) != part:
                self.lossy.add(part)
        # the library adds the dummy prefix itself; a lone marker is not a text it can be given
        prefix = self.spec.dummy_prefix
        asked = [(p, x) for p, x in zip(parts, found) if p != MARKER and (p[0] == MARKER or not prefix)]
        told = self.library.encode([p[prefix:].replace(MARKER, " ") for p, _ in asked], num_threads=1)
        self.differing.update(p for (p, x), ids in zip(asked, told) if x != ids)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of texts, whether they spell the normalised text, and whether they are the library's.

        Both are known of each part, and a text is its parts: pieces and characters stay inside one.
        """
        normal = [self.normalised(t) for t in texts]
        parts = [self.part.findall(t) for t in normal]
        seen = set().union(*parts)
        self.learn(self.known.missing(seen))
        at = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(at, p)), np.int32) for p in parts]
        whole = lambda odd: [not odd or odd.isdisjoint(p) for p in parts]
        return ids, whole(self.lossy), whole(self.differing)

    def _spell(self, ids: list[int]) -> str:
        """Normalised text that ids spell; unknown pieces and controls spell nothing."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join(map(self.names.__getitem__, ids))
        out = bytearray()
        for i in ids:
            out += bytes((self.bytes[i],)) if i in self.bytes else self.names[i].encode()
        return out.decode(errors="replace")

    @property
    def names(self) -> list[str]:
        if not hasattr(self, "_names"):
            self._names = ["" if i in self.silent else p for i, (p, _, _) in enumerate(self.spec.pieces)]
        return self._names

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, the dummy prefix goes."""
        text = self._spell(list(ids)).replace(MARKER, " ")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_pieces``, ``ids``, ``n_unknown``, ``round_trip`` (decoding gives the normalised text back),
    ``parity`` (the SentencePiece library gives the same ids).

    Null and empty texts have no pieces.  Repeated rows give repeated answers.  ``model`` is a path found on all machines.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each thread would keep memory of its own
        codec = kept(("sentencepiece", model), lambda: Codec(model))
        for batch in slices(batches):
            ids, good, parity = codec.encode(texts_of(batch))
            unknown = [int((x == codec.unknown).sum()) for x in ids]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(unknown, pa.int64()), pa.array(good), pa.array(parity),
                ],
                names=["doc_id", "n_pieces", "ids", "n_unknown", "round_trip", "parity"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text`` of rows with ids; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("sentencepiece", model), lambda: Codec(model))
        for batch in slices(batches, 1024):
            texts = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(decode, "doc_id long, text string")
