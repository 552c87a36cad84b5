"""Reads the parts of a SentencePiece model file that encoding and decoding need."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Piece types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the file format (fixed values).
UNIGRAM, BPE = 1, 2
#: What stands for a space inside pieces.
SPACE = "▁"


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; ints, floats and bytes as they come."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0]
            at += size


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                out.pieces.append(got.get(1, b"").decode())
                out.scores.append(got.get(2, 0.0))
                out.types.append(got.get(3, NORMAL))
            elif number == 2:
                out.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                out.charsmap = got.get(2, b"")
                out.add_dummy_prefix = bool(got.get(3, 1))
                out.remove_extra_whitespaces = bool(got.get(4, 1))
                out.escape_whitespaces = bool(got.get(5, 1))
        return out
