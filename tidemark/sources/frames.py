"""Zstandard frames of records, and their boundaries in a run of bytes."""

from __future__ import annotations

import io
import struct

import zstandard

# Fixed values of the Zstandard format.
MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)

_HEAD = struct.Struct("<qiqii")
NO_LABEL = 1 << 40


class BrokenData(ValueError):
    """Bytes that are not what their index or format says."""


def _frames(handle, size: int):
    """End of each complete frame of a seekable file of ``size`` bytes, by the frames' own headers; only these are read."""

    def read(at: int, n: int) -> bytes:
        handle.seek(at)
        return handle.read(n)

    at = 0
    while at < size:
        if size - at < 8:
            raise BrokenData(f"{size - at} stray bytes at {at}")
        head = read(at, 18)
        magic = int.from_bytes(head[:4], "little")
        if magic in SKIPPABLE:
            at += 8 + int.from_bytes(head[4:8], "little")
        elif magic == MAGIC:
            try:
                checked = zstandard.get_frame_parameters(head).has_checksum
                at += zstandard.frame_header_size(head)
            except zstandard.ZstdError as e:
                raise BrokenData(f"frame header at {at}: {e}") from e
            last = False
            while not last:
                if size - at < 3:
                    raise BrokenData(f"frame cut off at {at}")
                block = int.from_bytes(read(at, 3), "little")
                last, kind, length = bool(block & 1), block >> 1 & 3, block >> 3
                if kind == 3:
                    raise BrokenData(f"block of unknown kind at {at}")
                at += 3 + (1 if kind == 1 else length)
            at += 4 * checked
        else:
            raise BrokenData(f"no frame begins at {at}")
        if at > size:
            raise BrokenData(f"frame cut off at {size}")
        yield at


def frame_ends(data: bytes) -> list[int]:
    """End of each complete frame in ``data``; raises :class:`BrokenData` if the bytes are not a whole number of frames."""
    return list(_frames(io.BytesIO(data), len(data)))


def check_frames(handle, size: int) -> None:
    """Raises :class:`BrokenData` unless a seekable file of ``size`` bytes is a whole number of frames; nothing is held or decompressed."""
    for _ in _frames(handle, size):
        pass


def pack_record(file_id: int, rec_no: int, label: int | None, key: str | None, data: bytes | None) -> bytes:
    k = None if key is None else key.encode()
    return _HEAD.pack(file_id, rec_no, NO_LABEL if label is None else label, -1 if k is None else len(k), -1 if data is None else len(data)) + (k or b"") + (data or b"")


def unpack_records(raw: bytes) -> list[tuple[int, int, int | None, str | None, bytes | None]]:
    out, at = [], 0
    while at < len(raw):
        file_id, rec_no, label, k, d = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        key = None if k < 0 else raw[at : at + k].decode()
        at += max(k, 0)
        data = None if d < 0 else raw[at : at + d]
        at += max(d, 0)
        out.append((file_id, rec_no, None if label == NO_LABEL else label, key, data))
    if at != len(raw):
        raise BrokenData("records run past their frame")
    return out
