"""Reading ZIP archives by ranges: central directory, ZIP64 directory, places of stored members."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

# Fixed values of the ZIP format: signatures, and sizes of the fixed parts.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
COMMENT = 65_535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_FIELD = 1


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int
    """Place of the member's local header."""


class ZipDirectory:
    """read(offset, size) gives bytes of the archive; only directories and headers are read here."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - END_SIZE - COMMENT)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP archive, or one cut short")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if FULL16 == count or FULL32 in (length, start):
            locator = read(tail_at + at - LOCATOR_SIZE, LOCATOR_SIZE)
            if locator[:4] != LOCATOR64:
                raise ValueError("the ZIP64 directory has no locator")
            end = read(struct.unpack("<Q", locator[8:16])[0], END64_SIZE)
            if end[:4] != END64:
                raise ValueError("the ZIP64 end of central directory is not where its locator says")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members = {m.name: m for m in self._entries(read(start, length), count)}

    @staticmethod
    def _entries(data: bytes, count: int):
        at = 0
        for _ in range(count):
            if data[at : at + 4] != ENTRY:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
            packed, size, name_n, extra_n, note_n = struct.unpack("<IIHHH", data[at + 20 : at + 34])
            header = struct.unpack("<I", data[at + 42 : at + 46])[0]
            name_at = at + ENTRY_SIZE
            name = data[name_at : name_at + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[name_at + name_n : name_at + name_n + extra_n]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == ZIP64_FIELD:
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    header = wide.pop(0) if header == FULL32 else header
                extra = extra[4 + n :]
            yield Member(name, method, packed, size, header)
            at = name_at + name_n + extra_n + note_n

    def place(self, member: Member) -> int:
        """Where a member's bytes begin."""
        local = self.read(member.header, LOCAL_SIZE)
        if local[:4] != LOCAL:
            raise ValueError(f"{member.name}: no local header")
        name_n, extra_n = struct.unpack("<HH", local[26:30])
        return member.header + LOCAL_SIZE + name_n + extra_n

    def range(self, member: Member, start: int, size: int) -> bytes:
        """Bytes of a stored member, without the rest of it."""
        if member.method:
            raise ValueError(f"{member.name} is packed; only stored members can be read by ranges")
        if start < 0 or start + size > member.size:
            raise ValueError(f"{member.name}: range beyond its end")
        return self.read(self.place(member) + start, size)
