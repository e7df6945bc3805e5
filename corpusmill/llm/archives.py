"""ZIP archives of stored members: written whole, read by their central directory and by byte ranges, never extracted.

The layout is that of the public ZIP application note: local headers before the members, a central directory after them, an end record
last. ZIP64 records are written where a value needs them or where they are asked for, and read wherever they stand.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

#: Fixed values of the format: signatures, the mark of a value that stands in a ZIP64 field, and that field's tag.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
END64, LOCATOR64 = 0x06064B50, 0x07064B50
IN_ZIP64, IN_ZIP64_COUNT, TAG64 = 0xFFFFFFFF, 0xFFFF, 1
LOCAL_HEAD, CENTRAL_HEAD, END_RECORD = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
END64_RECORD, LOCATOR64_RECORD = struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
#: Names are UTF-8; the date is 1 January 1980, the first that the format knows, so that equal contents make equal archives.
UTF8, EPOCH = 0x800, 0x21


@dataclass(frozen=True)
class Member:
    name: str
    crc: int
    size: int
    header: int  # offset of the local header
    method: int = 0


class ZipBuilder:
    """Collects stored members; parts() are the archive's bytes in order. zip64=True writes every ZIP64 record."""

    def __init__(self, zip64: bool = False):
        self.zip64, self._parts, self._members, self.size = zip64, [], [], 0

    def add(self, name: str, data: bytes) -> None:
        crc, label, big = zlib.crc32(data), name.encode(), self.zip64 or len(data) >= IN_ZIP64
        extra = struct.pack("<HHQQ", TAG64, 16, len(data), len(data)) if big else b""
        size = IN_ZIP64 if big else len(data)
        head = LOCAL_HEAD.pack(LOCAL, 45 if big else 20, UTF8, 0, 0, EPOCH, crc, size, size, len(label), len(extra))
        self._members.append(Member(name, crc, len(data), self.size))
        for part in (head, label, extra, data):
            self._parts.append(part)
            self.size += len(part)

    def __len__(self) -> int:
        return len(self._members)

    def parts(self) -> list[bytes]:
        tail, start = [], self.size
        for m in self._members:
            label = m.name.encode()
            big = self.zip64 or m.size >= IN_ZIP64 or m.header >= IN_ZIP64
            extra = struct.pack("<HHQQQ", TAG64, 24, m.size, m.size, m.header) if big else b""
            size, header = (IN_ZIP64, IN_ZIP64) if big else (m.size, m.header)
            version = 45 if big else 20
            tail += [CENTRAL_HEAD.pack(CENTRAL, version, version, UTF8, 0, 0, EPOCH, m.crc, size, size, len(label), len(extra), 0, 0, 0, 0, header), label, extra]
        length, n = sum(map(len, tail)), len(self._members)
        big = self.zip64 or n >= IN_ZIP64_COUNT or start + length >= IN_ZIP64
        if big:
            tail.append(END64_RECORD.pack(END64, END64_RECORD.size - 12, 45, 45, 0, 0, n, n, length, start))
            tail.append(LOCATOR64_RECORD.pack(LOCATOR64, 0, start + length, 1))
        count, length, start = (IN_ZIP64_COUNT, IN_ZIP64, IN_ZIP64) if big else (n, length, start)
        tail.append(END_RECORD.pack(END, 0, 0, count, count, length, start, 0))
        return self._parts + tail


def directory(file) -> list[Member]:
    """The central directory of an archive, in its order; file has size and read_at(offset, length)."""
    back = min(file.size, END_RECORD.size + 0xFFFF)
    tail = file.read_at(file.size - back, back)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end record: not a ZIP archive, or cut short")
    _, _, _, _, count, length, start, _ = END_RECORD.unpack_from(tail, at)
    end = file.size - back + at
    if IN_ZIP64 in (length, start) or count == IN_ZIP64_COUNT:
        sign, _, where, _ = LOCATOR64_RECORD.unpack(file.read_at(end - LOCATOR64_RECORD.size, LOCATOR64_RECORD.size))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, *_, count, length, start = END64_RECORD.unpack(file.read_at(where, END64_RECORD.size))
        if sign != END64:
            raise ValueError("no ZIP64 end record")
    data, found, p = file.read_at(start, length), [], 0
    for _ in range(count):
        sign, _, _, _, method, _, _, crc, packed, size, n, x, c, _, _, _, header = CENTRAL_HEAD.unpack_from(data, p)
        if sign != CENTRAL:
            raise ValueError("broken central directory")
        p += CENTRAL_HEAD.size
        name, extra = data[p : p + n].decode(), data[p + n : p + n + x]
        p += n + x + c
        if IN_ZIP64 in (packed, size, header):
            size, header = _zip64(extra, packed, size, header)
        found.append(Member(name, crc, size, header, method))
    return found


def _zip64(extra: bytes, packed: int, size: int, header: int) -> tuple[int, int]:
    """Size and offset, from the ZIP64 field where they stand there: it holds only those that are marked, in a fixed order."""
    p = 0
    while p + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, p)
        if tag == TAG64:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
            size = next(values) if size == IN_ZIP64 else size
            _ = next(values) if packed == IN_ZIP64 else packed
            return size, next(values) if header == IN_ZIP64 else header
        p += 4 + n
    raise ValueError("no ZIP64 field")


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose extra field may differ from the directory's."""
    if member.method:
        raise ValueError(f"{member.name} is compressed by the archive; only stored members can be read by range")
    sign, *_, n, x = LOCAL_HEAD.unpack(file.read_at(member.header, LOCAL_HEAD.size))
    if sign != LOCAL:
        raise ValueError(f"no local header at {member.header}")
    return member.header + LOCAL_HEAD.size + n + x


def read_member(file, member: Member) -> bytes:
    data = file.read_at(data_offset(file, member), member.size)
    if zlib.crc32(data) != member.crc:
        raise OSError(f"{member.name}: checksum differs")
    return data
