"""Listings of zip archives from their central directories, read by ranges.

An archive ends with a record that says where its directory of entries is and how many it has. Only that tail (at most 64 KB and
a few bytes) and the directory are read, the latter a megabyte at a time, so an archive of any size takes bounded memory, and
its entries come out as rows while it is read. Archives beyond 4 GB (zip64) and those with something before the first entry
count. Not read: entries themselves, encrypted directories.

Defined results: what is no archive, one of several volumes, or one whose directory is broken gives a row without entry, with
the reason; entries before the break are listed. Folders are no entries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

#: Bytes of a directory that are read at once.
RANGE = 1 << 20
#: Fixed values of the format: signatures of the records, and the longest comment of an archive.
END, END64, LOCATOR64, ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
COMMENT = 65_535


class Entry(NamedTuple):
    idx: int
    entry: str | None
    size: int | None
    compressed: int | None
    error: str | None


def _failed(why: str) -> Entry:
    return Entry(-1, None, None, None, why)


def _directory(source: BinaryIO, length: int) -> tuple[int, int, int] | str:
    """(first byte, bytes, entries) of the directory, or why there is none."""
    tail_at = max(0, length - COMMENT - 22)
    source.seek(tail_at)
    tail = source.read(length - tail_at)
    k = tail.rfind(END)
    while k >= 0 and k + 22 + struct.unpack_from("<H", tail.ljust(k + 22, b"\0"), k + 20)[0] > len(tail):
        k = tail.rfind(END, 0, k)
    if k < 0 or len(tail) < k + 22:
        return "not_an_archive"
    disk, first_disk, here, entries, size, start, _ = struct.unpack_from("<HHHHIIH", tail, k + 4)
    end = tail_at + k
    if 0xFFFF in (disk, here, entries) or 0xFFFFFFFF in (size, start):
        source.seek(max(0, end - 20))
        locator = source.read(20)
        if locator[:4] == LOCATOR64:
            _, place, disks = struct.unpack("<IQI", locator[4:20])
            source.seek(place if place + 56 <= length else 0)
            record = source.read(56)
            if record[:4] != END64:
                return "broken_directory"
            disk, first_disk, here, entries, size, start = struct.unpack_from("<IIQQQQ", record, 16)
            if disks > 1:
                return "split_archive"
            end = place
    if disk or first_disk or here != entries:
        return "split_archive"
    if size > end:
        return "broken_directory"
    return end - size, size, entries  # the directory ends where the record begins, whatever stands before the archive


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")


def _large(extra: bytes, size: int, compressed: int) -> tuple[int, int]:
    """Sizes of an entry that are beyond 32 bits stand in an extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{min(length, len(extra) - at - 4) // 8}Q", extra, at + 4))
            size = values.pop(0) if size == 0xFFFFFFFF and values else size
            compressed = values.pop(0) if compressed == 0xFFFFFFFF and values else compressed
        at += 4 + length
    return size, compressed


def listing(source: BinaryIO) -> Iterator[Entry]:
    """The entries of an archive, in the order of its directory; idx counts folders, too."""
    source.seek(0, 2)
    found = _directory(source, source.tell())
    if isinstance(found, str):
        yield _failed(found)
        return
    start, left, entries = found
    source.seek(start)
    held, at = b"", 0
    for idx in range(entries):
        need = 46
        while True:
            if len(held) - at >= need:
                if held[at : at + 4] != ENTRY:
                    yield _failed("broken_directory")
                    return
                flags, _, _, _, _, compressed, size, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", held, at + 8)
                if len(held) - at >= (need := 46 + n + extra + comment):
                    break
            data = source.read(min(RANGE, left))
            if not data:
                yield _failed("broken_directory")
                return
            left -= len(data)
            held, at = held[at:] + data, 0
        name = _name(held[at + 46 : at + 46 + n], flags)
        size, compressed = _large(held[at + 46 + n : at + 46 + n + extra], size, compressed)
        at += need
        if not name.endswith("/"):
            yield Entry(idx, name, size, compressed, None)
