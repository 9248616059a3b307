"""CRC-32 of many byte strings at once, as matrices of strings of equal length (numpy).

Strings are grouped by length.  Each group is a two-dimensional array of bytes, one row for each distinct
string, and the registers of all its rows take one column after the other.  The values go back to where
the strings came from.  Strings longer than `BLOCK` bytes are cut into rows of `BLOCK` bytes, whose registers
are joined by the linearity of the code, so the number of steps does not grow with the longest string.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 256
#: Bytes of a matrix that is held at a time.
HELD = 1 << 24


@cache
def _table() -> np.ndarray:
    """Registers after one byte, from the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


def _columns(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Registers of all rows after the bytes of all columns."""
    table, columns = _table(), np.ascontiguousarray(matrix.T)
    for column in columns:
        register = table[(register ^ column) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


@cache
def _zeros() -> np.ndarray:
    """What a register of one non-zero byte becomes after `BLOCK` bytes of zero, by place and value of the byte."""
    start = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    return _columns(start, np.zeros((1, BLOCK), np.uint8)).reshape(4, 256)


def _long(text: np.ndarray) -> int:
    """CRC-32 of one string: a row for each block, the registers of the rows joined in order."""
    head = len(text) % BLOCK
    register = int(_columns(np.full(1, 0xFFFFFFFF, np.uint32), text[None, :head])[0])
    zeros = [x.tolist() for x in _zeros()]
    body = text[head:].reshape(-1, BLOCK)
    step = HELD // BLOCK
    for i in range(0, len(body), step):
        part = body[i : i + step]
        for own in _columns(np.zeros(len(part), np.uint32), part).tolist():
            r = register
            register = zeros[0][r & 255] ^ zeros[1][r >> 8 & 255] ^ zeros[2][r >> 16 & 255] ^ zeros[3][r >> 24] ^ own
    return register ^ 0xFFFFFFFF


def by_length(start: np.ndarray, end: np.ndarray):
    """`(length, indices)` for each length that occurs."""
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        yield int(length[group[0]]), group


def matrix(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The strings of one length as rows."""
    return np.lib.stride_tricks.sliding_window_view(data, length)[start]


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(index of one of each distinct row, place of each row among them)`, compared by all bytes.

    Rows of up to eight bytes are compared as one integer.
    """
    n, width = rows.shape
    if width <= 8:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = rows
        keys = wide.view(np.uint64).ravel()
    else:
        keys = np.ascontiguousarray(rows).view(f"S{width}").ravel()
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return first, place.ravel()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 (uint32) of the strings `data[start:end]`, each distinct one computed once per matrix."""
    out = np.zeros(len(start), np.uint32)
    for length, group in by_length(start, end):
        if length > BLOCK:
            for g in group.tolist():
                out[g] = _long(data[start[g] : end[g]])
        elif length:
            step = max(HELD // length, 1)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                rows = matrix(data, start[part], length)
                first, place = distinct_rows(rows)
                register = _columns(np.full(len(first), 0xFFFFFFFF, np.uint32), rows[first])
                out[part] = (register ^ np.uint32(0xFFFFFFFF))[place]
    return out
