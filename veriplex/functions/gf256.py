"""Arithmetic in GF(2**8) and the Cauchy code over ragged symbols.

A symbol is bytes followed by zeros without end; parity is defined byte by byte, and stored without its trailing zeros.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the code: field polynomial, generator, rows' points, limits.
POLYNOMIAL, GENERATOR = 0x11D, 2
ROW_POINTS = (0, 1, 2, 255, 254, 253, 252, 251)
COLUMN_SHIFT = 3
MAX_DATA, MAX_PARITY = 36, 8


class RsError(Exception):
    """Reed-Solomon refusals; ``kind`` is one of GroupSize, ParityCount, Ragged, NotEnough, Singular, MemberTooLong."""

    def __init__(self, kind: str, detail: object = None) -> None:
        super().__init__(kind if detail is None else f"{kind}({detail})")
        self.kind, self.detail = kind, detail


def _tables() -> tuple[np.ndarray, np.ndarray]:
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x = (x << 1) ^ (POLYNOMIAL if x & 0x80 else 0)
    exp = np.array(powers, np.uint8)
    log = np.zeros(256, np.int64)
    log[exp] = np.arange(255)
    product = exp[(log[:, None] + log[None, :]) % 255]
    product[0, :] = product[:, 0] = 0
    inverse = exp[(255 - log) % 255]
    inverse[0] = 0
    return product, inverse


#: MUL[a, b] is the product of a and b; INV[a] the inverse of a, 0 for 0.
MUL, INV = _tables()


def div(a: int, b: int) -> int:
    if not b:
        raise ZeroDivisionError("division by zero in GF(256)")
    return int(MUL[a, INV[b]])


def coefficient(row: int, column: int) -> int:
    return int(INV[ROW_POINTS[row] ^ (COLUMN_SHIFT + column)])


def matrix(rows: int, columns: int) -> np.ndarray:
    return np.array([[coefficient(r, c) for c in range(columns)] for r in range(rows)], np.uint8).reshape(rows, columns)


def trim(symbol: bytes) -> bytes:
    return symbol.rstrip(b"\0")


def _stack(symbols: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(symbols), width), np.uint8)
    for i, s in enumerate(symbols):
        out[i, :len(s)] = np.frombuffer(s, np.uint8)[:width]
    return out


def multiply(m: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), data.shape[1]), np.uint8)
    for c in range(m.shape[1]):
        out ^= MUL[m[:, c]][:, data[c]]
    return out


def _check(k: int, m: int) -> None:
    if not 1 <= k <= MAX_DATA:
        raise RsError("GroupSize", k)
    if not 1 <= m <= MAX_PARITY:
        raise RsError("ParityCount", m)


def _products() -> np.ndarray:
    """(columns, 256): the products of a byte with a column's coefficients in all rows, side by side in one number of MAX_PARITY bytes."""
    return np.ascontiguousarray(MUL[matrix(MAX_PARITY, MAX_DATA)].transpose(1, 2, 0)).view(np.uint64)[:, :, 0]


PRODUCTS = _products()


def encode(data: list[bytes], m: int) -> list[bytes]:
    """m trimmed parity symbols of the data symbols. A byte is looked up once for all rows; a symbol costs its own length, not the longest one's."""
    _check(len(data), m)
    total = np.zeros(max(map(len, data)), np.uint64)
    for products, symbol in zip(PRODUCTS, data, strict=False):
        total[:len(symbol)] ^= products.take(np.frombuffer(symbol, np.uint8), mode="clip")
    return [trim(r.tobytes()) for r in total.view(np.uint8).reshape(-1, MAX_PARITY).T[:m]]


def invert(m: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix, by elimination."""
    n = len(m)
    work = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        pivot = i + int((work[i:, i] != 0).argmax())
        if not work[pivot, i]:
            raise RsError("Singular")
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = MUL[INV[work[i, i]], work[i]]
        for r in range(n):
            if r != i and work[r, i]:
                work[r] ^= MUL[work[r, i], work[i]]
    return work[:, n:]


def repair(k: int, m: int, have: list[bytes | None], max_length: int) -> list[bytes]:
    """The k data symbols, length prefix included, from any k of the k + m; lengths are solved and bounded first."""
    _check(k, m)
    if len(have) != k + m:
        raise RsError("Ragged")
    held = [i for i, s in enumerate(have) if s is not None][:k]
    if len(held) < k:
        raise RsError("NotEnough", len(held))
    full = np.concatenate([np.eye(k, dtype=np.uint8), matrix(m, k)])
    solve = invert(full[held])
    symbols = [have[i] or b"" for i in held]
    lengths = multiply(solve, _stack(symbols, 4))
    sizes = [int.from_bytes(row.tobytes(), "little") for row in lengths]
    for n in sizes:
        if n > max_length:
            raise RsError("MemberTooLong", n)
    width = 4 + max(sizes)
    rows = multiply(solve, _stack(symbols, width))
    return [row.tobytes()[:4 + n] for row, n in zip(rows, sizes, strict=True)]
