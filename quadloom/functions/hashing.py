"""Hash schemes and combinations of hashes.

Hashes are lower-case hex strings in columns and rows of `uint8` in NumPy. Two
combinations are defined on the bytes of equally long hashes:

* ordered: from 0, each byte becomes (byte * 37) xor next, modulo 256;
* unordered: each byte is the sum modulo 256, hence mergeable in any order.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of each scheme's hashes in bytes.
WIDTH = {"md5": 16, "murmur3_128": 16, "sha1": 20, "sha256": 32, "sha512": 64}

_M64 = (1 << 64) - 1


def _mix64(k: int) -> int:
    k = ((k ^ (k >> 33)) * 0xFF51AFD7ED558CCD) & _M64
    k = ((k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53) & _M64
    return k ^ (k >> 33)


def murmur3_128(data: bytes) -> bytes:
    """MurmurHash3 x64, 128 bits, seed 0, as its two words in little-endian order."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & _M64
    h1 = h2 = 0
    whole = len(data) // 16
    for i in range(whole):
        k1, k2 = struct.unpack_from("<QQ", data, 16 * i)
        h1 ^= (rot((k1 * c1) & _M64, 31) * c2) & _M64
        h1 = ((rot(h1, 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 ^= (rot((k2 * c2) & _M64, 33) * c1) & _M64
        h2 = ((rot(h2, 31) + h1) * 5 + 0x38495AB5) & _M64
    tail = data[16 * whole :]
    k1, k2 = struct.unpack("<QQ", tail.ljust(16, b"\0"))
    h2 ^= (rot((k2 * c2) & _M64, 33) * c1) & _M64
    h1 ^= (rot((k1 * c1) & _M64, 31) * c2) & _M64
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    h1, h2 = _mix64(h1), _mix64(h2)
    h1 = (h1 + h2) & _M64
    return struct.pack("<QQ", h1, (h2 + h1) & _M64)


def digest(data: bytes, scheme: str) -> bytes:
    return murmur3_128(data) if scheme == "murmur3_128" else hashlib.new(scheme, data, usedforsecurity=False).digest()


def blank_hash(scheme: str) -> bytes:
    """The hash that every blank node starts with."""
    return digest(b"", scheme)


def mark(sign: str, scheme: str) -> bytes:
    """The hash of a direction mark, `+` for subjects and `-` for objects."""
    return digest(sign.encode("utf-16-le"), scheme)


def int_hash(value: int, scheme: str) -> bytes:
    return digest(struct.pack("<i", value), scheme)


def rows_of(hashes: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, width)


def fold(*hashes: np.ndarray) -> np.ndarray:
    """Ordered combination, row by row, of arrays of hashes (or one hash for all rows)."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out * np.uint8(37)) ^ h
    return out


def words(hashes: np.ndarray) -> list[np.ndarray]:
    """Columns of unsigned words by which rows order as their hex strings do, the most significant first."""
    n, width = hashes.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = hashes
    return list(padded.view(">u8").astype(np.uint64).T)


def hexed(hashes: np.ndarray) -> list[str]:
    flat, width = np.ascontiguousarray(hashes).tobytes().hex(), 2 * hashes.shape[1]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


# --- columns ---------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _murmur_column(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else murmur3_128(t.encode()).hex())


def term_hash(term: Column | str, scheme: str = "md5") -> Column:
    """Hex hash of a term's N3 string; null for null. All schemes but murmur3_128 stay in the JVM."""
    t = F.col(term) if isinstance(term, str) else term
    if scheme == "murmur3_128":
        return _murmur_column(t)
    return {"md5": F.md5(t), "sha1": F.sha1(t), "sha256": F.sha2(t, 256), "sha512": F.sha2(t, 512)}[scheme]


def combine_ordered(*hashes: Column | str) -> Column:
    """Ordered combination of two or more hex columns; null if one of them is."""

    @F.pandas_udf(T.StringType())
    def combined(*cols: pd.Series) -> pd.Series:
        ok = np.logical_and.reduce([c.notna().to_numpy() for c in cols])
        out = pd.Series([None] * len(ok), dtype=object)
        if ok.any():
            arrays = []
            for c in cols:
                raw = bytes.fromhex("".join(c[ok]))
                arrays.append(np.frombuffer(raw, np.uint8).reshape(int(ok.sum()), -1))
            out[ok] = hexed(fold(*arrays))
        return out

    return combined(*(F.col(h) if isinstance(h, str) else h for h in hashes))


def combine_ordered_list(hashes: Column | str) -> Column:
    """Ordered combination of an array of hex hashes, in the array's order; null for an empty array."""

    @F.pandas_udf(T.StringType())
    def combined(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None or not len(x) else hexed(fold(*(np.frombuffer(bytes.fromhex(h), np.uint8)[None, :] for h in x)))[0])

    return combined(F.col(hashes) if isinstance(hashes, str) else hashes)


def combine_unordered(hashed: Column | str, scheme: str = "md5") -> Column:
    """Aggregate: unordered combination of a hex column. Byte sums combine map-side, so hot groups shuffle one row a task."""
    h = F.col(hashed) if isinstance(hashed, str) else hashed
    lanes = [F.sum(F.conv(F.substring(h, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")) % 256 for i in range(WIDTH[scheme])]
    return F.concat(*(F.lower(F.lpad(F.hex(x), 2, "0")) for x in lanes))


def digest_of(hashes: Column | str) -> Column:
    """The `digest` alternative to the combinations: md5 of the sorted, joined hashes; built-in functions only."""
    return F.md5(F.array_join(F.array_sort(F.col(hashes) if isinstance(hashes, str) else hashes), ""))
