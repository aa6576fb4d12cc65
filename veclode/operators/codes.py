"""Codes at their real size, a binary column of dim x bits / 8 bytes a row, and their comparison inside a scan.

Bits follow the order of the elements, the lowest bit first. Sign bits are compared by counting the bits in which words differ,
product codes by adding up entries of a query's table, all others by one matrix product of a block that is unpacked for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import quantizers as Q

#: Bits of an element's code, and rows of a block.
BITS = {"FP16": 16, "BF16": 16, "E5M2": 8, "SQ8": 8, "SQ8U": 8, "SQ8P": 8, "PQ8": 8, **Q.BITS}
BLOCK = 2048


def _signed(z: Q.Quantizer) -> bool:
    return z.name == "SQ8P" or (z.name == "SQ8U" and z.metric == "IP")


def pack(c: np.ndarray, name: str) -> np.ndarray:
    """Codes [row][element] as bytes [row][byte]."""
    n = BITS[name]
    if name in ("FP16", "E5M2"):
        h = c.astype("<f2")
        if not np.isfinite(h).all():
            raise ValueError("an element is outside the range of half precision")
        raw = h.view("<u2") if name == "FP16" else (h.view("<u2") >> 8).astype(np.uint8)
        return raw.view(np.uint8).reshape(len(c), -1)
    if name == "BF16":
        return (c.astype("<f4").view("<u4") >> 16).astype("<u2").view(np.uint8).reshape(len(c), -1)
    c = c.astype(np.int64)
    if n == 8:
        return (c & 255).astype(np.uint8)
    return np.packbits(((c[:, :, None] >> np.arange(n)) & 1).astype(np.uint8).reshape(len(c), -1), axis=1, bitorder="little")


def unpack(raw: np.ndarray, name: str, dim: int, signed: bool = False) -> np.ndarray:
    """The inverse of :func:`pack`: integers, or for reduced precision the numbers themselves."""
    n = BITS[name]
    if name == "FP16":
        return np.ascontiguousarray(raw).view("<f2").astype(np.float64)
    if name == "E5M2":
        return (raw.astype("<u2") << 8).view("<f2").astype(np.float64)
    if name == "BF16":
        return (np.ascontiguousarray(raw).view("<u2").astype("<u4") << 16).view("<f4").astype(np.float64)
    if n == 8:
        return (raw.view(np.int8) if signed else raw)[:, :dim].astype(np.int32)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : dim * n].reshape(len(raw), dim, n)
    return bits.astype(np.int32) @ (1 << np.arange(n, dtype=np.int32))


def vectors(z: Q.Quantizer, raw: np.ndarray) -> np.ndarray:
    """What packed codes are compared as; the numbers of :meth:`Quantizer.code_vector`."""
    if z.name == "SQ8P":
        c, (m, bias) = unpack(raw[:, :-4], z.name, z.dim, True), unpack(raw[:, -4:], "BF16", 2).T
        y = c * m[:, None] / 127.0 / 127.0
        return np.column_stack((y, -bias)) if z.metric == "L2" else y
    c = unpack(raw, z.name, z.dim, _signed(z))
    if z.name in Q.PER_DIM:
        lo, dif = np.array(z.los), np.array(z.difs)
        if z.name == "SQ6":
            return (c + 0.5) / 63.0 * dif + lo
        if z.name == "SQ8":
            return (c + 0.5) * dif + 256.0 * lo
        return (c + 0.5) * dif + 16.0 * lo if z.metric == "L2" else (c + 0.5) / 16.0 * dif + lo
    if z.name == "SQ4UA":
        return (8 * c + 4).astype(np.float64)
    return c.astype(np.float64)


def _packed(name: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("c")
            raw = pack(x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), name)
            if "m" in b.schema.names:  # a code with a scale and a term of its own
                raw = np.column_stack((raw, pack(np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("m", "bias")]), "BF16")))
            raw = np.ascontiguousarray(raw)
            ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1])
            code = pa.Array.from_buffers(pa.binary(), len(raw), [None, ends.buffers()[1], pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), code], names=["vec_id", "code"])

    return run


def stored(base: DataFrame, z: Q.Quantizer) -> DataFrame:
    """(vec_id, code): the codes of base (vec_id, embedding)."""
    if z.name not in BITS:
        raise ValueError(f"{z.name} has no codes")
    rows = base.select("vec_id", V.sound(F.col("embedding"), z.dim).alias("v"))
    cols = [z.encode(F.col("v")).alias("c")]
    if z.name == "SQ8P":
        cols += [V.bf16(F.array_max(F.transform("v", F.abs))).alias("m"), F.coalesce(z.bias(F.col("v")), F.lit(0.0)).alias("bias") if z.metric == "L2" else F.lit(0.0).alias("bias")]
    return rows.select("vec_id", *cols).mapInArrow(_packed(z.name), "vec_id long, code binary")


def bytes_of(column) -> np.ndarray:
    """The rows of an Arrow binary column whose values have one length."""
    x = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(x):
        return np.zeros((0, 0), np.uint8)
    import pyarrow as pa

    at = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
    if x.null_count or (np.diff(at) != at[1] - at[0]).any():
        raise ValueError("codes are null or of unequal length")
    return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(x), -1)


# --- blocks of base rows, as a search sees them ---------------------------------------------------------------------

def distances(q: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Distances of rows of q and y, summed in the order of the elements like the column expressions."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        if kind == "L2":
            d = q[:, j] - y[:, j]
            out += d * d
        else:
            out += q[:, j] * y[:, j]
    return out if kind == "L2" else -out


def _error(qq: np.ndarray, most: float, dim: int, kind: str) -> np.ndarray:
    """By how much a distance may be off that is not summed in order; most: the largest squared length of a base row."""
    unit = (4 * dim + 16) * 2.0**-53
    return unit * (qq + most) if kind == "L2" else unit * np.sqrt(qq * most)


class Rows:
    """A block of vectors."""

    def __init__(self, y: np.ndarray) -> None:
        self.y = y

    def __len__(self) -> int:
        return len(self.y)

    def near(self, q: np.ndarray, qq: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Distances [query][row] and by how much those of each query may be off."""
        yy, d = (self.y * self.y).sum(axis=1), q @ self.y.T
        return (qq[:, None] + yy - 2 * d if kind == "L2" else -d), _error(qq, yy.max(), q.shape[1], kind)

    def exactly(self, q: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
        return distances(q, self.y[at], kind)


class Signs:
    """A block of sign bits: their squared distance is the number of bits that differ."""

    def __init__(self, raw: np.ndarray) -> None:
        self.words = self._words(raw)

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def _words(raw: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))).view(np.uint64)

    def near(self, q: np.ndarray, qq: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        own, d = self._words(pack(q, "SQ1")), np.zeros((len(q), len(self)))
        for j in range(own.shape[1]):
            d += np.bitwise_count(own[:, None, j] ^ self.words[None, :, j])
        return d, np.zeros(len(q))

    def exactly(self, q: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
        own, d = self._words(pack(q, "SQ1")), np.zeros(len(q))
        for j in range(own.shape[1]):
            d += np.bitwise_count(own[:, j] ^ self.words[at, j])
        return d


class Tables:
    """Of each query the distance of its part to each centroid of a sub-space: [sub-space][centroid][query]."""

    #: Bytes of tables that are kept from one block to the next.
    KEPT = 256 << 20

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.kept, self.size = book, {}, 0

    def of(self, q: np.ndarray, kind: str) -> np.ndarray:
        key = (q.__array_interface__["data"][0], q.shape, kind)
        if (t := self.kept.get(key)) is not None:
            return t[1]
        n, k, sd = self.book.shape
        t, x = np.zeros((n, k, len(q))), np.ascontiguousarray(q.T).reshape(n, sd, -1)
        for j in range(sd):
            a, b = x[:, None, j, :], self.book[:, :, j, None]
            t += (a - b) ** 2 if kind == "L2" else -a * b
        if self.size + t.nbytes <= self.KEPT:
            self.kept[key], self.size = (q, t), self.size + t.nbytes  # q is held too, so that its address stays its own
        return t


class Products:
    """A block of product codes."""

    def __init__(self, code: np.ndarray, tables: Tables) -> None:
        self.code, self.tables = code, tables

    def __len__(self) -> int:
        return len(self.code)

    def near(self, q: np.ndarray, qq: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        t, book = self.tables.of(q, kind), self.tables.book
        d = t[0][self.code[:, 0]]
        for s in range(1, len(book)):
            d = d + t[s][self.code[:, s]]
        return np.ascontiguousarray(d.T), _error(qq, (book * book).sum(axis=2).max(axis=1).sum(), q.shape[1], kind)

    def exactly(self, q: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
        book = self.tables.book
        return distances(q, book[np.arange(len(book))[None, :], self.code[at]].reshape(len(at), -1), kind)


def rows(x: np.ndarray) -> Iterator[tuple[slice, Rows]]:
    """Vectors in blocks."""
    for s in range(0, len(x), BLOCK):
        yield slice(s, s + BLOCK), Rows(x[s : s + BLOCK])


class Plain:
    """Reads blocks of vectors from a list column."""

    column = "v"

    def __init__(self, width: int) -> None:
        self.width = width

    def blocks(self, column) -> Iterator[tuple[slice, Rows]]:
        yield from rows(V.matrix(column, self.width))


class Packed:
    """Reads blocks from a column of packed codes."""

    column = "code"

    def __init__(self, z: Q.Quantizer) -> None:
        self.z = z

    def blocks(self, column) -> Iterator[tuple[slice, Rows | Signs | Products]]:
        raw = bytes_of(column)
        tables = Tables(self.z.codebook) if self.z.name == "PQ8" else None
        if tables is not None:
            self.tables = tables = self.__dict__.get("tables", tables)  # a task's batches share them
        for s in range(0, len(raw), BLOCK):
            part = raw[s : s + BLOCK]
            yield slice(s, s + BLOCK), Signs(part) if self.z.name == "SQ1" else Products(part, tables) if tables is not None else Rows(vectors(self.z, part))
