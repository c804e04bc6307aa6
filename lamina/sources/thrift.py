"""Reader of the Thrift compact protocol, as far as Parquet metadata uses it. Structs become dictionaries by field number."""

from __future__ import annotations


class Compact:
    """Decodes values from bytes, from a position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return int.from_bytes(self.data[self.at - 1 : self.at], "little", signed=True)
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            import struct

            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError("metadata is cut short")
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n, of = head >> 4, head & 15
            if n == 15:
                n = self.varint()
            return [self.element(of) for _ in range(n)]
        if kind == 11:
            n = self.varint()
            if not n:
                return {}
            head = self.data[self.at]
            self.at += 1
            return {self.element(head >> 4): self.element(head & 15) for _ in range(n)}
        if kind == 12:
            return self.struct()
        raise ValueError(f"no such type in metadata: {kind}")

    def element(self, kind: int):
        """A member of a list or map; booleans there are bytes."""
        if kind in (1, 2):
            self.at += 1
            return self.data[self.at - 1] == 1
        return self.value(kind)

    def struct(self) -> dict:
        out, number = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if not head:
                return out
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = self.value(head & 15)
