"""Plain-Python helpers of the brute-force versions."""

import zlib


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(n):
    return zlib.crc32(str(n).encode())
