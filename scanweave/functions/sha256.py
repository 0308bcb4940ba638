"""SHA-256 that can be put down and taken up again in another process."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util

_STATE = 128  # bytes; OpenSSL's SHA256_CTX has 112


def _openssl():
    """The OpenSSL that hashlib itself uses, or else the system's."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update
    except (AttributeError, OSError):
        lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    return lib


class Sha256:
    """As ``hashlib.sha256``, which keeps its state to itself; ``state`` is the hash so far as bytes, to go on from."""

    def __init__(self, state: bytes | None = None):
        self._lib = _openssl()
        self._ctx = ctypes.create_string_buffer(state or b"", _STATE)
        if not state:
            self._lib.SHA256_Init(self._ctx)

    @property
    def state(self) -> bytes:
        return self._ctx.raw

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._ctx, data, len(data))

    def update_at(self, address: int, length: int) -> None:
        """Takes ``length`` bytes from memory, such as an Arrow buffer's, without a copy."""
        self._lib.SHA256_Update(self._ctx, address, length)

    def hexdigest(self) -> str:
        """Of what was taken so far; the state stays as it is."""
        end = ctypes.create_string_buffer(self._ctx.raw, _STATE)
        out = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, end)
        return out.raw.hex()
