"""FNV-1a with 64 bits, as manifests write it."""

import numpy as np

#: Where the hash begins, and by what it is multiplied.
_START, _PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Fewer texts than this are hashed one by one.
_FEW = 16


def fnv1a64(data: bytes, value: int = _START) -> str:
    for byte in data:
        value = ((value ^ byte) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"fnv1a64:{value:016x}"


def fnv1a64_all(texts: list[bytes]) -> list[str]:
    """The hash of each text: a byte of all texts at a time, longest texts first,
    until only few are left, whose ends are hashed one by one."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    data = np.frombuffer(b"".join(texts), np.uint8)
    value = np.full(len(texts), _START, np.uint64)
    # The text that is the last of the first _FEW says how far all go together.
    together = int(size[order[_FEW - 1]]) if len(texts) >= _FEW else 0
    live = np.searchsorted(-size[order], -np.arange(together), side="left")
    for at, n in enumerate(live):
        value[:n] = (value[:n] ^ data[start[:n] + at]) * np.uint64(_PRIME)
    out = [""] * len(texts)
    for k, v in zip(order.tolist(), value.tolist(), strict=True):
        out[k] = fnv1a64(texts[k][together:], v)
    return out
