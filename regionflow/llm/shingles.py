"""Hashed word shingles of whole texts in numpy."""
from __future__ import annotations

import hashlib

_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: Words hashed at once; a longer text is taken in overlapping pieces.
PIECE_WORDS = 50_000
#: Bytes hashed at once.
BLOCK_BYTES = 400_000


def _mixed(x):
    """Multiply-xor finaliser in place: spreads the linear hash over all bits."""
    import numpy as np
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; A-Z lower-cased, words as in ``WORD``.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """

    def __init__(self, width: int):
        import numpy as np
        self.width, self.size = width, 0
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int):
        import numpy as np
        if n > self.size:
            self.size = n
            for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]

    def _hashes(self, pieces: list[list[bytes]]) -> list:
        """Shingle hashes of word lists, none of them empty."""
        import numpy as np
        buffer = np.frombuffer(b" ".join([word for words in pieces for word in words]) + b" ", np.uint8)
        up, down = self._powers(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        ends = np.flatnonzero(buffer == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        # every run of ``width`` words in the block, also those over a border; pieces then take their own
        firsts, lasts, cuts, at = [], [], [0], 0
        for words in pieces:
            wide = min(self.width, len(words))
            count = len(words) - wide + 1
            firsts.append(np.arange(at, at + count))
            lasts.append(np.arange(at + wide - 1, at + wide - 1 + count))
            cuts.append(cuts[-1] + count)
            at += len(words)
        begin, end = starts[np.concatenate(firsts)], ends[np.concatenate(lasts)]
        hashes = _mixed((sums[end] - sums[begin]) * down[begin])
        return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def sets(self, texts: list[str]) -> list:
        import numpy as np
        found = [[] for _ in texts]
        block, owners, held = [], [], 0

        def flush():
            for owner, hashes in zip(owners, self._hashes(block)):
                found[owner].append(hashes)

        for k, text in enumerate(texts):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            for a in range(0, max(1, len(words) - self.width + 1), PIECE_WORDS) if words else ():
                part = words[a:a + PIECE_WORDS + self.width - 1]
                block.append(part)
                owners.append(k)
                held += sum(map(len, part)) + len(part)
                if held > BLOCK_BYTES:
                    flush()
                    block, owners, held = [], [], 0
        if block:
            flush()
        return [np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                for parts in found]


def set_digest(hashes) -> bytes:
    """16 bytes that identify a sorted set of hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
