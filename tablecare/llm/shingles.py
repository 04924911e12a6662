"""Sets of word shingles as arrays of hashes, and signatures that similar sets must share."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

WORDS = 4
#: Two sets link when 100 * intersection >= SHARE * union.
SHARE = 85
#: Words hashed together; a longer word stands as its digest, so arrays stay small.
TOGETHER, LONGEST = 1 << 15, 64
BASE = 0x9E3779B97F4A7C15
#: Sizes of a level: from its bound to GROWTH times that.
GROWTH = 1.6


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _spans(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    words = [w if len(w) <= LONGEST else b"\0" + hashlib.blake2b(w, digest_size=32).digest() for w in words]
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(TOGETHER * (LONGEST + 1) // 8 if len(data) < TOGETHER * LONGEST // 8 else len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    a, b = starts[: len(words) - size + 1], ends[size - 1 :]
    return mixed((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: all runs of ``WORDS`` words, lower-cased A-Z;
    the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(WORDS, len(words))
    return np.unique(
        np.concatenate(
            [_spans(words[i : i + TOGETHER + size - 1], size) for i in range(0, len(words) - size + 1, TOGETHER)]
        )
    )


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes that tell a set."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


@lru_cache(maxsize=None)
def _bounds() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def differences(a: int, b: int) -> int:
    """The most elements in which linked sets of at most ``a`` and ``b`` elements differ."""
    return (a + b) * (100 - SHARE) // (100 + SHARE)


def _slice_hashes(hashes: np.ndarray, slices: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the elements in each slice of the hash space, and their number."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    cuts = np.searchsorted(hashes, _edges(slices))
    counts = np.diff(cuts)
    place = np.arange(slices, dtype=np.uint64) * np.uint64(BASE) + np.uint64(tag * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return mixed(sums[cuts[1:]] - sums[cuts[:-1]] + place + counts.astype(np.uint64)), counts


def _strongest(found: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Where the ``wanted`` strongest slices are, strongest first."""
    return np.lexsort((found, counts))[::-1][:wanted]


def signatures(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set; any two sets that link have one in common.

    Sizes fall into levels. A set has signatures of its own level and, if a smaller set of the
    level below could link with it, of that one too, so linked sets meet at the smaller one's
    level. There the hash space is cut into more slices than elements in which linked sets can
    differ, so the sets agree in a slice; a signature is the hash of a slice's elements.

    Of its slices a set needs one more than elements it can differ in, so it takes the strongest:
    those with most elements, and of these the ones with the largest hashes. Slices that agree
    are as strong in both sets. Of two sets that link, that with the higher bar therefore takes
    a slice that agrees with the other's, and the other takes it too. Sets that share few
    elements only rarely meet, since a slice of one or two elements is seldom among those taken.

    ``frequent`` (sorted) are elements to leave out, the same for all sets; sets that only share a
    passage that everyone quotes then do not meet. That holds as long as more slices have other
    elements than sets can differ in, which spare slices see to. A set with too few of them has
    signatures of all its elements too, and of empty slices if even those are too few: of two
    sets that link, either one has enough, or both have all.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    bounds = _bounds()
    level = int(np.searchsorted(bounds, n, "right")) - 1
    rest = hashes
    if len(frequent):
        rest = hashes[frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes]
    out = []
    for at in (level, level - 1):
        top = bounds[at + 1] - 1
        larger = top * 100 // SHARE
        if at < 0 or n > larger:
            continue
        differ = differences(top, larger)
        slices = differ + 1 + -(-differ // 10)
        # What this set can differ in from those it is to meet here.
        most = differences(n, top if at < level else n * 100 // SHARE)
        found, counts = _slice_hashes(rest, slices, 2 * at)
        taken = _strongest(found, counts, most + 1)
        out.append(found[taken[counts[taken] > 0]])
        if len(out[-1]) <= most:
            found, counts = _slice_hashes(hashes, slices, 2 * at + 1)
            taken = _strongest(found, counts, most + 1)
            out.append(found[taken] if counts[taken[-1]] > 0 else found)
    return np.concatenate(out)


@lru_cache(maxsize=256)
def _edges(slices: int) -> np.ndarray:
    """Where slices of the hash space begin, and a last bound that no hash reaches but the largest."""
    return np.array([(i << 64) // slices for i in range(slices)] + [(1 << 64) - 1], np.uint64)
