"""Texts as arrays of 64-bit word hashes, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

U64 = np.uint64
#: A cache of words is emptied beyond so many entries.
CACHE_ENTRIES = 200_000


def blocks(rows: Iterable[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Lists of rows of about `limit` characters; a longer row stands alone."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size_of(row)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


class WordHashes(dict):
    """Word (bytes or str) to a 64-bit hash; the same in every process."""

    def __missing__(self, word):
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class PlainWordHashes(dict):
    """The same for letters and digits alone; 0 for a word that has none."""

    def __missing__(self, word: str):
        if len(self) > CACHE_ENTRIES:
            self.clear()
        bare = "".join(filter(str.isalnum, word))
        self[word] = value = (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0
        return value


def contract_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs of anything but \\x20 and \\x09-\\x0D (what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_array(words: list, cache: dict) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words, in order; words in another order hash otherwise."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    h = words[:n] + U64(size)
    for k in range(1, size):
        h *= U64(0x9E3779B97F4A7C15)
        h += words[k : k + n]
    return mix(h)


def shingle_sets(texts: list[str], size: int, cache: dict) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of `size` contract words of each text; of all its words if they are fewer; none without words."""
    words = [contract_words(t) for t in texts]
    ends = np.cumsum([len(w) for w in words]).tolist()
    every = np.fromiter((h for w in words for h in map(cache.__getitem__, w)), U64, ends[-1] if ends else 0)
    runs, start, out = window_hashes(every, size), 0, []
    for end in ends:
        if end - start >= size:
            s = np.sort(runs[start : end - size + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = window_hashes(every[start:end], end - start) if end > start else np.empty(0, U64)
        out.append(s)
        start = end
    return out
