"""Simple-8b: 64-bit words that each hold as many ids as fit, the count and width named by a 4-bit selector.

Ids are cut into blocks of a fixed number; a word never crosses a block, and the offset of every block's first word is kept, so blocks
decode independently and all words with the same selector decode in one vector operation. Selector 15 is the escape: the word after
it is one raw 64-bit id, for ids of 60 bits or more.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word and bits of each, by selector 0-13: fixed values of the coding.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15


_SHORT = np.maximum(np.ceil(np.log2(np.arange(1 << 16, dtype=np.float64) + 1)), 1).astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1. Exact for 64-bit ids: the 16-bit quarters are looked up apart."""
    if int(ids.max()) < 1 << 16:
        return _SHORT[ids]
    out = np.ones(len(ids), dtype=np.int8)
    for quarter in range(4):
        part = (ids >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _SHORT[part] + np.int8(16 * quarter), out)
    return out


def _windows(fits: np.ndarray, n: int) -> np.ndarray:
    """Whether n neighbours from each column on all fit; the last n - 1 columns of fits are margin."""
    span, have = fits, 1
    while 2 * have <= n:
        span = span[:, : span.shape[1] - have] & span[:, have:]
        have *= 2
    rest = n - have
    return span[:, : span.shape[1] - rest] & span[:, rest:] if rest else span


def _best(width: np.ndarray, n: int, block: int) -> np.ndarray:
    """The fullest selector that can start at each id: its first COUNTS ids, as far as the block goes, are narrow enough."""
    n_blocks, margin = -(-n // block), int(COUNTS[0])
    padded = np.ones((n_blocks, block + margin), dtype=np.int8)  # beyond a block's end everything fits
    flat = np.ones(n_blocks * block, dtype=np.int8)
    flat[:n] = width
    padded[:, :block] = flat.reshape(n_blocks, block)
    pick = np.full((n_blocks, block), ESCAPE, dtype=np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):  # one wide id, two, three ... narrower and narrower
        good = _windows(padded <= BITS[s], int(COUNTS[s]))[:, :block]
        if not good.any():
            break  # a fuller selector asks for more ids in fewer bits
        pick[good] = s
    return pick.reshape(-1)[:n]


def encode(ids: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and each block's first word (int64, with the total at the end)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    n_blocks = -(-n // block)
    pick = _best(_widths(ids), n, block)
    count = np.ones(16, dtype=np.int64)
    count[: len(COUNTS)] = COUNTS
    at, owner, turn = np.arange(0, n, block), np.arange(n_blocks), 0
    starts, owners, turns = [], [], []
    while len(at):  # one word of every unfinished block a turn
        starts.append(at)
        owners.append(owner)
        turns.append(np.full(len(at), turn))
        at = at + count[pick[at]]
        more = at < np.minimum((owner + 1) * block, n)
        at, owner, turn = at[more], owner[more], turn + 1
    first, owner, turns = np.concatenate(starts), np.concatenate(owners), np.concatenate(turns)
    kind = pick[first]
    size = 1 + (kind == ESCAPE)
    per_block = np.bincount(owner, weights=size, minlength=n_blocks).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_block)])
    if (kind == ESCAPE).any():
        order = np.argsort(first, kind="stable")
        place = np.empty(len(first), dtype=np.int64)
        place[order] = np.cumsum(size[order]) - size[order]
    else:
        place = offsets[owner] + turns
    words = np.zeros(int(offsets[-1]), dtype=np.uint64)
    left = np.minimum((owner + 1) * block, n) - first
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            words[place[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[mine] + 1] = ids[first[mine]]
            continue
        for own, full in ((mine[left[mine] >= COUNTS[s]], True), (mine[left[mine] < COUNTS[s]], False)):
            word = np.full(len(own), np.uint64(s) << np.uint64(60), dtype=np.uint64)
            for k in range(int(COUNTS[s])) if len(own) else ():
                if not full:  # the last words of blocks
                    own_k = left[own] > k
                    word[own_k] |= ids[first[own[own_k]] + k] << np.uint64(k * BITS[s])
                else:
                    word |= ids[first[own] + k] << np.uint64(k * BITS[s])
            words[place[own]] = word
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = 1024) -> np.ndarray:
    """The n ids (uint64) of whole blocks."""
    out = np.zeros(n, dtype=np.uint64)
    if n == 0:
        return out
    pick = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)  # the word after an escape
    if (pick == ESCAPE).any():
        # a raw word may itself look like an escape: in a run of such words every second one is raw
        marks = np.flatnonzero(pick == ESCAPE)
        run = np.concatenate([[True], np.diff(marks) > 1])
        rank = np.arange(len(marks)) - np.maximum.accumulate(np.where(run, np.arange(len(marks)), 0))
        raw[marks[rank % 2 == 0] + 1] = True
    counts = np.where(raw, 0, np.where(pick == ESCAPE, 1, COUNTS[np.minimum(pick, len(COUNTS) - 1)]))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.cumsum(counts) - counts
    start = before - before[offsets[owner]] + owner * block
    end = np.minimum((owner + 1) * block, n)
    for s in np.unique(pick[~raw]):
        mine = np.flatnonzero((pick == s) & ~raw)
        if s == ESCAPE:
            out[start[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            spot = start[mine] + k
            inside = spot < end[mine]
            out[spot[inside]] = (words[mine[inside]] >> np.uint64(k * BITS[s])) & mask
    return out
