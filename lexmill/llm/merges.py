"""Byte-pair merges over many words at once: look-up of pairs, exact merging, and the check of adjacent tokens."""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that is not merged.
NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a grid of words that are merged together, and symbols from which on a word is merged by itself.
GRID, LONG = 1 << 17, 96


class Table:
    """Vectorised look-up of int32 values by distinct non-negative int64 keys: open addressing, linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(8, int(4 * keys.size).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, np.int32(missing)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int32)
        left, slot = np.arange(keys.size), self._slot(keys)
        while left.size:
            free = np.flatnonzero(self.keys[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free[first]]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], self.missing)
        look = np.flatnonzero((at != keys) & (at >= 0))
        while look.size:
            slot[look] = (slot[look] + 1) & self.mask
            at = self.keys[slot[look]]
            same = at == keys[look]
            out[look[same]] = self.values[slot[look[same]]]
            look = look[~same & (at >= 0)]
        return out


class Merges:
    """``pairs``: (left, right, merged) ids in order of rank; a merged id comes from one pair, its parts from lower ranks."""

    def __init__(self, pairs: list[tuple[int, int, int]], ids: int):
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.table = Table((left << 32) | right, np.arange(left.size, dtype=np.int32), int(NONE))
        self.merged = merged.astype(np.int32)
        #: Rank by which an id came to be, -1 for those that no merge makes, and its parts.
        self.rank = np.full(ids, -1, np.int64)
        self.left, self.right = np.arange(ids), np.arange(ids)
        self.rank[merged], self.left[merged], self.right[merged] = np.arange(left.size), left, right
        self.pairs = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table((a.astype(np.int64) << 32) | b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a and of b together are merged to a and b again.

        The merges of both sides are undone from the last to the first; at each state the pair that meets at the border
        must not have been merged before the merge that is undone next.  Of equal ranks the one more to the left comes first.
        """
        good = np.ones(a.size, bool)
        rows, a, b = np.arange(a.size), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(a.size, int(NONE), np.int64)
        while rows.size:
            over = self.ranks(a, b) < limit
            good[rows[over]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~over & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb = rows[on], a[on], b[on], ra[on], rb[on]
            undo_a = ra > rb
            # The border's pair comes before a merge of b also at the same rank.
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def exact(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words, given as ids one after another and their numbers of ids, by lowest rank, leftmost first."""
        starts = np.cumsum(sizes) - sizes
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            words = np.flatnonzero(sizes == size)
            if size > LONG:
                out += [(words[k : k + 1], np.array([self.exact_long(flat[starts[w] : starts[w] + size].tolist())], np.int32)) for k, w in enumerate(words.tolist())]
                continue
            step = max(1, GRID // size)
            for at in range(0, words.size, step):
                some = words[at : at + step]
                out += self._grid(flat[starts[some][:, None] + np.arange(size)].astype(np.int32), some)
        new_sizes = np.zeros(sizes.size, np.int64)
        for words, grid in out:
            new_sizes[words] = grid.shape[1]
        new_starts = np.cumsum(new_sizes) - new_sizes
        merged = np.empty(int(new_sizes.sum()), np.int32)
        for words, grid in out:
            merged[new_starts[words][:, None] + np.arange(grid.shape[1])] = grid
        return merged, new_sizes

    def _grid(self, grid: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge ``rows``, words of one length, by steps of one merge each: (words, their ids) of groups of one length each."""
        out = []
        rank = np.full(grid.shape, NONE, np.int32)
        rank[:, :-1] = self.ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(rank[:, :-1].shape)
        while rows.size:
            place = rank.argmin(1)
            each = np.arange(rows.size)
            best = rank[each, place]
            done = best == NONE
            if done.any():
                out.append((rows[done], grid[done]))
                on = ~done
                rows, grid, rank, place, best = rows[on], grid[on], rank[on], place[on], best[on]
                if not rows.size:
                    break
                each = np.arange(rows.size)
            width = grid.shape[1] - 1
            grid[each, place] = self.merged[best]
            stays = np.ones(grid.shape, bool)
            stays[each, place + 1] = False
            grid, rank = grid[stays].reshape(-1, width), rank[stays].reshape(-1, width)
            rank[:, -1] = NONE
            inner = np.flatnonzero(place < width - 1)
            rank[inner, place[inner]] = self.ranks(grid[inner, place[inner]], grid[inner, place[inner] + 1])
            inner = np.flatnonzero(place > 0)
            rank[inner, place[inner] - 1] = self.ranks(grid[inner, place[inner] - 1], grid[inner, place[inner]])
        return out

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same for one word of any length, with a heap over a linked list."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = pairs[a, b][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (m := pairs.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[after[left]]))
        return [i for i in ids if i >= 0]


class Trie:
    """Longest match of tokens in bytes, for many words at once."""

    def __init__(self, tokens: dict[bytes, int]):
        data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter(tokens.values(), np.int32, len(tokens))
        starts = np.cumsum(sizes) - sizes
        node, total = np.zeros(sizes.size, np.int64), 1
        keys, nodes, self.token = [], [], np.full(int(sizes.sum()) + 1, -1, np.int32)
        for depth in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > depth)
            distinct, place = np.unique((node[on] << 8) | data[starts[on] + depth], return_inverse=True)
            node[on] = total + place
            keys.append(distinct)
            nodes.append(np.arange(total, total + distinct.size, dtype=np.int32))
            total += distinct.size
            ends = on[sizes[on] == depth + 1]
            self.token[node[ends]] = ids[ends]
        self.token = self.token[:total]
        self.next = Table(np.concatenate(keys), np.concatenate(nodes), -1)

    def greedy(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``data``, taking the longest token from each place on, and how many each word has."""
        at, ends, words = starts.copy(), starts + sizes, np.flatnonzero(sizes > 0)
        owners, found = [], []
        while words.size:
            token, size = np.full(words.size, -1, np.int32), np.zeros(words.size, np.int64)
            node, rows, depth = np.zeros(words.size, np.int64), np.arange(words.size), 0
            while rows.size:
                step = self.next((node[rows] << 8) | data[at[words[rows]] + depth])
                hit = step >= 0
                rows, step = rows[hit], step[hit]
                node[rows] = step
                depth += 1
                own = self.token[step]
                ends_here = own >= 0
                token[rows[ends_here]], size[rows[ends_here]] = own[ends_here], depth
                rows = rows[at[words[rows]] + depth < ends[words[rows]]]
            owners.append(words)
            found.append(token)
            at[words] += size
            words = words[at[words] < ends[words]]
        if not owners:
            return np.empty(0, np.int32), np.zeros(sizes.size, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], np.bincount(owner, minlength=sizes.size)
