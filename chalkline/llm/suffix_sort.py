"""Deep-shallow sorting of suffixes, cut at a fixed length.

Suffixes are rows of a byte matrix. Multikey quicksort (ternary partitions on eight bytes at a time, all groups of a
round at once) orders them to a shallow depth; groups that agree so far share a long prefix and are ordered by a blind
trie, which looks at branching bytes only and compares a new suffix with one leaf.
"""

import numpy as np

SHALLOW_WORDS = 2


def _words(rows: np.ndarray) -> np.ndarray:
    """The rows as big-endian eight-byte characters, padded with zeros."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place): rows by their first ``depth`` characters; groups are equal in all of them."""
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    at = np.zeros(n, np.int64)  # characters that a row's group agrees in
    active = np.arange(n) if n > 1 and depth else np.zeros(0, np.int64)
    while len(active):
        own = group[active]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sizes = np.diff(np.append(first, len(active)))
        char = words[order[active], at[active]]
        pivot = np.repeat(char[first + sizes // 2], sizes)
        side = np.where(char < pivot, 0, np.where(char == pivot, 1, 2))
        number = np.repeat(np.arange(len(first)), sizes) * 3 + side
        moved = np.argsort(number, kind="stable")
        order[active], number, side = order[active][moved], number[moved], side[moved]
        at[active] = at[active][moved] + (side == 1)
        fresh = np.concatenate(([True], number[1:] != number[:-1]))
        starts = np.flatnonzero(fresh)
        group[active] = active[starts][np.cumsum(fresh) - 1]  # a group's name is its first place
        size = np.diff(np.append(starts, len(active)))
        active = active[np.repeat(size, size) > 1]
        active = active[at[active] < depth]
    return order, group


class BlindTrie:
    """A trie of equally long strings with branching positions only; equal strings share a leaf."""

    def __init__(self, first: bytes, row: int):
        self.root: list = [None, first, [row]]  # leaf: [None, string, rows]; inner node: [position, {byte: node}]

    def insert(self, s: bytes, row: int) -> None:
        node = self.root
        while node[0] is not None:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        known = node[1]
        if known == s:
            node[2].append(row)
            return
        differ = int.from_bytes(known, "big") ^ int.from_bytes(s, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        leaf = [None, s, [row]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
        else:
            node[:] = [depth, {known[depth]: node[:], s[depth]: leaf}]

    def groups(self):
        """The rows of each distinct string, in byte order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def deep_shallow_sort(rows: np.ndarray, shallow: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the rows in byte order, and for each place whether it begins a group of equal rows."""
    n = len(rows)
    order, group = multikey_quicksort(_words(rows[:, : 8 * shallow]), shallow)
    first = np.ones(n, bool)
    if n < 2:
        return order, first
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    # Groups whose rows are all equal to their first need no trie
    ahead = order[np.repeat(starts, sizes)]
    for i in range(0, n, 1 << 16):
        first[i : i + (1 << 16)] = (rows[order[i : i + (1 << 16)]] != rows[ahead[i : i + (1 << 16)]]).any(axis=1)
    mixed = np.logical_or.reduceat(first, starts)
    first[starts] = True
    for start, size in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
        first[start + 1 : start + size] = True
        members = order[start : start + size].tolist()
        trie = BlindTrie(rows[members[0]].tobytes(), members[0])
        for row in members[1:]:
            trie.insert(rows[row].tobytes(), row)
        place = start
        for equal in trie.groups():
            order[place : place + len(equal)] = equal
            first[place + 1 : place + len(equal)] = False
            place += len(equal)
    return order, first
