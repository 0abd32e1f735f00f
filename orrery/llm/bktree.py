"""BK-trees over 64-bit fingerprints, many at a time.

A node's children are keyed by their Hamming distance to it, one child a distance. A question at distance d from a node
follows only the edges from d - radius to d + radius; no other child can lead to a member within the radius. Trees lie
flat in arrays, and all members of all trees move down together, a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Steps of questions that are taken together.
PIECE = 1 << 18
#: Members from which on a tree's questions come in blocks of so many, and skip what they are joined with already.
BIG, BLOCK = 512, 256


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels once a[i] and b[i] are joined for all i; a label is the smallest place of its group."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links a[i]-b[i] join: one from each node but the smallest of its group, to that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merge(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


class Trees:
    """``fp``: members' fingerprints (uint64), the members of a tree together, its root first; ``node``: what a member
    stands for (int64); ``tree``: its tree's number, 0, 1, ..."""

    def __init__(self, fp: np.ndarray, node: np.ndarray, tree: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.fp, self.node, self.tree, self.parent, self.edge = fp, node, tree, parent, edge
        self.start = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.empty(0, np.int64)
        self.size = np.diff(np.concatenate([self.start, [len(tree)]]))
        self.child = np.lexsort((edge, parent))[len(self.start) :]  # by parent; roots, of parent -1, come first
        self.first = np.searchsorted(parent[self.child], np.arange(len(fp) + 1))
        self.followed = 0  # edges that questions have followed

    @staticmethod
    def build(fp: np.ndarray, node: np.ndarray, tree: np.ndarray) -> Trees:
        """Members come by tree; each goes down from the root until it is the first at its distance."""
        n = len(fp)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int16)
        grown = Trees(fp, node, tree, parent, edge)
        at = np.repeat(grown.start, grown.size)
        left = np.delete(np.arange(n), grown.start)
        while len(left):
            d = distances(fp[left], fp[at[left]]).astype(np.int64)
            _, first, which = np.unique(at[left] * 65 + d, return_index=True, return_inverse=True)
            child = left[first]
            parent[child], edge[child] = at[child], d[first]
            at[left] = child[which]
            left = left[at[left] != left]
        return Trees(fp, node, tree, parent, edge)

    def depths(self, members: slice) -> np.ndarray:
        """Of one tree's members: the root has 0."""
        up, out = self.parent[members] - members.start, np.zeros(members.stop - members.start, np.int64)
        up[0] = 0
        at = np.arange(len(up))
        while (at := up[at]).any():
            out += at != 0
        out[1:] += 1
        return out

    def search(self, fp: np.ndarray, tree: np.ndarray, radius: int, mine: np.ndarray | None = None, whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, member) within the radius, in pieces; ``tree``: the tree that a question asks. A member under whom
        all is labelled as the question's own label (``whole``, ``mine``) is passed over."""
        stack = [(np.arange(len(fp)), self.start[tree])]
        while stack:
            q, at = stack.pop()
            if len(q) > PIECE:
                stack.append((q[PIECE:], at[PIECE:]))
                q, at = q[:PIECE], at[:PIECE]
            if whole is not None:
                new = whole[at] != mine[q]
                q, at = q[new], at[new]
            d = distances(fp[q], self.fp[at]).astype(np.int16)
            near = d <= radius
            if near.any():
                yield q[near], at[near]
            n = self.first[at + 1] - self.first[at]
            each = np.repeat(np.arange(len(q)), n)
            child = self.child[np.arange(len(each)) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)]
            within = np.abs(self.edge[child] - d[each]) <= radius
            if within.any():
                stack.append((q[each[within]], child[within]))
                self.followed += int(within.sum())

    def linked(self, fp: np.ndarray, node: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Stars that join what the links within the radius join, between questions (``fp``, ``node``, the tree each
        asks) and members."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, big = 0, self.size[tree] >= BIG if len(tree) else np.empty(0, bool)
        few = np.flatnonzero(~big)
        for q, at in self.search(fp[few], tree[few], radius):
            a, b = node[few[q]], self.node[at]
            held.append((a[a != b], b[a != b]))
            n += len(held[-1][0])
            if n > 1 << 22:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
        for t in np.unique(tree[big]):
            held.append(self._linked_in(int(t), fp, node, np.flatnonzero(big & (tree == t)), radius))
        return stars(*map(np.concatenate, zip(*held, strict=True))) if held else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _linked_in(self, t: int, fp: np.ndarray, node: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A large tree: after each block of questions, branches that are of one group are known, and later questions
        of that group do not enter them."""
        own = slice(int(self.start[t]), int(self.start[t] + self.size[t]))
        depth = self.depths(own)
        levels = [np.flatnonzero(depth == k) + own.start for k in range(int(depth.max()), 0, -1)]
        nodes, at = np.unique(np.concatenate([self.node[own], node[asked]]), return_inverse=True)
        of_member, of_asked = at[: own.stop - own.start], at[own.stop - own.start :]
        label, whole = np.arange(len(nodes)), np.full(len(self.fp), -1, np.int64)
        for i in range(0, len(asked), BLOCK):
            some, mine = asked[i : i + BLOCK], of_asked[i : i + BLOCK]
            whole[own] = label[of_member]
            for level in levels:
                above = self.parent[level]
                whole[above[whole[level] != label[of_member[above - own.start]]]] = -1
            for q, m in self.search(fp[some], np.full(len(some), t), radius, label[mine], whole):
                label = merge(label, mine[q], of_member[m - own.start])
        out = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[out], nodes[label[out]]
