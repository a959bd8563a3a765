"""Texts of one length as levels of letters, searched for the longest common subsequence with many patterns at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np


def points(texts: list[str]) -> np.ndarray:
    """The letters of all texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Different texts of one length, in order, each with a value; a search returns the least value of the best texts.

    A level has a node for each prefix. ``merged``: prefixes with the same ends
    are one node, so searches share their states too; values must then rise with the texts.
    """

    #: States that are taken through a level at once.
    MOST = 1 << 18

    def __init__(self, texts: list[str], values: np.ndarray, merged: bool):
        self.size, self.values, self.merged = len(texts[0]), np.asarray(values), merged
        letters = points(texts).reshape(len(texts), self.size)
        self.known = np.unique(letters)
        self.codes = np.searchsorted(self.known, letters).astype(np.int32)

    @cached_property
    def levels(self) -> list[tuple]:
        """For each level: of a node its first arc and how many; of an arc its letter, the next node, and how many texts of the node stand before."""
        count, out = len(self.codes), [()] * self.size
        new = np.zeros((self.size + 1, count), bool)
        new[:, 0] = True
        for d in range(self.size):
            new[d + 1, 1:] = new[d, 1:] | (self.codes[1:, d] != self.codes[:-1, d])
        ends = np.flatnonzero(new[self.size])
        node, nodes = (np.zeros(len(ends), np.int64), 1) if self.merged else (np.arange(len(ends)), len(ends))
        for d in range(self.size - 1, -1, -1):
            starts = np.flatnonzero(new[d])
            first = np.searchsorted(ends, starts)
            many = np.diff(np.append(first, len(ends)))
            letter, off = self.codes[ends, d], ends - np.repeat(starts, many)
            if self.merged:
                arc = letter.astype(np.int64) * nodes + node
                here, kept = np.zeros(len(starts), np.int64), []
                lone = np.flatnonzero(many == 1)
                _, at, to = np.unique(arc[first[lone]], return_index=True, return_inverse=True)
                kept += lone[at].tolist()
                here[lone] = to
                seen: dict[bytes, int] = {}
                for i in np.flatnonzero(many > 1).tolist():
                    key = arc[first[i] : first[i] + many[i]].tobytes()
                    if key not in seen:
                        seen[key] = len(kept)
                        kept.append(i)
                    here[i] = seen[key]
                kept = np.array(kept, np.int64)
            else:
                here = kept = np.arange(len(starts))
            own = many[kept]
            arcs = np.repeat(first[kept] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            out[d] = (np.cumsum(own) - own, own, letter[arcs], node[arcs], off[arcs], nodes)
            ends, node, nodes = starts, here, len(kept)
        return out

    def search(self, patterns: list[str], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, value) for each pattern of at most 64 letters: the longest common subsequence with a text and the least value of texts that have it; (-1, 0) if it is shorter than ``need``."""
        size = np.array([len(p) for p in patterns])
        need = need.astype(np.int64)
        letters, owner = points(patterns), np.repeat(np.arange(len(patterns)), size)
        at = np.minimum(np.searchsorted(self.known, letters), len(self.known) - 1)
        bits = np.uint64(1) << (np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        has = self.known[at] == letters
        masks = np.zeros((len(patterns), len(self.known)), np.uint64)
        np.bitwise_or.at(masks, (owner[has], at[has]), bits[has])
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - size).astype(np.uint64)
        # letters that may still be in common from a level on
        stands = np.zeros((len(self.known), self.size), np.float32)
        for d in range(self.size):
            stands[np.unique(self.codes[:, d]), d] = 1
        rest = np.zeros((len(patterns), self.size + 1), np.int64)
        rest[:, :-1] = np.cumsum((((masks != 0).astype(np.float32) @ stands) > 0)[:, ::-1], axis=1)[:, ::-1]
        best, value = np.full(len(patterns), -1), np.zeros(len(patterns), np.int64)
        job = np.flatnonzero(np.minimum(rest[:, 0], size) >= need)
        zeros = np.zeros(len(job), np.int64)
        stack = [(0, job, zeros, full[job], zeros)]
        while stack:
            d, job, node, s, text = stack.pop()
            while d < self.size and len(job):
                if len(job) > self.MOST:
                    half = len(job) // 2
                    stack.append((d, job[half:], node[half:], s[half:], text[half:]))
                    job, node, s, text = job[:half], node[:half], s[:half], text[:half]
                first, many, letter, to, off, nodes = self.levels[d]
                own = many[node]
                arc = first[node]
                if own.max() > 1:
                    again = np.repeat(np.arange(len(job)), own)
                    arc = arc[again] + np.arange(len(again)) - np.repeat(np.cumsum(own) - own, own)
                    job, s, text = job[again], s[again], text[again]
                u = s & masks[job, letter[arc]]
                s = ((s + u) | (s - u)) & full[job]
                text, node, d = text + off[arc], to[arc], d + 1
                keep = size[job] - np.bitwise_count(s).astype(np.int64) + rest[job, d] >= need[job]
                if not keep.all():
                    job, node, s, text = job[keep], node[keep], s[keep], text[keep]
                if self.merged and len(letter) > nodes and len(job) > 1:
                    job, node, s, text = self._once(job, node, s, text, nodes, int(size.max()))
            if len(job):
                got, own = size[job] - np.bitwise_count(s).astype(np.int64), self.values[text]
                order = np.lexsort((own, -got, job))
                order = order[np.append(True, job[order][1:] != job[order][:-1])]
                job, got, own = job[order], got[order], own[order]
                over = (got > best[job]) | (got == best[job]) & (own < value[job])
                best[job[over]], value[job[over]] = got[over], own[over]
                need = np.maximum(need, best)
        return best, value

    @staticmethod
    def _once(job: np.ndarray, node: np.ndarray, s: np.ndarray, text: np.ndarray, nodes: int, bits: int) -> tuple:
        """States that are alike once, with the first text."""
        key = (job * nodes + node).astype(np.uint64)
        if int(key.max()).bit_length() + bits <= 64:
            key = key << np.uint64(bits) | s if bits < 64 else s
            order = np.argsort(key, kind="stable")
            differs = key[order][1:] != key[order][:-1]
        else:
            order = np.lexsort((s, key))
            differs = (key[order][1:] != key[order][:-1]) | (s[order][1:] != s[order][:-1])
        at = np.flatnonzero(np.append(True, differs))
        first = order[at]
        return job[first], node[first], s[first], np.minimum.reduceat(text[order], at)
