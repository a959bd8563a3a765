"""Fuzzy best-match join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import weighted_ratio
from ..shared import cut, ship
from .letters import Letters

#: Choices of a block and their letters; names of a block, and those that are looked up together.
BLOCK, LETTERS, NAMES, AT_ONCE = 1 << 18, 1 << 23, 1 << 14, 512
#: Patterns up to so many letters are held in one machine word.
WORD = 64


class Texts:
    """Texts of one length as patterns and as rows of letters, for the common subsequences of all of them with one text."""

    def __init__(self, texts: list[str]):
        self.size, self.count = len(texts[0]), len(texts)
        letters = np.array([[ord(c) for c in t] for t in texts], np.int64).reshape(self.count, self.size)
        self.known = np.unique(letters)
        self.codes = np.searchsorted(self.known, letters)
        self.none = np.zeros(self.count, np.uint64)
        self.masks: dict[int, np.ndarray] = {}
        if 0 < self.size <= WORD:
            for c in self.known.tolist():
                at = (letters == c).astype(np.uint64) << np.arange(self.size, dtype=np.uint64)
                self.masks[c] = at.sum(1, dtype=np.uint64)

    def _steps(self, x: str, turned: bool) -> tuple[list[np.ndarray], int]:
        """For each letter of the text its places in the pattern, and the pattern's length; turned: ``x`` is the pattern."""
        if not turned:
            return [self.masks.get(ord(c), self.none) for c in x], self.size
        own: dict[int, int] = {}
        for i, c in enumerate(x):
            own[ord(c)] = own.get(ord(c), 0) | 1 << i
        at = np.array([own.get(c, 0) for c in self.known.tolist()], np.uint64)
        return [at[self.codes[:, j]] for j in range(self.size)], len(x)

    @staticmethod
    def _common(s: np.ndarray, n: int) -> np.ndarray:
        return n - np.bitwise_count(s & np.uint64((1 << n) - 1)).astype(np.int64)

    def ratio(self, x: str) -> np.ndarray:
        """``similarity.ratio`` of ``x`` with each text; the shorter one has at most ``WORD`` letters."""
        if not x or not self.size:
            return np.full(self.count, 0.0 if x or self.size else 100.0)
        steps, n = self._steps(x, len(x) < self.size)
        s = np.full(self.count, ~np.uint64(0))
        for m in steps:
            u = s & m
            s = (s + u) | (s - u)
        return 200.0 * self._common(s, n) / (self.size + len(x))

    def partial(self, x: str) -> np.ndarray:
        """``similarity.partial_ratio`` of ``x`` with each text, as ``ratio``."""
        if not x or not self.size:
            return np.full(self.count, 0.0 if x or self.size else 100.0)
        if len(x) == self.size:
            return np.maximum(self._windows(x, False), self._windows(x, True))
        return self._windows(x, len(x) < self.size)

    def _windows(self, x: str, turned: bool) -> np.ndarray:
        """The best ratio of the pattern with a window of the text; a row of ``s`` for each window that is open."""
        steps, n = self._steps(x, turned)
        best = np.zeros(self.count)
        s = np.empty((n, self.count), np.uint64)
        for j, m in enumerate(steps):
            s[j % n] = ~np.uint64(0)
            own = s[: j + 1]
            u = own & m
            s[: j + 1] = (own + u) | (own - u)
            # the window that ends here: cut off at the text's start, or whole
            size = min(j + 1, n)
            np.maximum(best, 200.0 * self._common(s[(j + 1) % n] if size == n else s[0], n) / (n + size), out=best)
        for i in range(max(1, len(steps) - n + 1), len(steps)):  # cut off at its end
            np.maximum(best, 200.0 * self._common(s[i % n], n) / (n + len(steps) - i), out=best)
        return best


def _forms(text: str) -> tuple[str, str, str]:
    """As it is, with sorted tokens, with sorted distinct tokens."""
    t = text.split()
    ordered, once = " ".join(sorted(t)), " ".join(sorted(set(t)))
    ordered = text if ordered == text else ordered
    return text, ordered, ordered if once == ordered else once


class Group:
    """Choices whose forms have the same lengths, by rank."""

    def __init__(self, ranks: list[int], forms: list[tuple], sizes: tuple, same1: bool, same2: bool):
        self.ranks, self.forms, self.sizes, self.same1, self.same2 = np.array(ranks), forms, sizes, same1, same2

    @cached_property
    def texts(self) -> list[Texts]:
        whole = Texts([f[0] for f in self.forms])
        ordered = whole if self.same1 else Texts([f[1] for f in self.forms])
        return [whole, ordered, ordered if self.same2 else Texts([f[2] for f in self.forms])]

    @cached_property
    def whole(self) -> Letters:
        return Letters([f[0] for f in self.forms], self.ranks, True)

    @cached_property
    def ordered(self) -> Letters:
        """Of sorted tokens, which are not in the order of the choices."""
        if self.same1:
            return self.whole
        least: dict[str, int] = {}
        for f, k in zip(self.forms, self.ranks.tolist()):
            least.setdefault(f[1], k)
        return Letters(sorted(least), np.array([least[t] for t in sorted(least)]), False)

    def scale(self, n: int) -> tuple[bool, float]:
        """Whether a name of ``n`` letters is compared by windows, and their factor."""
        lengths = max(n, self.sizes[0]) / min(n, self.sizes[0])
        return lengths >= 1.5, (0.9 if lengths <= 8 else 0.6) if lengths >= 1.5 else 1.0

    def bound(self, n: int) -> float:
        """No choice scores more with a name of ``n`` letters."""
        if not self.sizes[0]:
            return 0.0
        far, scale = self.scale(n)
        return max(200.0 * min(n, self.sizes[0]) / (n + self.sizes[0]), 100.0 * scale if far else 95.0)

    def paired(self, forms: tuple) -> bool:
        """Whether texts are too long for a machine word."""
        return any(min(len(f), n) > WORD for f, n in zip(forms, self.sizes))

    def listed(self, forms: tuple, far: bool) -> bool:
        """Whether all choices are scored: forms that a search does not tell apart, and windows of choices."""
        f1, f2 = forms[1:]
        return not all(map(len, forms)) or not all(self.sizes) or max(map(len, forms)) > WORD or max(self.sizes) > WORD or f1 != f2 or not self.same2 or far and any(len(f) <= n for f, n in zip(forms, self.sizes))


class Choices:
    """``weighted_ratio`` of names with many choices at once."""

    #: Scores that are asked for, one after the other: a search for less than the best score of a name is not begun.
    FROM = (95.0, 85.0, 70.0, 55.0, 40.0, 20.0, 0.0)

    def __init__(self, choices: list[str]):
        self.choices = sorted(choices)
        alike: dict[tuple, tuple] = {}
        self.having: dict[str, list[int]] = {}
        self.group_of = np.zeros(len(choices), np.int64)
        for k, c in enumerate(self.choices):
            forms = _forms(c)
            key = (tuple(map(len, forms)), forms[1] == c, forms[1] == forms[2])
            own = alike.setdefault(key, (len(alike), [], []))
            self.group_of[k] = own[0]
            own[1].append(k)
            own[2].append(forms)
            for t in set(c.split()):
                self.having.setdefault(t, []).append(k)
        self.groups = [Group(ranks, forms, *key) for key, (_, ranks, forms) in alike.items()]

    def best(self, x: str) -> tuple[float, str | None]:
        """The best score and its choice, the first by text of equals."""
        return self.best_of([x])[0]

    def best_of(self, names: list[str]) -> list[tuple[float, str | None]]:
        """``best`` of each name.

        Scores of common subsequences of forms are looked for from high to low:
        a name is done when its best score is as high as what was asked for,
        since then no choice with that score or more is left out.
        """
        best = [(-1.0, 0)] * len(names)

        def meet(i: int, score: float, rank: int) -> None:
            if score > best[i][0] or score == best[i][0] and rank < best[i][1]:
                best[i] = score, rank

        forms = [_forms(x) for x in names]
        shared = [sorted({k for t in set(x.split()) for k in self.having.get(t, ())}) for x in names]
        left, begun, done = [i for i, x in enumerate(names) if x and self.choices], set(), set()
        for least in self.FROM:
            for g, group in enumerate(self.groups):
                asked: dict[bool, dict[str, list]] = {False: {}, True: {}}
                for i in left:
                    wanted = max(least, best[i][0])
                    if (i, g) in done or group.bound(len(names[i])) < wanted:
                        continue
                    if (i, g) not in begun:
                        begun.add((i, g))
                        if self._met(i, g, group, names[i], forms[i], shared[i], meet):
                            done.add((i, g))
                            continue
                    self._ask(i, group, forms[i], wanted, asked)
                for ordered, jobs in asked.items():
                    if jobs:
                        found, ranks = (group.ordered if ordered else group.whole).search(list(jobs), np.array([min(j[2] for j in own) for own in jobs.values()]))
                        for (p, own), size, rank in zip(jobs.items(), found.tolist(), ranks.tolist()):
                            if size >= 0:
                                for i, f, _ in own:
                                    meet(i, f * (200.0 * size / (group.sizes[ordered] + len(p))), rank)
            left = [i for i in left if best[i][0] < least]
        return [(b[0], self.choices[b[1]]) if x and self.choices else (0.0, min(self.choices, default=None)) for x, b in zip(names, best)]

    def _met(self, i: int, g: int, group: Group, x: str, forms: tuple, shared: list[int], meet) -> bool:
        """Scores choices of a group that no search scores; whether that were all of them."""
        if not group.sizes[0]:
            meet(i, 0.0, int(group.ranks[0]))
            return True
        if group.paired(forms):
            for k in group.ranks.tolist():  # too long for a machine word
                meet(i, weighted_ratio(x, self.choices[k]), k)
            return True
        far, scale = group.scale(len(x))
        own = [k for k in shared if self.group_of[k] == g]
        if not group.listed(forms, far):
            if far and own:
                meet(i, 0.95 * scale * 100.0, own[0])
            else:
                for k in own:  # tokens in common and about as long
                    meet(i, weighted_ratio(x, self.choices[k]), k)
            return False
        texts, at = group.texts, np.isin(group.ranks, own)
        score = texts[0].ratio(x)
        if far:
            tokens = np.where(at, 100.0, 0.0) if at.all() else np.where(at, 100.0, np.maximum(*self._each(Texts.partial, forms, texts)))
            score = np.maximum(np.maximum(score, scale * texts[0].partial(x)), 0.95 * scale * tokens)
        else:
            score = np.maximum(score, 0.95 * np.maximum(*self._each(Texts.ratio, forms, texts)))
            for j in np.flatnonzero(at):
                score[j] = weighted_ratio(x, self.choices[group.ranks[j]])
        meet(i, float(score.max()), int(group.ranks[score.argmax()]))
        return True

    @staticmethod
    def _ask(i: int, group: Group, forms: tuple, least: float, asked: dict) -> None:
        """Adds what is to be searched for a name: pattern to (name, factor, least length), by whether choices are sorted by token."""
        far, scale = group.scale(len(forms[0]))

        def ask(ordered: bool, p: str, f: float) -> None:
            need = max(0, math.ceil(least * (group.sizes[ordered] + len(p)) / (200.0 * f) - 1e-9))
            if need <= min(len(p), group.sizes[ordered]):
                asked[ordered].setdefault(p, []).append((i, f, need))

        ask(False, forms[0], 1.0)
        for ordered, p, f in ((False, forms[0], scale), (not group.same1, forms[1], 0.95 * scale)):
            if far:
                n = group.sizes[ordered]
                least_size = n * least / max(200.0 * f - least, 1e-9) - 1e-6  # a shorter window cannot do
                for w in {p[max(0, k) : k + n] for k in range(1 - n, len(p)) if min(k + n, len(p)) - max(0, k) >= least_size}:
                    ask(ordered, w, f)
            elif f < 1.0:
                ask(ordered, p, f)

    @staticmethod
    def _each(kind, forms: tuple, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores of sorted tokens and of sorted distinct ones."""
        first = kind(texts[1], forms[1])
        return first, first if forms[1] == forms[2] and texts[1] is texts[2] else kind(texts[2], forms[2])


def fuzzy_best_match(rows: DataFrame, name: str, choices: DataFrame, choice: str, threshold: float = 85.0) -> DataFrame:
    """``rows`` with match_method, match_score and matched (the choice).

    missing: no name; exact: a choice is the same string (score 100); fuzzy: the
    best choice scores at least ``threshold``; unmatched: it does not, the score
    is kept. Of equal scores the first choice by its text wins.

    Exact matches are an equi-join. Only the distinct names that are left are
    looked up: blocks of names meet blocks of choices, ``BLOCK`` of them or
    ``LETTERS`` letters that follow each other by text, and a name is searched
    for in all choices of a block at once. Neither side is collected, and a name
    returns one row for a block.
    """
    spark = rows.sparkSession
    ship(spark)
    known = choices.where(F.col(choice).isNotNull()).select(F.col(choice).alias("__choice")).distinct()
    out = rows.join(known, F.col(name) == F.col("__choice"), "left")
    rest = cut(out.where(F.col("__choice").isNull() & F.col(name).isNotNull()).select(F.col(name).alias("__name")).distinct())
    known = cut(known)
    n, letters = known.agg(F.count("*"), F.coalesce(F.sum(F.length("__choice")), F.lit(0))).first()
    parts, tasks = max(1, -(-n // BLOCK), -(-letters // LETTERS)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts > 1:
        known = cut(known.repartitionByRange(parts, "__choice").withColumn("b__block", F.spark_partition_id()))
    else:
        known = known.withColumn("b__block", F.lit(0))
    blocks = known.groupBy("b__block").agg(F.collect_list("__choice").alias("__block"))
    # two pairs of blocks a task, as far as there are names enough to outweigh the reading of a block of choices
    many = rest.count()
    many = max(1, -(-many // NAMES), min(many // max(64, min(n, BLOCK) // 32), -(-2 * tasks // parts)))
    names = rest.groupBy(F.pmod(F.xxhash64("__name"), F.lit(many)).alias("b__names")).agg(F.sort_array(F.collect_list("__name")).alias("__names"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for b in batches:
            for names, block, k in zip(b["__names"], b["__block"], b["b__block"]):
                if k != key:
                    key, held = k, Choices(list(block))
                for lo in range(0, len(names), AT_ONCE):
                    own = list(names[lo : lo + AT_ONCE])
                    yield pd.DataFrame([(x, *y) for x, y in zip(own, held.best_of(own))], columns=["__name", "__score", "__best"])

    # a pair of blocks is much work, so few pairs are not put into one task; sorted, so that a block is read once
    pairs = names.crossJoin(blocks).repartition(tasks).sortWithinPartitions("b__block")
    scored = pairs.select("__names", "__block", "b__block").mapInPandas(best, "__name string, __score double, __best string")
    # most score, then least text
    top = scored.groupBy("__name").agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__best").alias("c"))).alias("t"))
    out = out.join(top, F.col(name) == F.col("__name"), "left")
    score = F.when(F.col("__choice").isNotNull(), F.lit(100.0)).otherwise(-F.col("t.s"))
    method = F.when(F.col(name).isNull(), "missing").when(F.col("__choice").isNotNull(), "exact").when(score >= threshold, "fuzzy").otherwise("unmatched")
    matched = F.when(F.col("__choice").isNotNull(), F.col("__choice")).when(score >= threshold, F.col("t.c"))
    return out.select(*[F.col(c) for c in rows.columns], method.alias("match_method"), score.alias("match_score"), matched.alias("matched"))
