"""Language identification by cross parsing against suffix automata."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SEGMENT = 1024
_BUILT: dict[str, Parser] = {}
base.cache("langid", lambda: len(_BUILT), _BUILT.clear)


def normal(text: str) -> str:
    """Lower case, each run of anything but letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


#: Bytes of the table of transitions by frequent letters; transitions by other letters are searched for.
DENSE = 64 << 20


class Parser:
    """Automata of all languages as one table: state and letter to next state and phrases that end.

    Code 0 is a space, 1 a letter that no sample holds, the rest are the letters
    of the samples, each with a code of its own. The most frequent ones, as many
    as fit ``DENSE`` bytes, have columns in the table; the transitions by the
    others stand in a sorted list of (state, code).
    """

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        self.langs = sorted(samples)
        letters = Counter("".join(samples.values()))
        letters.pop(" ", None)
        known = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        code = {" ": 0} | {c: i + 2 for i, c in enumerate(known)}
        total = sum(len(x) + 2 for x in samples.values())
        # an automaton has fewer than two states a letter
        self.size = 2 + min(len(known), max(16, dense // (8 * max(1, total))))
        self.lut = np.zeros(0x110000, np.uint8 if len(known) < 250 else np.int32)
        for c, i in code.items():
            self.lut[ord(c)] = i
        tables, self.start, at, keys, to_states = [], [], 0, [], []
        kind = np.int32 if 8 * self.size * total < 2**31 else np.int64
        for lang in self.langs:
            steps = suffix_automaton([code[c] for c in samples[lang]])
            root = np.full(self.size, at * 4 * self.size + 1, kind)  # an unknown letter is a phrase
            rows = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
            cols = np.fromiter((c for s in steps for c in s), np.int64, len(rows))
            to = np.fromiter((x for s in steps for x in s.values()), np.int64, len(rows)) + at
            often = cols < self.size
            first = often & (rows == 0)
            root[cols[first]] = to[first] * 4 * self.size
            t = np.tile(root + 1, (len(steps), 1))  # no way on: a phrase ends, the next starts here
            t[0] = root
            t[rows[often], cols[often]] = to[often] * 4 * self.size
            tables.append(t.ravel())
            keys.append(((rows[~often] + at) << 21) | cols[~often])
            to_states.append(to[~often])
            self.start.append(at * self.size)
            at += len(steps)
            del steps, rows, cols, t
        self.table = np.concatenate(tables) if tables else np.zeros(0, kind)
        keys, to_states = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, to_states))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to_states[order]
        self.bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.langs])

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Codes of the letters, runs of others as one 0; whether there is a letter."""
        u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.lut[u]
        odd = np.flatnonzero((c == 0) & (u > 127))
        if len(odd):
            values, where = np.unique(u[odd], return_inverse=True)
            c[odd] = np.array([chr(v).isalpha() for v in values], c.dtype)[where]
        odd = np.flatnonzero((c == 0) & (((u >= 97) & (u <= 122)) | ((u >= 65) & (u <= 90))))
        c[odd] = 1
        if not c.any():
            return c[:0], False
        return c[(c != 0) | np.concatenate(([False], c[:-1] != 0))], True

    def _rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Entries, as the table has them, of letters without a column; state is (languages, texts)."""

        def look(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (s.astype(np.int64) // self.size << 21) | code
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[at] == key, self.to[at] * 4 * self.size

        root = np.array(self.start)[:, None]
        on, to = look(state)
        again, first = look(np.broadcast_to(root, state.shape))
        inside = (state != root).astype(np.int64)
        return np.where(on, to, np.where(again, first, root * 4 + 1) + inside)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text, (texts, languages).

        All texts are parsed side by side, in segments of SEGMENT letters; a
        segment starts a new phrase, for every language alike.
        """
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        size = np.array([len(t) for t in texts])
        parts = -(-size // SEGMENT)
        if not parts.sum():
            return out
        data = np.concatenate(texts)
        of = np.repeat(np.arange(len(texts)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(size) - size, parts) + part * SEGMENT
        length = np.minimum(SEGMENT, size[of] - part * SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, of = start[order], length[order], of[order]
        live = np.searchsorted(-length, -np.arange(SEGMENT), "left")
        root = np.array(self.start, self.table.dtype)[:, None]
        state = np.tile(root, (1, len(of)))
        count = np.zeros(state.shape, np.int32)
        any_rare = len(self.keys) > 0 and int(data.max()) >= self.size
        for t in range(int(length[0])):
            k = live[t]
            c = data[start[:k] + t]
            if any_rare:
                rare = np.flatnonzero(c >= self.size)
                e = self.table[state[:, :k] + np.where(c < self.size, c, 1)]
                if len(rare):
                    e[:, rare] = self._rare(state[:, rare], c[rare].astype(np.int64))
            else:
                e = self.table[state[:, :k] + c]
            count[:, :k] += e & 3
            state[:, :k] = e >> 2
        count += state != root
        np.add.at(out, of, count.T)
        return out

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter by language (phrases times the bits of a pointer into the sample), and which texts have letters."""
        codes, any_letter = zip(*map(self.codes, texts)) if texts else ((), ())
        n = np.array([max(1, len(c)) for c in codes])
        return self.phrases(list(codes)) * self.bits / n[:, None], np.array(any_letter, bool)


def parser(samples: dict[str, str]) -> Parser:
    """The automata, built once in each Python worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser(samples)
    return _BUILT[key]


def learn(docs: DataFrame, train_chars: int = 40_000, doc_chars: int = 5_000, max_langs: int = 512, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """A sample of normalised text for each language of labelled ``docs``.

    The bounds: at most ``train_chars`` characters a language, out of the first
    ``doc_chars`` of distinct documents taken by a hash of id and text, and the
    ``max_langs`` languages with the most text. Rows whose text or language is
    null are left out. The driver gets about twice that many characters.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.substring(text_col, 1, doc_chars).alias("text"))
    chars = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(max_langs).collect()
    if not chars:
        return {}
    share = F.create_map(*[F.lit(x) for r in chars for x in (r.lang, min(1.0, 2 * train_chars / max(1, r.chars)))])
    at = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    sampled = labelled.withColumn("at", at).where(F.col("at") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))
    rows = sampled.select("lang", "at", "text").distinct().collect()
    out: dict[str, list[str]] = {r.lang: [] for r in chars}
    held: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r["at"], r.text)):
        t = normal(r.text)[: max(0, train_chars - held[r.lang])]
        if t:
            out[r.lang].append(t)
            held[r.lang] += len(t) + 1
    return {lang: " ".join(x) for lang, x in out.items() if x}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each whole text: that whose automaton needs the fewest normalised phrases.

    Returns all columns but lang_pred and score of their own, with lang_pred
    (``und`` for a null text, one without a letter, or if nothing was learned;
    the first by name of equals) and score: the share by which the next language
    needs more bits, 0 to 1; 1 if there is only one, 0 for ``und``. Ids may be
    null or repeat; other columns pass through unread.
    """
    base.ship(docs.sparkSession)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(samples)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*frame.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        base.claim("langid")
        p = parser(held.value) if held.value else None
        for b in base.slices(batches, text_col, 4 << 20):
            n = b.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            if p:
                rates, has = p.rates(base.strings(b.column(b.num_columns - 1)))
                best = rates.argmin(1)
                low = rates[np.arange(n), best]
                lang[has] = np.array(p.langs, object)[best[has]]
                if len(p.langs) > 1:
                    rates[np.arange(n), best] = np.inf
                    after = rates.min(1)
                    score[has] = ((after - low) / np.maximum(after, 1e-12))[has]
                else:
                    score[has] = 1.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter, by the rule of ``identify``; other columns pass through unread."""
    base.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in base.slices(batches, text_col, 4 << 20):
            yield b.filter(pa.array([any(map(str.isalpha, t.lower())) for t in base.strings(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that op2 may learn from."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
