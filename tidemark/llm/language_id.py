"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@functools.cache
def _class_of(kinds: str) -> str:
    """Characters whose general category starts with one of kinds, as ranges of a regular expression's set."""
    out, first = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] in kinds
        if inside and first is None:
            first = cp
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return "".join(out)


@functools.cache
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """What separates words, all but letters and their combining marks; and a letter."""
    return re.compile(f"[^{_class_of('LM')}]+"), re.compile(f"[{_class_of('L')}]")


#: The same for texts without the characters of _rare(), and much faster.
PLAIN_APART = re.compile(r"[\W\d_]+")


@functools.cache
def _rare() -> frozenset[str]:
    """Characters that PLAIN_APART takes for letters, or not, unlike their general category: combining marks, and numbers that aren't digits."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if (unicodedata.category(c)[0] in "LM") != (c.isalnum() and not c.isdecimal()))


def words_apart(text: str) -> str:
    """The words of a text in lower case, one space between them; empty without letters."""
    low = text.lower()
    if low.isascii() or _rare().isdisjoint(low):
        return PLAIN_APART.sub(" ", low).strip()
    apart, letter = _patterns()
    return apart.sub(" ", low).strip() if letter.search(low) else ""


#: Code points of a text that are handled at once.
SEGMENT = 1 << 18
PREDICTED = "doc_id bigint, lang_pred string, score double, und boolean"


class Encoder:
    """Bundles of bound n-gram vectors.

    A letter (or the space between words) has a random vector of +1 and -1, drawn from a generator seeded by
    its code point. A trigram's vector binds those of its letters, the first permuted twice and the second
    once (rotations by two places and one), by multiplication. A text's profile is the sum over its trigrams.
    """

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed, self.letters = dims, seed, {}

    def letter(self, cp: int) -> np.ndarray:
        v = self.letters.get(cp)
        if v is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, cp])).integers(0, 2, self.dims, dtype=np.int8)
            v = self.letters[cp] = (bits * 2 - 1).astype(np.int8)
        return v

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code, as float32."""
        a, b, c = (codes >> 42).astype(np.int64), ((codes >> 21) & 0x1FFFFF).astype(np.int64), (codes & 0x1FFFFF).astype(np.int64)
        seen, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        table = np.stack([self.letter(int(x)) for x in seen])
        n = len(codes)
        return (np.roll(table, 2, axis=1)[at[:n]] * np.roll(table, 1, axis=1)[at[n : 2 * n]] * table[at[2 * n :]]).astype(np.float32)

    def counts(self, texts: Sequence[str | None], rows: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, code, count) of the trigrams of texts, in portions of bounded size; rows says where each text's counts go."""
        held, owner, size = [], [], 0
        for row, text in zip(rows, texts, strict=True):
            s = f" {words_apart(text or '')} "
            if len(s) < 3:
                continue
            for i in range(0, len(s) - 2, SEGMENT):
                part = s[i : i + SEGMENT + 2]
                held.append(part)
                owner.append(row)
                size += len(part)
                if size >= SEGMENT:
                    yield self._portion(held, owner)
                    held, owner, size = [], [], 0
        if held:
            yield self._portion(held, owner)

    @staticmethod
    def _portion(parts: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = (cps[:-2] << np.uint64(42)) | (cps[1:-1] << np.uint64(21)) | cps[2:]
        ends = np.cumsum([len(p) for p in parts])
        inside = np.ones(len(codes), bool)
        for e in ends[:-1]:
            inside[max(0, e - 2) : e] = False  # these reach into the next text
        rows = np.repeat(np.asarray(owner), [len(p) for p in parts])[:-2]
        rows, codes = rows[inside], codes[inside]
        seen, at = np.unique(codes, return_inverse=True)
        key, count = np.unique(rows.astype(np.int64) * len(seen) + at, return_counts=True)
        return key // len(seen), seen[key % len(seen)], count

    def profiles(self, texts: Sequence[str | None], rows: Sequence[int], n: int) -> np.ndarray:
        """The n profiles to which the texts add up."""
        out = np.zeros((n, self.dims), np.float32)
        for row, code, count in self.counts(texts, rows):
            mine, local = np.unique(row, return_inverse=True)
            seen, at = np.unique(code, return_inverse=True)
            for s in range(0, len(seen), 4096):  # bounds the table of vectors
                part = (at >= s) & (at < s + 4096)
                width = min(4096, len(seen) - s)
                dense = np.zeros((len(mine), width), np.float32)
                dense[local[part], at[part] - s] = count[part]
                out[mine] += dense @ self.trigrams(seen[s : s + width])
        return out


@dataclass(frozen=True)
class Model:
    """Prototypes, a unit vector for each language."""

    langs: tuple[str, ...]
    prototypes: np.ndarray
    dims: int
    seed: int


def _bundle(dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dims, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo in range(0, len(langs), 256):
                texts = batch.column("text").slice(lo, 256).to_pylist()
                part = langs[lo : lo + 256]
                profiles = encoder.profiles(texts, range(len(texts)), len(texts))
                norms = np.linalg.norm(profiles, axis=1)
                for i in np.nonzero(norms)[0]:
                    # every document counts alike, however long
                    v = sums.setdefault(part[i], np.zeros(dims))
                    v += profiles[i] / norms[i]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "v"])

    return run


def train(docs: DataFrame, *, dims: int = 1024, seed: int = 7) -> Model:
    """Prototypes from docs (lang, text): the bundle of all documents of a language, each at unit length.

    Rows with a null lang or text, or a text without letters, add nothing. Each task bundles its own rows; what
    is summed over tasks and comes to the driver are `dims` numbers a language. Without any labelled text the
    model has no languages and predicts und.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    summed = labelled.mapInArrow(_bundle(dims, seed), "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v")))["v"].alias("v")).orderBy("lang").collect()
    vectors = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dims)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    return Model(tuple(r["lang"] for r in rows), vectors.astype(np.float32), dims, seed)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.dims, model.seed)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo in range(0, len(ids), 256):
                texts = batch.column("text").slice(lo, 256).to_pylist()
                profiles = encoder.profiles(texts, range(len(texts)), len(texts))
                norms = np.linalg.norm(profiles, axis=1)
                if model.langs:
                    cosines = profiles @ model.prototypes.T / np.maximum(norms, 1e-30)[:, None]
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
                else:
                    best, score = np.zeros(len(norms), int), np.zeros(len(norms))
                und = (norms == 0) | (not model.langs)
                pred = ["und" if u else model.langs[b] for u, b in zip(und, best, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array(pred), pa.array(np.where(und, 0.0, score)), pa.array(und)], names=["doc_id", "lang_pred", "score", "und"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, und) of docs (doc_id, text): the language whose prototype has the largest cosine, and that cosine.

    Only the whole text is looked at, however long, in segments of bounded size. Letters are those of Unicode with their combining marks; null and empty
    texts and texts without letters are und with score 0; of equal
    cosines the first language in code point order wins. Repeated rows get equal results, null doc_ids stay null, other columns are left out, and an
    empty table gives an empty one. The model, dims numbers a language, goes along with the tasks.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), PREDICTED)
