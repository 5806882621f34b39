"""Retrievers as objects: fitted on documents, they search queries. Everything they hold is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from polyvec.functions.text import STOP_WORDS
from polyvec.operators import encode, scoring
from polyvec.operators.rank import top_k


class Bm25:
    """BM25 over ``(id, text)``."""

    def __init__(self, k1: float = 1.2, b: float = 0.75, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = False) -> None:
        self.k1, self.b, self.stop_words, self.stemmed = k1, b, stop_words, stemmed

    def fit(self, texts: DataFrame) -> Bm25:
        self.index = encode.bm25_index(texts, self.k1, self.b, self.stop_words, self.stemmed)
        return self

    def encode(self, texts: DataFrame) -> DataFrame:
        return encode.bm25_queries(texts, self.stop_words, self.stemmed)

    def search(self, texts: DataFrame, k: int = 100) -> DataFrame:
        return top_k(scoring.sparse_topk(self.encode(texts), self.index, k), k)


class Smve:
    """Anchor-sparse encodings of token bags ``(id, pos, vec)``."""

    def __init__(self, width: int = 256, k: int = 8, reps: int = 1, seed: int = 0, dim: int = 64, center: bool = False) -> None:
        self.width, self.k, self.reps, self.seed, self.dim, self.center, self.mean = width, k, reps, seed, dim, center, None

    def _moved(self, bags: DataFrame) -> DataFrame:
        return encode.centred(bags, self.mean) if self.center else bags

    def fit(self, bags: DataFrame) -> Smve:
        self.mean = encode.mean_vector(bags) if self.center else None
        self.index = encode.smve_encode(self._moved(bags), self.width, self.k, self.reps, "document", self.seed, self.dim)
        return self

    def encode(self, bags: DataFrame) -> DataFrame:
        return encode.smve_encode(self._moved(bags), self.width, self.k, self.reps, "query", self.seed, self.dim)

    def search(self, bags: DataFrame, k: int = 100) -> DataFrame:
        return top_k(scoring.sparse_topk(self.encode(bags), self.index, k), k)


class Muvera:
    """Fixed-dimensional encodings of token bags."""

    def __init__(self, reps: int = 20, bits: int = 5, proj: int = 16, seed: int = 0, dim: int = 64) -> None:
        self.reps, self.bits, self.proj, self.seed, self.dim = reps, bits, proj, seed, dim

    @property
    def size(self) -> int:
        return self.reps * (1 << self.bits) * self.proj

    def _terms(self, bags: DataFrame, role: str) -> DataFrame:
        return encode.fde_terms(encode.fde_encode(bags, self.reps, self.bits, self.proj, role, self.seed, self.dim), self.bits, self.proj)

    def fit(self, bags: DataFrame) -> Muvera:
        self.index = self._terms(bags, "document")
        return self

    def encode(self, bags: DataFrame) -> DataFrame:
        return self._terms(bags, "query")

    def search(self, bags: DataFrame, k: int = 100) -> DataFrame:
        return top_k(scoring.sparse_topk(self.encode(bags), self.index, k), k)


class MaxSim:
    """Exact late interaction of token bags."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def fit(self, bags: DataFrame) -> MaxSim:
        self.index = bags
        return self

    def search(self, bags: DataFrame, k: int = 100) -> DataFrame:
        return top_k(scoring.maxsim_scores(bags, self.index, k, dim=self.dim), k)

    def rescore(self, bags: DataFrame, pairs: DataFrame) -> DataFrame:
        """Scores of listed pairs, for a reranker."""
        return scoring.maxsim_relational(bags, self.index, pairs)
