"""Fixed values and defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass

#: What an answer says when no quotation holds. A fixed value: evaluations compare it by equality.
REFUSAL_TEXT = "Je ne peux pas répondre à partir du corpus actuel."
RETRIEVAL_K, SELECTION_K, RETRIEVAL_MOST, QUOTES_MOST = 20, 8, 50, 4
SNIPPET_CHARS, SPAN_CHARS, SLUG_CHARS = 500, 400, 80

# The grammar of references at the end of a quotation, which stored answers follow. A label, "Ch. n" with what comes after it, a file name.
REFERENCE_LABEL = r"[A-Za-z][\w\s\-]{0,80},\s*"
REFERENCE_CHAPTER = r"(?:Ch\.|Chapter)\s*\d+.*$"
REFERENCE_FILE = r"[a-z0-9][a-z0-9._-]*\.(?:txt|md|pdf)\s*,?\s*"


@dataclass(frozen=True)
class Corpus:
    """A corpus that questions can be asked of. One without a store is not listed."""

    corpus_id: str
    label: str
    store: str = ""
    data_dir: str = "data"
    reference_label: str = "Source"
    retrieval_k: int = RETRIEVAL_K
    selection_k: int = SELECTION_K


class Registry:
    """Corpora in the order of registration; the first listed one is the default."""

    def __init__(self, *corpora: Corpus):
        self._all = {c.corpus_id: c for c in corpora}

    def list(self) -> list[Corpus]:
        return [c for c in self._all.values() if c.store]

    def get(self, corpus_id: str) -> Corpus:
        found = next((c for c in self.list() if c.corpus_id == corpus_id), None)
        if found is None:
            raise KeyError(f"unknown corpus: {corpus_id}")
        return found

    def default(self) -> Corpus:
        return self.list()[0]

    def table(self, spark):
        schema = "corpus_id string, label string, store string, data_dir string, reference_label string, retrieval_k int, selection_k int"
        return spark.createDataFrame([tuple(vars(c).values()) for c in self.list()], schema)
