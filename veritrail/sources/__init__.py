"""Sources: tables, text folders, documents, annotations, category words."""

from .tables import checks, chunks, documents, gold, ref_docs, table, verdicts, words

__all__ = ["checks", "chunks", "documents", "gold", "ref_docs", "table", "verdicts", "words"]
