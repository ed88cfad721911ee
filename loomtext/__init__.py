"""loomtext: retrieval-style analytics over document collections, native to PySpark.

The flow is corpus, chunk, enrich, filter, select; every step is a lazy DataFrame.
"""

from .core import AtomAggregate, Atoms, AttrExpr, ChunkExpr, ChunkFilter, Chunks, Corpus, Frame, Spans, TextScore
from .functions.index import TermIndex
from .functions.scoring import Tfidf
from .operators.chunkers import FixedSizeChunk, RegexMatchChunk
from .operators.exprs import AtomData, ChunkDelimitedStringify, ChunkOverlap, RegexCount, SimpleStringify
from .operators.filters import EqualTo, Threshold, TopK
from .sources.store import open_corpus, save_corpus
from .sources.tesseract import corpus_from_tesseract_documents, corpus_from_tesseract_table
from .sources.text import corpus_from_documents, corpus_from_rows

__all__ = ["AtomAggregate", "AtomData", "Atoms", "AttrExpr", "ChunkDelimitedStringify", "ChunkExpr", "ChunkFilter", "ChunkOverlap", "Chunks", "Corpus", "EqualTo", "FixedSizeChunk", "Frame", "RegexCount", "RegexMatchChunk", "SimpleStringify", "Spans", "TermIndex", "TextScore", "Tfidf", "Threshold", "TopK", "corpus_from_documents", "corpus_from_rows", "corpus_from_tesseract_documents", "corpus_from_tesseract_table", "open_corpus", "save_corpus"]
