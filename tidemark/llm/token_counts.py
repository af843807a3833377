"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word; dynamic programming carries
the best score and the number of pieces, and no path is kept. Ties go as in the tokenizers library: of equal scores the
piece that starts first (the longest) wins; a character that no single piece covers is unknown, at the lowest score less
ten, and costs its bytes where the vocabulary has byte pieces, else one piece for each unbroken run.

The vocabulary is any list of pieces and scores. The query takes the pieces of ``piece_bpe_32k.model``, whose scores are the
order of its merges, and reads them as unigram scores: its ``n_unigram_tokens`` is what the tokenizers library's Unigram
model counts with that vocabulary, and not what the model's own merging would give. (Tokenizers are not trained here, and no
public unigram vocabulary is at hand.)

Text is split as the library's Metaspace does it: a word mark for each space and one before the text; a piece never
spans two words, so counts of words that come again are remembered (within a bound).

Defined cases: a null or empty text has no tokens; texts of any length are counted whole; repeated rows, rows
of one doc_id and rows without one are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, map_rows, resident, table, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 400_000


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool, memory: int = MEMORY):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.known = Memory(memory)

    def word(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, open_run = [0] * (n + 1), [False] * (n + 1)
        ending: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ending[end].append(match)
        for end in range(1, n + 1):
            top, pieces, run = None, 0, False
            for length, score in sorted(ending[end - 1], reverse=True):  # the earliest start first
                before = best[end - length]
                if before is not None and (top is None or before + score > top):
                    top, pieces, run = before + score, count[end - length] + 1, False
            c = text[end - 1]
            before = best[end - 1]
            if c not in self.singles and before is not None and (top is None or before + self.unknown > top):
                top, run = before + self.unknown, True
                added = len(c.encode()) if self.byte_pieces else int(not open_run[end - 1])
                pieces = count[end - 1] + added
            best[end], count[end], open_run[end] = top, pieces, run
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if not words[0]:
            words = words[1:]  # the text begins with a mark of its own
        missing = self.known.missing(set(words))
        known = self.known.new
        for w in missing:
            known[w] = self.word(MARK + w)
        return sum(map(known.__getitem__, words))


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def counter_of(model_path: str, byte_pieces: bool) -> PieceCounter:
    """A worker's counter, with what it remembers, serves its next tasks."""
    return resident(("pieces", model_path, byte_pieces), lambda: PieceCounter(load_pieces(model_path), byte_pieces))


def count_tokens(docs: DataFrame, model_path: str, byte_pieces: bool = True) -> DataFrame:
    """(doc_id, n_chars, n_unigram_tokens) of every document."""

    def work(batches):
        counter = counter_of(model_path, byte_pieces)
        for batch in batches:
            texts = batch["text"]
            yield {"doc_id": batch["doc_id"], "n_chars": [len(t) for t in texts], "n_unigram_tokens": [counter.text(t) for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_rows(rows, "doc_id long, n_chars long, n_unigram_tokens long", work, keeps=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
