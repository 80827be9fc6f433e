"""Piece counts of a unigram tokenizer without making its pieces.

A text is cut before every space mark, as unigram tokenizers do, and for each
part Aho-Corasick lists the vocabulary entries that end at each character. The
best path carries only its score and number of pieces. Tie rules of the
tokenizer: of paths with the same score the one whose last piece starts
earliest wins, a character that is no piece itself may be covered by an unknown
of the lowest score less 10, and unknowns fall back to one piece per byte.

Defined results: null and empty texts have no pieces and score 0; every input
row gives one row; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gradewell.columns import col
from gradewell.llm.common import Cache, arrow_rows

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every entry of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def piece_counter(vocabulary: list[tuple[str, float]]):
    """The function part -> (pieces, score) of its best path."""
    automaton = ahocorasick.Automaton()
    for piece, score in dict(vocabulary).items():
        if piece:
            automaton.add_word(piece, (len(piece), score))
    if len(automaton):
        automaton.make_automaton()
    unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(part: str) -> tuple[int, float]:
        n = len(part)
        score: list = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        done = 0  # paths to every end up to here are final

        def close(end: int, single: bool) -> None:
            if not single:
                other = score[end - 1] + unknown
                if score[end] is None or other > score[end]:
                    score[end] = other
                    pieces[end] = pieces[end - 1] + len(part[end - 1].encode())

        single = False
        for last, (length, worth) in automaton.iter(part) if len(automaton) else ():
            end = last + 1
            while done + 1 < end:
                done += 1
                close(done, single)
                single = False
            other = score[end - length] + worth
            if score[end] is None or other > score[end]:
                score[end] = other
                pieces[end] = pieces[end - length] + 1
            single = single or length == 1
        while done < n:
            done += 1
            close(done, single)
            single = False
        return pieces[n], score[n]

    return count


def count_tokens(
    df: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_chars, n_pieces, path_score) of every row."""

    def task():
        best = Cache(piece_counter(vocabulary))

        def rows(batch: pa.RecordBatch) -> dict:
            chars, pieces, scores = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                chars.append(len(text))
                marked = text.replace(" ", SPACE_MARK)
                if marked and marked[0] != SPACE_MARK:
                    marked = SPACE_MARK + marked
                found = [best[SPACE_MARK + part] for part in marked.split(SPACE_MARK)[1:]]
                pieces.append(sum(n for n, _ in found))
                scores.append(sum(s for _, s in found) + 0.0)
            return {"doc_id": batch.column(0), "n_chars": chars, "n_pieces": pieces, "path_score": scores}

        return rows

    source = df.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return arrow_rows(source, task, "doc_id bigint, n_chars bigint, n_pieces bigint, path_score double")
