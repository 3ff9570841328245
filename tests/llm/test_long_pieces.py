"""Segmentations use every letter piece of the vocabulary, the longest too."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import sentencepiece

from tessera.llm import language_id


def test_no_letter_piece_is_left_out():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    letters = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if p.removeprefix("▁").isalpha() and p == p.lower()}
    vocab = language_id.Pieces(path)
    assert letters <= set(vocab.texts)
    table = np.full((len(vocab) + 2, 1), 1e-3)
    table[len(vocab)] = 0
    more = table.copy()
    more[vocab.texts.index("▁representatives")] = 0.5
    assert language_id.word_scores(["representatives"], vocab, more)[0, 0] > language_id.word_scores(["representatives"], vocab, table)[0, 0] + 1
