"""What the fits leave in the driver, and that fitting in place changes no vector."""

import numpy as np
import pyarrow as pa

from sparksentry.llm import arrowtext, frames, quality, toxicity

TEXTS = pa.array([f"word{i % 7} is {'vile' if i % 3 else 'fine'} number {i % 11}" for i in range(300)])
LABELS = np.array([int(i % 3 > 0) for i in range(300)])


def test_a_fit_leaves_no_tables_behind():
    net = toxicity.train(TEXTS, LABELS, [None] * 300, epochs=2)
    assert "slots" not in net.__dict__
    toxicity.score_texts(net, TEXTS)
    assert arrowtext._powers
    frames.release_memory()
    assert not arrowtext._powers and np.isfinite(toxicity.score_texts(net, TEXTS)).all()


def test_vectors_fitted_in_place():
    votes = quality.fit_votes(TEXTS, LABELS.astype(float))
    counts = np.concatenate([quality.term_counts(words) for _, _, words in arrowtext.word_blocks(TEXTS)])
    assert np.array_equal(votes.vectors, votes.latent(counts).astype(np.float32))
