import numpy as np

from folioscope.llm import lm

from .test_lm import toy


def test_training_learns_from_the_third_symbol_back():
    rng = np.random.default_rng(4)
    seen = rng.integers(0, 3, (60_000, 3))
    context, target = seen[:, : lm.CONTEXT], seen[:, 2]  # what follows is the symbol three before it; the others say nothing
    model, state = lm.LogBilinear(toy([9, 9, 9])), {}
    for _ in range(12):
        model.train(target, context, rng, state)
    assert 10 ** model.log10_probabilities(target[:500], context[:500]).mean() > 0.8
