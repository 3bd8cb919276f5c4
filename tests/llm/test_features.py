"""Features of the quality classifier."""

import numpy as np
import pyarrow as pa

from tickloom.llm.quality_model import _shape, features, places
from tickloom.llm.text import U, mix


def test_length_and_repetition_are_those_of_the_whole_text():
    texts = [f"{w} " * 4000 for w in "abcdefghijkl"] + [" ".join(f"w{i}" for i in range(n)) for n in range(1, 40)]
    for text, found in zip(texts, features(pa.array(texts))):
        words = text.split()
        shape = _shape(np.frombuffer(text.encode(), np.uint8), len(words), len(set(words)))
        assert np.isin(places(mix(np.array(shape, U))), found).all()
