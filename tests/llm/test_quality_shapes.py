"""Features of op3 against a plain count of words and shapes."""

import re
import zlib
from collections import Counter

import numpy as np

from sparkweave.llm import quality as Q


def test_features_equal_a_plain_count():
    text = "Aa. AAa bb11 ÉÉté été 中文 中文 ǅ ²³ x!!! x!!! _a_ \U0001f600\U0001f600 ß"
    words, counts = text.split(), Counter()
    for w in words:
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
        counts[zlib.crc32(b"s" + shape.encode()) % Q.DIMS] += 1
        counts[zlib.crc32(b"w" + w.lower().encode()) % Q.DIMS] += 1
    at, value = Q.features(text)
    assert dict(zip(at.tolist(), value.tolist())) == {k: float(np.sqrt(np.float32(n) / len(words))) for k, n in counts.items()}
    assert at.tolist() == sorted(counts)  # gathered by sorting, not word by word
