"""Words of very long texts, which are read in segments, against words read one by one."""

import random

import numpy as np

from lamina.llm import tokens


def test_segments_cut_no_word():
    rng = random.Random(1)
    words = [rng.choice("abc") * rng.choice([1, 3, 7]) for _ in range(200_000)] + ["y" * 700_000, "z"]
    texts = ["first text", "", " ".join(words) + " \n", "last"]
    h, start, end, at, begins = tokens.split([t.encode() for t in texts])
    raw = "\n".join(texts)
    plain = [w for t in texts for w in t.split()]
    assert [raw[a:b] for a, b in zip(start.tolist(), end.tolist())] == plain
    assert at.tolist() == [0, 2, 2, 2 + len(words), 3 + len(words)] and begins.tolist() == [0, 11, 12, 13 + len(texts[2])]
    one = {w: tokens.split([w.encode()])[0][0] for w in set(plain)}
    assert np.array_equal(h, np.array([one[w] for w in plain]))
    assert set(tokens._POWERS) <= {2 * tokens.CHUNK, 4 * tokens.CHUNK}
