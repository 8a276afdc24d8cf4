"""All samples of a thumbnail have a part in its hash."""

import numpy as np

from quaymark.llm.jpeg_media import thumbnail_hash


def test_cells_are_averaged():
    rng = np.random.default_rng(5)
    for h, w in ((80, 90), (37, 41), (8, 9), (3, 4), (1, 1), (1, 20)):
        a = rng.integers(0, 256, (h, w), dtype=np.uint8)
        y, x = [k * h // 8 for k in range(9)], [k * w // 9 for k in range(10)]
        m = np.array([[a[y[i] : max(y[i + 1], y[i] + 1), x[j] : max(x[j + 1], x[j] + 1)].mean() for j in range(9)] for i in range(8)])
        assert thumbnail_hash(a) == np.packbits(m[:, 1:] > m[:, :-1]).tobytes().hex()
    b = np.zeros((80, 90), np.uint8)
    b[1:9, 11:19] = 200  # at none of the 72 corners
    assert thumbnail_hash(b) != thumbnail_hash(np.zeros((80, 90), np.uint8))
