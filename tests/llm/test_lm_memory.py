"""What scoring a group of texts holds at once, for each of its tokens."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fieldloom.llm import lm

TOKENS, BUCKETS = 200_000, 4


def test_a_group_holds_few_bytes_a_token():
    drawn = np.random.default_rng(1).integers(0, 2_000, TOKENS)
    texts = [" ".join(f"w{x}" for x in part) for part in np.split(drawn, 100)]
    table = pa.table({"text": texts, "_group": pa.array([0] * len(texts), pa.int64())})
    tracemalloc.start()
    try:
        sent = lm.asked(table, "text", np.ones(len(texts), bool), True, BUCKETS)
        told = pa.concat_tables([lm.answered(sent.slice(b, 1)) for b in range(BUCKETS)])
        own = lm.Group((x.encode() for x in texts), BUCKETS)
        lost = lm.losses(own, told)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert lost.shape == (2, TOKENS) and np.allclose(lost[0], lost[1])
    assert peak < 110 * TOKENS
