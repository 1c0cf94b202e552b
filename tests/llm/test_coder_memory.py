import tracemalloc

import numpy as np

from barloom.llm import id_coder


def test_decoding_many_blocks_holds_the_tables_of_few():
    """All lanes at once took twice as much."""
    n, length = 2048, 300
    ids = [((np.arange(length) * (i + 3)) % 997).astype(np.int32) for i in range(n)]
    prior = id_coder.Prior(50_257)
    codes = id_coder.encode(ids, prior)
    tracemalloc.start()
    back = id_coder.decode(codes, np.full(n, length), prior)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(ids, back)) and peak < 80e6
