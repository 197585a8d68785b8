import tracemalloc

import pyarrow as pa

from driftmerge.llm import hmm
from driftmerge.llm.common import Digests


def test_tokens_of_a_block_are_coded_without_its_words():
    texts = [" ".join(f"w{(k * 7919 + i) % 5000}" for i in range(1000)) for k in range(400)]
    column, memo = pa.array([*texts, "", "A a"], pa.large_string()), Digests(hmm.token)
    hmm.coded(column, 0, 10, memo)
    tracemalloc.start()
    size, found = hmm.coded(column, 0, len(column), memo)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size.tolist() == [1001] * 400 + [1, 3] and found.nbytes == size.sum() * 10
    # 400,402 words as objects would be over 15 MB.
    assert peak < 3 * found.nbytes
    assert found[-4:]["key"].tolist()[1] == found[-4:]["key"].tolist()[2] and found["key"][-1] == hmm.END
