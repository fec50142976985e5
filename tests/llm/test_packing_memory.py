"""What a Python worker keeps of the parts it has encoded stays small, whatever it has read; ids do not change."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from quarry.llm import packing


def test_known_parts_stay_within_their_bound():
    words = packing._Words(str(public_tokenizers.path("word_bpe_49k.json")))
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    rng = np.random.default_rng(3)
    for turn in range(6):
        texts = [b" ".join(w.tobytes() for w in letters[rng.integers(0, 26, (1000, 9))]).decode() for _ in range(100)]
        ids, n = words.texts(pa.array(texts), 1)
        assert words.known_bytes() <= 12 << 20, turn
        edge = np.cumsum(n)
        for k in (0, 57, 99):
            want = words.tokenizer.encode(texts[k], add_special_tokens=False).ids
            assert ids[edge[k] - n[k]:edge[k]].tolist() == [*want, 1]
