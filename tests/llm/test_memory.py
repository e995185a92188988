"""What the passes of near-dedup hold in a Python worker."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from public_tokenizers import path

from repselect.llm import bpe, similar


def test_bitmaps_of_many_pairs_are_compared_in_parts():
    rng = random.Random(3)
    maps = [rng.randbytes(2048) for _ in range(64)]
    own, x, y = similar.Bitmaps(maps), np.arange(32768) % 64, np.arange(32768) // 512
    own.lacking(x[:1], y[:1])
    tracemalloc.start()
    less_x, less_y = own.lacking(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # all at once take over 200 MB
    bits = [int.from_bytes(m, "little") for m in maps]
    for k in range(0, 32768, 331):
        a, b = bits[x[k]], bits[y[k]]
        assert (less_x[k], less_y[k]) == ((a & ~b).bit_count(), (b & ~a).bit_count())


def test_a_pass_lets_go_of_what_encoding_has_left():
    class Rows:
        """Keeps the function that a pass hands to Spark."""
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    bpe.tokenizer(path("byte_bpe_50k.json")).encode_batch(["some words"])
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array(["a b", "a b"])], ["node", "text"])
    (out,) = similar._sets(Rows(), 5)(iter([batch]))
    assert out.column("node").to_pylist() == [5] and not bpe._LOADED
