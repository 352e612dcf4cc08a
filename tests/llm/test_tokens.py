"""Token ids equal the library's whatever the piece cache has dropped."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from typeahead.llm import binpack, tokens


@pytest.mark.parametrize("pieces", [5, 300, 150_000])
def test_generations_of_pieces(monkeypatch, pieces):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tokens, "CACHE_PIECES", pieces)
    path = binpack.tokenizer_file()
    enc, tok = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:60]
    texts += [None, "", "<|endoftext|>", "日本", "a", texts[0]]
    for lo in range(0, len(texts), 3):  # many calls, so that generations turn
        part = texts[lo:lo + 3]
        ids, ends = enc.encode(part, 2)
        want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], np.uint32) for t in part]
        assert np.array_equal(ids, np.concatenate(want)) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert len(enc.index) + len(enc.old[0]) < 2 * pieces + 2 * sum(len(t or "") for t in part) + 2 * max(len(t or "") for t in texts)
