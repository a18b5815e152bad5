import functools
import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import packing as P

TEXTS = ["", None, "Hello world", "Ünïcödé – “quotes” 你好 🙂", "a" * 500, "word " * 300, "<|endoftext|> x\x85y  z", "tab\tand\n\nlines "]


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_rebuild_every_document_and_sequences_have_no_gaps(docs_of):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, "lorem ipsum " * rng.randint(0, 40)) for i in range(40)]
    rows += [(50, "lorem ipsum"), (None, "null id")]
    capacity = 64
    got = P.pack(docs_of(rows), capacity=capacity, shard_items=20).collect()
    whole = defaultdict(list)
    for i, text in rows:
        ids = np.array(ids_of(text), "<u4")
        first = len(ids) % capacity or capacity
        stops = list(range(first, len(ids) + 1, capacity))
        for k, stop in enumerate(stops):
            start = max(0, stop - capacity) if k else 0
            whole[i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())].append(1)
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
    assert mine == whole
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // capacity) + 4


def test_empty_table(docs_of):
    assert P.pack(docs_of([])).collect() == []


def test_encoders_agree_on_ordinary_and_odd_texts():
    encode = P.Encoder("byte_bpe_50k.json")
    rng = random.Random(1)
    pool = [chr(c) for r in ((9, 14), (28, 127), (160, 592), (0x400, 0x410), (0x2000, 0x2010)) for c in range(*r)]
    marked = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext", "é<|endoftext|>\n"]
    assert 50256 in encode(marked[0])
    for text in marked + [t or "" for t in TEXTS] + ["".join(rng.choices(pool + [" ", "a", "'s"] * 40, k=60)) for _ in range(300)]:
        assert encode(text) + [2] == ids_of(text)


def test_genetic_algorithm_keeps_items_and_never_worsens():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 60) for _ in range(120)), reverse=True)
    p = P.Packer(sizes, 64, 1)
    start = p.best_fit([], list(range(120)))
    end = p.evolve([start], 6, 10)
    assert sorted(i for b in end for i in b) == list(range(120))
    assert all(sum(sizes[i] for i in b) <= 64 for b in end)
    assert p.least <= len(end) <= len(start)
