"""Texts with the literals of added tokens get the ids that the tokenizer file gives as it is loaded."""

import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tests.llm import brute
from zonecraft.llm import packing
from zonecraft.llm.plans import tokenizer_path


def test_chunks_with_added_tokens():
    whole, short = Tokenizer.from_file(tokenizer_path()), packing.ChunkTokenizer(tokenizer_path())
    r = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "a", "É", "don't", "1", " ", "\n", "日", "<", ">"]
    texts = ["hello <|endoftext|> world", *("".join(r.choices(parts, k=r.randint(1, 8))) for _ in range(2000))]
    raw = [x.encode() for x in texts]
    ids, upto = short.block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for x, a, b in zip(texts, [0, *upto], upto):
        assert ids[a:b].tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)
    assert ids[:upto[0]].tolist() == [3306, 49407, 1002]


def test_packing_of_added_tokens(spark):
    docs = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|>" * 9), (3, "plain words")]
    got = packing.packed(spark.createDataFrame(docs, "doc_id bigint, text string"), tokenizer_path()).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter((i, *p) for i, t in docs for p in brute.pieces(t, whole))
