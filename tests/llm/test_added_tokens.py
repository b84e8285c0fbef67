import random

import pyarrow as pa
from tokenizers import Tokenizer

from linewright.llm.tokens import BatchTokenizer, tokenizer_path


def test_ids_equal_those_of_tokenizers():
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokens, rng = BatchTokenizer(bits=6, most=200), random.Random(8)
    assert tokens.ids(pa.array(["x <|endoftext|> y"]))[0].tolist()[2] == 50256
    parts = [" ", "\n", "a", "é", "'s", "12", "日", "!", "the", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|"]
    for _ in range(200):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8)] + [None, "<|endoftext|>", "plain words\nalone"]
        ids, at = tokens.ids(pa.array(texts, pa.string()))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_no_added_tokens_across_texts():
    ids, at = BatchTokenizer().ids(pa.array(["<|endof", "text|>"]))
    assert 50256 not in ids.tolist() and at[-1] == len(ids)
