"""Parts of texts and literals of special tokens are read as by the library's default."""

import random

import numpy as np
import pytest

from molkeys.llm import queries, token_files

MARK = "<|endoftext|>"
TEXTS = [MARK, f"a{MARK}b", f"a {MARK}", f"a {MARK} b\n{MARK}\nc", MARK + MARK, "a <|endof text|> b", f"x\n{MARK} y", "plain words here", ""]
ALPHABET = [*"ab'.,1 \n\t", "  ", "\n\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "à ", " ", " ", " ", "　", "é", "日", "🙂", " it's", "don't ", " word,", "\nLine"]


def library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    return Tokenizer.from_file(path), path


def test_special_literals_equal_the_library():
    t, path = library()
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in TEXTS]
    assert token_files.encode_texts(TEXTS, path) == want
    assert token_files.encode_texts([f"a{MARK}b"], path) == [np.array([64, 50256, 65], "<u4").tobytes()]


def test_white_space_of_all_kinds_equals_the_library():
    t, path = library()
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))) for _ in range(6000)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert token_files.encode_texts(texts, path) == want


@pytest.mark.parametrize("step", [3, 16 << 20])
def test_repeated_ids_follow_each_other_by_text(spark, step, monkeypatch):
    monkeypatch.setattr(token_files, "PART_STEP", step)
    t, path = library()
    rows = [(3, "c d"), (1, "b"), (1, "a a a"), (1, None), (2, "x " * 3000 + "end"), (None, "none"), (3, "c d")]
    got = token_files.tokenise_to_files(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    n = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] or ""))]
    assert sorted((r.start, r.n_tokens) for r in got) == list(zip(np.cumsum([0, *n[:-1]]).tolist(), n))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 1, 1, 2, 3, 3]
