"""Ids of words that are cut into pieces are those of the library."""

import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epilimnia.llm import range_coder


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    letters = "abstredvmlSTRL\u0131\u017f\u0178\u00c0\u00ff\u0130K'''''!.,#$%<|>/w0129\xb2\xbc\xaa\xba\xb5\xd7\xf7\xad\u0307\u0301\u030cjJ\xe9 \x85\xa0\x1c\x00 \t\n\x0b\u4e2d\u65e5\u03a3\u03c3\u03c2\u0391\U0001f600\u01f0\u01c5\u023aabcdefghij    "
    fixed = [None, "", "  ", "<|endoftext|>", "x<|endoftext|>y <|EndOfText|> <|STARTOFTEXT|>", "</w> a</w>", " it's IT'S we'll'd 'street '''s", "déjà! l'été"]
    return fixed + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(2_000)] + ["".join(chr(rng.choice([rng.randrange(0x20, 0x180), 39])) for _ in range(40)) for _ in range(2_000)]


@pytest.mark.parametrize("cache", [10, 400_000])
@pytest.mark.parametrize("known_steps", [True, False])
def test_ids_are_the_librarys(monkeypatch, vocabulary, cache, known_steps):
    monkeypatch.setattr(range_coder, "CACHE", cache)
    monkeypatch.setattr(range_coder, "SLICE", 50)
    library, texts = Tokenizer.from_str(vocabulary), odd_texts()
    encoder = range_coder.WordEncoder(vocabulary, "<u2", range_coder.piece_ends(vocabulary) if known_steps else None)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, sizes = encoder.encode(pa.array([None, *part], type=pa.string()).slice(1))
        want = [x.ids for x in library.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_library_merges_each_piece_once(monkeypatch, vocabulary):
    encoder = range_coder.WordEncoder(vocabulary, "<u2", range_coder.piece_ends(vocabulary))
    seen, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text, merge=False: seen.append((text, merge)) or ids(text, merge))
    encoder.encode(pa.array(["Thinble, thinble. thinble### (thinble) éou!", "éou, thinble's"]))
    encoder.encode(pa.array(["thinble; ÉOU"]))
    assert all(merge for _, merge in seen)
    assert sum(text.split(" ").count("thinble") for text, _ in seen) == 1


def test_other_steps_before_the_merges_are_left_to_the_library(vocabulary):
    file = json.loads(vocabulary)
    assert range_coder.piece_ends(vocabulary) is not None
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}, {"model": file["model"] | {"unk_token": "a"}}):
        assert range_coder.piece_ends(json.dumps(file | change)) is None
    normalized = json.dumps(file | {"added_tokens": [t | {"normalized": True} for t in file["added_tokens"]]})
    assert range_coder.piece_ends(normalized) is None


def test_parts_hold_all_rows(monkeypatch):
    monkeypatch.setattr(range_coder, "PART_BYTES", 100)
    texts = [None, "x" * 99, "", "y" * 350, "z", None, *["w" * 30] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(range_coder._parts(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) <= 100 for p in parts) and len(parts) > 5
    assert not list(range_coder._parts(batch.slice(0, 0)))
    numbers = range_coder.Sequences(np.arange(5, dtype="<u2"), np.array([2, 0, 3]))
    assert [x.tolist() for x in numbers.gather(np.array([2, 1, 0, 2]))] == [[2, 3, 4, 0, 1, 2, 3, 4], [3, 0, 2, 3]]
